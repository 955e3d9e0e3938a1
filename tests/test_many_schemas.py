"""Many questions, each limited to a few of many schemas."""

import re

import numpy as np
from pyspark.sql import functions as F

from starcard.operators import fielded as S
from starcard.operators import vectors as N
from starcard.session import scratch_path


def build(spark, schemas: int) -> S.FieldedIndex:
    docs = spark.range(schemas * 4).select(
        F.col("id").alias("doc_id"), F.format_string("S%03d", F.floor(F.col("id") / 4)).alias("owner"),
        F.concat(F.lit("orders of "), F.when(F.col("id") % 4 == 1, "parts").otherwise("people")).alias("text"),
    )
    return S.add_documents(S.create_index(spark, scratch_path(spark, "index"), [S.Field("text")]), docs, "owner")


def test_questions_meet_groups_of_their_schemas(spark, monkeypatch):
    monkeypatch.setattr(S, "GROUP_DOCS", 20)
    monkeypatch.setattr(S, "ASKED_TOGETHER", 3)
    index = build(spark, 30)
    asked = spark.createDataFrame(
        [(i, "orders parts", [f"S{i:03d}", f"S{i:03d}", "S007", None]) for i in range(30)] + [(90, "parts", None), (91, "parts", []), (92, "parts", ["none"]), (None, "parts", ["S001"])],
        "query_id long, text string, schemas array<string>",
    )
    seen, stored = {}, S.stored

    def recorded(df, label):
        seen.setdefault(label, df)
        return stored(df, label)

    monkeypatch.setattr(S, "stored", recorded)
    hits = S.search(index, asked, 10).collect()
    for i in range(30):
        mine = {r["doc_id"] for r in hits if r["query_id"] == i}
        assert mine == {*range(i * 4, i * 4 + 4), *range(28, 32)}
        assert next(r["doc_id"] for r in hits if r["query_id"] == i and r["rank"] == 1) == min(i * 4 + 1, 29)
    assert [r["doc_id"] for r in sorted((r for r in hits if r["query_id"] == 90), key=lambda r: r["rank"])] == [4 * i + 1 for i in range(10)]
    assert {r["query_id"] for r in hits} == {*range(30), 90}
    # blocks of other groups aren't met: the join is by group and term
    monkeypatch.setattr(S, "stored", stored)
    seen.clear()
    monkeypatch.setattr(S, "stored", recorded)
    S.search(index, asked.filter("schemas IS NOT NULL"), 10)
    text = seen["bounds"]._jdf.queryExecution().optimizedPlan().toString()
    met = [line for line in text.splitlines() if re.search(r"Join Inner.*term#\d+ = term#\d+", line)]
    assert met and all("grp#" in line for line in met)


def test_repeated_questions_count_as_before(spark):
    index = build(spark, 3)
    asked = spark.createDataFrame([(1, "parts", ["S001"])], "query_id long, text string, schemas array<string>")
    once, twice = (S.search(index, rows, 5).collect() for rows in (asked, asked.union(asked)))
    assert [r["doc_id"] for r in once] == [r["doc_id"] for r in twice] == [5]
    assert abs(twice[0]["score"] - 4 * once[0]["score"]) < 1e-5  # each copy asks for the terms of both


def test_small_and_large_cells(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_QUERIES", 16)
    monkeypatch.setattr(N, "BLOCK_VECTORS", 40)
    rng = np.random.default_rng(5)
    cells = [*np.repeat(np.arange(60), 3).tolist(), *[60] * 90]
    vectors = [(i, rng.integers(0, 9, 4).astype(float).tolist(), f"S{c}") for i, c in enumerate(cells)]
    asked = [(i, rng.integers(0, 9, 4).astype(float).tolist(), [f"S{i % 62}", "S60"][: 1 + i % 2]) for i in range(130)]
    got = N.knn_within(
        spark.createDataFrame(asked, "query_id long, vector array<double>, schemas array<string>"),
        spark.createDataFrame(vectors, "doc_id long, vector array<double>, schema string"), 4,
    ).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append(r["doc_id"])
    for i, v, schemas in asked:
        scored = []
        for d, w, s in vectors:
            if s in schemas:
                both = np.linalg.norm(v) * np.linalg.norm(w)
                scored.append((-round(float(np.dot(v, w) / both) if both else 0.0, 6), d))
        assert found.get(i, []) == [d for _, d in sorted(scored)[:4]]
