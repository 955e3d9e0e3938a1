"""Search, vectors and expansion against plain Python."""

from collections import defaultdict

import numpy as np
import pytest

from pyspark.sql import functions as F

from starcard.operators import expand as X
from starcard.operators import search as S
from starcard.operators import vectors as N
from starcard.session import scratch_path

TEXTS = {
    1: "patient drug reaction report", 2: "drug drug drug", 3: "the of and", 4: "reaction date of the patient",
    5: "country lookup", 6: "patient drug reaction report", 7: "", 8: "reaction reaction country drug",
    9: "report of drug reaction in country", 10: "sex of patient",
}
ASKED = {1: "drug reaction", 2: "country of patient patient", 3: "nothing here", 4: "the"}


@pytest.fixture(scope="module")
def texts(spark):
    docs = spark.createDataFrame(list(TEXTS.items()), "doc_id bigint, text string")
    asked = spark.createDataFrame(list(ASKED.items()), "query_id bigint, text string")
    return docs, asked


def test_fusion(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id bigint, doc_id bigint, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id bigint, doc_id bigint, rank int")
    got = [(r["doc_id"], r["score"]) for r in S.fuse(a, b).orderBy("rank").collect()]
    assert got == [(11, round(1 / 61 + 1 / 62, 9)), (10, round(1 / 61, 9)), (12, round(1 / 62, 9))]


def test_rerank_and_lookup(spark, texts):
    hits = spark.createDataFrame([(1, 2, 1), (1, 8, 2), (1, 5, 3)], "query_id bigint, doc_id bigint, rank int")
    docs = texts[0].withColumn("title", texts[0]["text"])
    got = S.rerank(hits, docs, texts[1], {"title": 3, "text": 2})
    assert [(r["doc_id"], r["score"]) for r in got.orderBy("rank").collect()] == [(8, 10), (2, 5), (5, 0)]
    found = S.look_up(hits, spark.createDataFrame([(8,), (8,)], "doc_id bigint"), "doc_id")
    assert {r["doc_id"]: r["found"] for r in found.collect()} == {2: False, 8: True, 5: False}


def test_fallback(spark):
    asked = spark.createDataFrame([(1, "A"), (2, "A"), (3, "B"), (4, "C")], "query_id bigint, owner string")
    hits = spark.createDataFrame([(1, "A.X")], "query_id bigint, qualified_name string")
    cards = spark.createDataFrame([("A", "A.X"), ("A", "A.Y"), ("B", "B.X")], "owner string, qualified_name string")
    got = {tuple(r) for r in S.with_fallback(asked, hits, cards).collect()}
    assert got == {(1, "A.X", "hit"), (2, "A.X", "all"), (2, "A.Y", "all"), (3, "B.X", "all")}


def vectors(spark, n=300, dim=8):
    rnd = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rnd.normal(size=dim).round(1)]) for i in range(n)]
    rows += [(n + i, rows[i][1]) for i in range(20)] + [(n + 20, [0.0] * dim)]
    return rows, spark.createDataFrame(rows, "doc_id bigint, vector array<float>").repartition(6)


def brute_knn(rows, asked, k):
    out = {}
    for q in asked:
        a = np.array(rows[q][1], dtype=np.float32).astype(float)
        scores = []
        for d, v in rows:
            b = np.array(v, dtype=np.float32).astype(float)
            norm = np.linalg.norm(a) * np.linalg.norm(b)
            scores.append((-round(float(a @ b / norm), 6) if norm else 0.0, d))
        for rank, (s, d) in enumerate(sorted(scores)[:k], 1):
            out[(q, d)] = rank
    return out


@pytest.mark.parametrize("carried", [4096, 3])
def test_knn(spark, carried, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_QUERIES", 4)
    monkeypatch.setattr(N, "BLOCK_VECTORS", 50)
    rows, df = vectors(spark)
    asked = df.filter("doc_id < 10").withColumnRenamed("doc_id", "query_id")
    got = N.knn(asked, df, 7, carried=carried).collect()
    assert {(r["query_id"], r["doc_id"]): r["rank"] for r in got} == brute_knn(rows, range(10), 7)


def test_knn_cells_recall(spark):
    rows, df = vectors(spark)
    asked = df.filter("doc_id < 20").withColumnRenamed("doc_id", "query_id")
    exact = {(r["query_id"], r["doc_id"]) for r in N.knn(asked, df, 10).collect()}
    near = {(r["query_id"], r["doc_id"]) for r in N.knn_cells(asked, df, 10, cells=8, probes=5).collect()}
    assert len(exact & near) / len(exact) > 0.7
    assert {(r["query_id"], r["doc_id"]) for r in N.knn_cells(asked, df, 10, cells=8, probes=8).collect()} == exact


def test_embedding(spark, texts):
    got = {r["doc_id"]: r["vector"] for r in N.hashed_embedding(texts[0]).collect()}
    assert got[1] == got[6] and abs(sum(x * x for x in got[1]) - 1) < 1e-9

    def embedder(batch):
        assert len(batch) <= 4
        return [[float(len(t)), 1.0] for t in batch]

    sizes = {r["doc_id"]: r["vector"] for r in N.embed_batches(texts[0], embedder, 4).collect()}
    assert sizes == {d: [float(len(t)), 1.0] for d, t in TEXTS.items()}


# --- expansion ----------------------------------------------------------------------------------

EDGES = [("A.1", "L.z"), ("A.1", "B.9"), ("A.2", "L.a"), ("A.2", "A.3"), ("A.3", "B.1"), ("A.4", "L.q"), ("R.1", "A.1"), ("R.2", "A.4")]
CORE = {1: ["A.1", "A.2", "A.3", "A.4"], 2: ["A.4"], 3: ["L.z", "A.1"]}
CARDS = {"L.z", "L.a", "L.q", "B.9", "R.1", "R.2", "A.1", "A.2", "A.3", "A.4"}


def brute_expand(seed_count, max_total, reverse, cards):
    out = set()
    for q, core in CORE.items():
        out |= {(q, n, i, "core") for i, n in enumerate(core[:max_total], 1)}
        if seed_count == 0:
            continue
        seeds = core[:seed_count]
        names = {d for s, d in EDGES if s in seeds} | ({s for s, d in EDGES if d in seeds} if reverse else set())
        names = sorted(names - set(core), key=lambda n: (not n.startswith("L."), n))
        names = [n for n in names[: max(0, max_total - len(core))] if n in cards]
        out |= {(q, n, len(core) + i, "lookup" if n.startswith("L.") else "other") for i, n in enumerate(names, 1)}
    return out


@pytest.mark.parametrize("seed_count", [0, 1, 3, 10])
@pytest.mark.parametrize("max_total", [2, 5, 6, 25])
@pytest.mark.parametrize("reverse", [False, True])
def test_expand(spark, seed_count, max_total, reverse):
    core = spark.createDataFrame(
        [(q, n, i) for q, names in CORE.items() for i, n in enumerate(names, 1)], "query_id bigint, name string, rank int")
    edges = spark.createDataFrame(EDGES, "src string, dst string")
    for cards in (CARDS, CARDS - {"L.a", "B.9"}):
        held = spark.createDataFrame([(c,) for c in cards], "name string")
        got = X.expand(core, edges, held, seed_count, max_total, reverse, lookup_schema="L")
        assert {tuple(r) for r in got.collect()} == brute_expand(seed_count, max_total, reverse, cards)


def test_expand_disabled(spark):
    core = spark.createDataFrame([(1, f"A.{i}", i) for i in range(1, 40)], "query_id bigint, name string, rank int")
    edges = spark.createDataFrame(EDGES, "src string, dst string")
    assert X.expand(core, edges, core.select("name"), enabled=False).count() == 39


def test_join_paths(spark):
    edges = [("t", "T.A", "T.B"), ("t", "T.B", "R.C"), ("t", "T.A", "T.D"), ("t", "T.D", "R.C"), ("R", "R.C", "R.E"), ("t", "T.B", "T.A")]
    starts = spark.createDataFrame([("t", "T.A")], "owner string, name string")
    got = X.join_paths(starts, spark.createDataFrame(edges, "owner string, src string, dst string"), "R")
    assert {r["target"]: (r["hops"], r["path"]) for r in got.collect()} == {
        "T.B": (1, "T.A>T.B"), "T.D": (1, "T.A>T.D"), "R.C": (2, "T.A>T.B>R.C"), "R.E": (3, "T.A>T.B>R.C>R.E")}


def test_selection(spark):
    said = spark.createDataFrame(
        [(1, "b", 5, 1), (1, "a", 6, 2), (1, "b", 7, 3), (1, "zz", 1, 4), (2, "zz", 1, 5)], "run_id int, name string, ts int, event_id int")
    cards = spark.createDataFrame([("a",), ("b",), ("a",)], "name string")
    got = {tuple(r) for r in X.resolve_selection(said, cards).collect()}
    assert got == {(1, 1, "b", "selected"), (1, 2, "a", "selected"), (2, 0, None, "empty")}


def test_values_and_core(spark):
    said = spark.createDataFrame([(1, "netherlands"), (1, "cases")], "query_id int, term string")
    values = spark.createDataFrame([("COUNTRY", "7", "Netherlands")], "ref_table string, map_key string, map_value string")
    edges = spark.createDataFrame([("PATIENT", "COUNTRY_ID", "COUNTRY")], "table_name string, column_name string, ref_table string")
    assert [tuple(r) for r in X.tables_for_values(said, values, edges).collect()] == [
        (1, "netherlands", "COUNTRY", "7", "PATIENT", "COUNTRY_ID")]
    cards = spark.createDataFrame([("A",), ("B",), ("C",)], "name string")
    got = X.safety_net(["A", "B", "X"], cards, cards.filter("name = 'A'"), ["name"])
    assert [r["name"] for r in got.collect()] == ["B"]


def test_join_paths_do_not_stop(spark):
    edges = spark.createDataFrame([("S", a, b) for a, b in zip("ABCDEFG", "BCDEFGC")], "owner string, src string, dst string")
    starts = spark.createDataFrame([("S", "A")], "owner string, name string")
    found = {r["target"]: (r["hops"], r["path"]) for r in X.join_paths(starts, edges, "LOOKUP").collect()}
    assert found["G"] == (6, "A>B>C>D>E>F>G") and set(found) == set("BCDEFG")


def test_cells_reach_the_recall_asked_for(spark):
    rng = np.random.default_rng(1)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(600, 8)))], "doc_id long, vector array<double>")
    asked = vectors.filter("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    index = N.fit_cells(vectors, scratch_path(spark, "cells"), cells=40)
    exact = {(r["query_id"], r["doc_id"]) for r in N.knn(asked, vectors, 10).collect()}
    near = {(r["query_id"], r["doc_id"]) for r in N.search_cells(index, asked, 10, recall=0.95).collect()}
    assert len(near & exact) >= 0.9 * len(exact)
