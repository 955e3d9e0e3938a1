"""The fielded index against a plain BM25F, through additions, deletions and compaction."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from starcard.functions.text import stem, stem_word
from starcard.operators import fielded as S
from starcard.rules import STOP_WORDS
from starcard.session import scratch_path

FIELDS = (S.Field("title", 3.0, b=0.5), S.Field("body", 1.0), S.Field("names", 2.0, "keyword"))
KIND = "doc_id bigint, owner string, title string, body string, names array<string>"


def stemmed(w):
    if w.endswith("ies") and not w.endswith(("eies", "aies")):
        return w[:-3] + "y"
    if w.endswith("es") and not w.endswith(("aes", "ees", "oes")):
        return w[:-1]
    if w.endswith("s") and not w.endswith(("us", "ss")):
        return w[:-1]
    return w


def words(text):
    found = [stemmed(w) for w in re.findall(r"[a-z0-9]+", (text or "").lower()) if w not in STOP_WORDS]
    return [w for w in found if w]


def terms(doc):
    return [words(doc[2]), words(doc[3]), ["=" + n for n in doc[4] or [] if n is not None]]


def brute(docs, asked, k):
    """{query: [(score, doc)]} with every document scored."""
    held = {d[0]: (d[1], [Counter(t) for t in terms(d)]) for d in docs}
    n = len(held)
    mean = [max(sum(sum(c[i].values()) for _, c in held.values()) / n, 1e-9) if n else 1 for i in range(3)]
    df = Counter(t for _, c in held.values() for t in set().union(*c))
    out = {}
    for q, text, schemas in asked:
        ts = set(words(text)) | ({"=" + text} if text is not None else set())
        hits = []
        for d, (owner, counts) in held.items():
            if schemas is not None and owner not in schemas:
                continue
            score, hit = 0.0, False
            for t in ts:
                x = sum(f.weight * c[t] / (1 - f.b + f.b * sum(c.values()) / m) for f, c, m in zip(FIELDS, counts, mean))
                if any(c[t] for c in counts):
                    hit = True
                    score += math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * x * 2.2 / (x + 1.2)
            if hit:
                hits.append((-round(score, 6), d))
        out[q] = sorted(hits)[:k]
    return {q: [(d, -s) for s, d in hits] for q, hits in out.items() if hits}


def corpus(rng, start, n):
    pool = ["patient", "patients", "drug", "reactions", "study", "studies", "class", "bus", "series", "of", "the", "date"] + [f"w{i}s" for i in range(60)]
    docs = []
    for i in range(start, start + n):
        title = " ".join(rng.choices(pool, k=rng.randint(0, 4)))
        body = title + " " + " ".join(rng.choices(pool, k=rng.choice([0, 3, 40, 200])))
        docs.append((i, rng.choice(["A", "B", "C", None]), title, rng.choice([body, None, body]), rng.choice([None, ["DRUG_ID"], ["A", "DRUG_ID", None]])))
    return docs


ASKED = [
    (1, "drug reactions", None), (2, "studies of patients", ["A"]), (3, "DRUG_ID", ["B", "C"]), (4, "nothing", None), (5, "the", None),
    (6, "w1 w2 w3 w59", ["A", "B"]), (7, "bus class series", ["none"]), (8, None, None), (9, "patient", []),
]


@pytest.fixture
def asked(spark):
    return spark.createDataFrame(ASKED, "query_id bigint, text string, schemas array<string>")


def found(index, asked, k, **more):
    out = {}
    for r in S.search(index, asked, k, **more).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
    return out


@pytest.mark.parametrize("group", [7, 4096])
def test_search_equals_scoring_everything(spark, asked, group, monkeypatch):
    monkeypatch.setattr(S, "GROUP_DOCS", group)
    monkeypatch.setattr(S, "FOLDER_POSTINGS", 500)
    docs = corpus(random.Random(4), 0, 150)
    index = S.create_index(spark, scratch_path(spark, "i"), FIELDS)
    index = S.add_documents(index, spark.createDataFrame(docs, KIND).repartition(5), "owner")
    for k in (3, 50):
        reading = S.Reading()
        assert found(index, asked, k, reading=reading) == brute(docs, ASKED, k)
        assert 0 < reading.opened <= reading.candidates


def test_second_pass_leaves_blocks_closed(spark, monkeypatch):
    monkeypatch.setattr(S, "GROUP_DOCS", 10)
    docs = [(i, "A", "drug" if i < 5 else "", "drug " + "filler " * i, None) for i in range(200)]
    index = S.add_documents(S.create_index(spark, scratch_path(spark, "i"), FIELDS), spark.createDataFrame(docs, KIND), "owner")
    one, reading = [(1, "drug", None)], S.Reading()
    asked = spark.createDataFrame(one, "query_id bigint, text string, schemas array<string>")
    assert found(index, asked, 5, reading=reading) == brute(docs, one, 5)
    assert reading.candidates == 20 and reading.opened <= 4
    limited = [(1, "drug", ["B"])]
    asked = spark.createDataFrame(limited, "query_id bigint, text string, schemas array<string>")
    assert found(index, asked, 5, reading=reading) == {} and reading.candidates == 0


def test_bounds_are_read_without_postings(spark):
    index = S.add_documents(S.create_index(spark, scratch_path(spark, "i"), FIELDS), spark.createDataFrame(corpus(random.Random(1), 0, 20), KIND), "owner")
    (_, name, _), = index.segments
    blocks = spark.read.parquet(f"{index.path}/segments/{name}/blocks")
    plan = blocks.select("term", "grp", "top", "low").filter("folder = 0 AND term = 'drug'")._jdf.queryExecution().executedPlan().toString()
    assert "postings" not in plan and "PushedFilters: [IsNotNull(term), EqualTo(term,drug)]" in plan


def test_upkeep_equals_a_fresh_build(spark, asked):
    rng = random.Random(9)
    path = scratch_path(spark, "i")
    first, more = corpus(rng, 0, 60), corpus(rng, 40, 60)  # 20 ids are replaced
    bad = [(None, "A", "lost", "lost", None), (200, "A", "twice b", "x", None), (200, "A", "twice a", "x", None)]
    index = S.add_documents(S.create_index(spark, path, FIELDS), spark.createDataFrame(first, KIND), "owner")
    index = S.add_documents(index, spark.createDataFrame(more + bad, KIND), "owner")
    index = S.delete_documents(index, spark.createDataFrame([(i,) for i in (0, 1, 45, 99, 5000)], "doc_id bigint"))
    index = S.add_documents(index, spark.createDataFrame([(1, "A", "drug again", None, None)], KIND), "owner")
    held = {d[0]: d for d in first} | {d[0]: d for d in more} | {200: (200, "A", "twice a", "x", None)}
    held = {i: d for i, d in held.items() if i not in (0, 1, 45, 99)} | {1: (1, "A", "drug again", None, None)}
    docs = list(held.values())
    assert S.totals(index, spark) == (len(docs), [sum(len(terms(d)[i]) for d in docs) for i in range(3)])
    assert index.failed == 2 and len(index.segments) == 3
    want = brute(docs, ASKED, 10)
    assert found(index, asked, 10) == want
    assert found(S.open_index(spark, path), asked, 10) == want
    small = S.compact(index, spark)
    row = S.statistics(small, spark).first()
    assert (row["n_docs"], row["failed"], row["deleted"], row["n_segments"]) == (len(docs), 2, 0, 1)
    assert row["n_postings"] == sum(len(set().union(*terms(d))) for d in docs)
    assert found(small, asked, 10) == want and found(index, asked, 10) == want
    assert sorted(r["doc_id"] for r in S.postings(small, spark).select("doc_id").distinct().collect()) == sorted(d[0] for d in docs if any(terms(d)))


def test_empty_index(spark, asked):
    index = S.create_index(spark, scratch_path(spark, "i"), FIELDS)
    assert found(index, asked, 5) == {} and S.statistics(index, spark).first()["n_docs"] == 0
    index = S.add_documents(index, spark.createDataFrame([], KIND), "owner")
    assert found(index, asked, 5) == {}
    assert S.delete_documents(index, spark.createDataFrame([(1,)], "doc_id bigint")) == index


def test_stems(spark):
    pool = ["studies", "series", "ponies", "zombeies", "aaies", "classes", "class", "bus", "buses", "shoes", "trees", "s", "ies", "es", "drugs", "x"]
    df = spark.createDataFrame([(w,) for w in pool], "w string").select("w", stem(F.col("w")).alias("s"))
    assert {r["w"]: r["s"] for r in df.collect()} == {w: stemmed(w) for w in pool}


def test_words_are_counted_where_the_texts_are(spark):
    docs = spark.createDataFrame([(i, "A", "t", "b b", ["n"]) for i in range(9)], KIND)
    plan = S._counted(docs, FIELDS, "owner", 9)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(doc_id" in plan  # texts are dealt once, and no word after them
    assert not re.search(r"Exchange hashpartitioning\([^)]*term", plan)


def test_an_index_of_many_groups_is_compacted_into_groups(spark, monkeypatch):
    monkeypatch.setattr(S, "GROUP_DOCS", 4)
    docs = [(i, "AB"[i % 2], f"t{i % 3}", f"b{i % 5} " * (1 + i % 7), None) for i in range(30)]
    frame = spark.createDataFrame(docs, KIND)
    index = S.create_index(spark, scratch_path(spark, "grouped"), FIELDS)
    index = S.add_documents(index, frame.filter("doc_id < 20"), "owner")
    index = S.delete_documents(S.add_documents(index, frame.filter("doc_id >= 20"), "owner"), frame.filter("doc_id % 6 = 0"))
    asked = spark.createDataFrame([(1, "t1 b4")], "query_id long, text string")
    before = sorted(map(tuple, S.search(index, asked).collect()))
    index = S.compact(index, spark)
    assert sorted(map(tuple, S.search(index, asked).collect())) == before
    assert [b["grp"] for b in index.parts(spark, "blocks")[0][1].select("grp").distinct().orderBy("grp").collect()] == list(range(7))


@pytest.mark.parametrize(("together", "small"), [(20_000, True), (20_000, False), (5, True)])
def test_a_block_is_dealt_once_however_many_ask_for_it(spark, monkeypatch, together, small):
    docs = [(i, "AB"[i % 2], f"t{i % 3}", "common " * (1 + i % 4) + f"b{i}", None) for i in range(30)]
    index = S.add_documents(S.create_index(spark, scratch_path(spark, "asked"), FIELDS), spark.createDataFrame(docs, KIND), "owner")
    queries = [(q, f"common b{q}", ["A"] if q % 2 else None) for q in range(20)]
    asked = spark.createDataFrame(queries, "query_id long, text string, schemas array<string>")
    monkeypatch.setattr(S, "ASKED_TOGETHER", together)
    monkeypatch.setattr(S, "fits", lambda df: small)
    dealt, kind = [], type(asked)
    deal = kind.repartition

    def counted(self, *to):
        if to == ("segment", "grp"):
            dealt.append(self.count())
        return deal(self, *to)

    monkeypatch.setattr(kind, "repartition", counted)
    found = {}
    for r in S.search(index, asked, 3).orderBy("rank").collect():
        found.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
    want = brute(docs, queries, 3)
    assert {q: [(d, pytest.approx(s, abs=2e-6)) for d, s in hits] for q, hits in want.items()} == found
    packs = 1 + 40 // together
    assert sum(dealt) <= packs + 20  # the common word's block, and one of each other word; 40 before


def test_blocks_are_put_together_where_the_texts_are(spark, asked, monkeypatch):
    monkeypatch.setattr(S, "GROUP_DOCS", 40)
    monkeypatch.setattr(S, "COUNTED_WORDS", 300)
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, "5")
    docs = corpus(random.Random(7), 0, 120)
    try:
        blocks = S._counted(spark.createDataFrame(docs, KIND), FIELDS, "owner", len(docs)).collect()
        index = S.add_documents(S.create_index(spark, scratch_path(spark, "i"), FIELDS), spark.createDataFrame(docs, KIND), "owner")
    finally:
        spark.conf.set(batch, before)
    assert len({(b["term"], b["grp"]) for b in blocks}) == len(blocks)  # whole, so no posting is shuffled by itself
    assert len({b["grp"] for b in blocks}) > 3  # groups of many words are several
    held = {d[0]: [Counter(t) for t in terms(d)] for d in docs}
    got = {}
    for b in blocks:
        assert [p["doc_id"] for p in b["postings"]] == sorted(p["doc_id"] for p in b["postings"]) and b["n"] == len(b["postings"])
        assert b["top"] == [max(p["tf"][i] for p in b["postings"]) for i in range(3)]
        assert b["low"] == [min(p["lens"][i] for p in b["postings"]) for i in range(3)]
        places = [p["schema"] for p in b["postings"] if p["schema"] is not None]
        assert (b["first_schema"], b["last_schema"]) == ((min(places), max(places)) if places else (None, None))
        for p in b["postings"]:
            got[p["doc_id"], b["term"]] = (p["tf"], p["lens"])
    assert got == {
        (d, t): ([c[t] for c in counts], [sum(c.values()) for c in counts]) for d, counts in held.items() for t in set().union(*counts)
    }
    assert found(index, asked, 10) == brute(docs, ASKED, 10)


def test_a_word_is_stemmed_alike_in_tasks(spark):
    ends = ["", "s", "es", "ies", "eies", "aies", "aes", "ees", "oes", "us", "ss", "y"]
    pool = [a + e + b for a in ("", "b", "éa", "9") for e in ends for b in ("", "s", "x")]
    df = spark.createDataFrame([(w,) for w in pool], "w string").select("w", stem(F.col("w")).alias("s"))
    assert {r["w"]: r["s"] for r in df.collect()} == {w: stem_word(w) for w in pool}
