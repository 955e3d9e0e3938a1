"""The training-data operators against plain versions, on small tables with the awkward cases."""

import random
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from starcard.llm import deleted_interpolation, exact_dedup, language_id, line_dedup, mixing, secrets, sentencepieces, simhash, sketches, stages, suffix_dedup  # noqa: E402,E501
from starcard.llm.common import largest  # noqa: E402
from starcard.llm.components import components  # noqa: E402
from starcard.llm.queries import LLM_CHECKS, LLM_QUERIES  # noqa: E402
from starcard.llm.run_index import RunIndex  # noqa: E402

SF = "/root/testdata/sf0.001"
KIND = "doc_id long, text string"


@pytest.fixture(scope="module")
def real(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def awkward():
    """Copies, near copies, shared passages, empty and long texts, zero bytes, letters beyond ASCII."""
    rng = random.Random(7)
    pool = ["alpha", "Beta", "gamma", "délta", "ß", "İstanbul", "z\0z", "ſecret", "omega,", "nine"] + [f"w{i}" for i in range(40)]
    passages = [" ".join(rng.choices(pool, k=rng.randint(15, 60))) for _ in range(12)]
    docs = []
    for i in range(60):
        parts = [rng.choice(passages) if rng.random() < 0.6 else " ".join(rng.choices(pool, k=rng.randint(1, 30))) for _ in range(rng.randint(1, 4))]
        docs.append((i, rng.choice([" ", "\n", "\t\n "]).join(parts)))
    docs += [(100, docs[3][1]), (101, docs[3][1].translate({v: k for k, v in brute.FOLD.items()})), (102, docs[5][1] + " tail"), (103, ""), (104, " \n\t"), (105, None)]
    docs += [(106, "a" * 300), (107, "ab" * 200), (108, " ".join(rng.choices(pool, k=9000))), (110, "one"), (109, "one"), (-5, docs[9][1])]
    return docs


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), KIND).withColumn("h1", F.lit("clash")).withColumn("share", F.lit(1)).withColumn("line", F.lit(None).cast("int"))


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_run_index_against_search():
    rng = random.Random(5)
    for _ in range(60):
        depth, alphabet = rng.choice([3, 5, 17]), rng.choice([b"ab", b"abc", b"\xff\x01a"])
        strings = [bytes(rng.choices(alphabet, k=rng.randint(0, depth + 40))) for _ in range(rng.randint(1, 40))]
        owners = np.sort(np.array([rng.randint(0, 12) for _ in strings], np.uint64))
        for i, mask in enumerate(RunIndex(strings, owners, depth).earlier().tolist()):
            for j in range(len(strings[i]) - depth + 1):
                known = any(o < owners[i] and strings[i][j : j + depth] in s for s, o in zip(strings, owners, strict=True))
                assert bool(mask >> j & 1) == known


@pytest.mark.parametrize("batch", [3000, 10**7])
def test_suffix_dedup(spark, docs, batch):
    found = suffix_dedup.remove_repeats(docs, batch_chars=batch)
    assert rows(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.repeats(awkward())


def test_suffix_dedup_of_repeated_rows_and_null_ids(spark):
    text = "x" * 20 + "".join(map(str, range(60)))
    df = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text)], KIND)
    removed = {(r["doc_id"], r["n_removed"]) for r in suffix_dedup.remove_repeats(df).collect()}
    assert removed == {(1, 0), (2, len(text)), (None, len(text))}


def test_simhash(spark, docs):
    assert rows(simhash.near_groups(docs), "doc_id", "fingerprint", "component_id") == brute.near(awkward())


def test_simhash_of_real_documents_and_cut_cells(spark, real):
    df = spark.createDataFrame(real, KIND)
    want = brute.near(real)
    assert rows(simhash.near_groups(df, block=4), "doc_id", "fingerprint", "component_id") == want


def test_simhash_links_all_within_the_radius(spark):
    rng = random.Random(3)
    values = [rng.getrandbits(64) for _ in range(60)]
    values += [v ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))) for v in values for _ in range(4)]
    signed = sorted({v - (1 << 64) if v >> 63 else v for v in values})
    found = components(simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), block=2))
    root = {r["node"]: r["root"] for r in found.collect()}
    for a in signed:
        for b in signed:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4:
                assert root.get(a, a) == root.get(b, b)
    groups = {}
    for v in signed:
        groups.setdefault(root.get(v, v), []).append(v)
    for members in groups.values():
        assert len(members) == 1 or all(any(a != b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 4 for b in members) for a in members)


def test_exact_dedup(spark, docs):
    plain = {}
    for i, t in awkward():
        plain.setdefault((t or "").translate(brute.FOLD), []).append(i)
    want = sorted((i, max(ids), len(ids), i == max(ids), brute.sha(t)) for t, ids in plain.items() for i in ids)
    assert rows(exact_dedup.exact_groups(docs, chunk=64), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == want


def test_exact_dedup_tells_collisions_apart(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "cd"), (3, "AB"), (4, "zz"), (5, "cd")], KIND)
    weak = {"primes": (1, 1), "bases": (1, 1)}  # every text of a length collides
    found = exact_dedup.exact_groups(df, hasher_args=weak)
    assert rows(found, "doc_id", "keep_id", "group_size", "kept") == [(1, 3, 2, False), (2, 5, 2, False), (3, 3, 2, True), (4, 4, 1, True), (5, 5, 2, True)]


def test_fingerprints_of_parts_combine(spark):
    rng = random.Random(1)
    data = bytes(rng.choices(range(97, 123), k=5000))
    whole = exact_dedup.Hasher().whole(data)
    cuts = sorted(rng.sample(range(5000), 7))
    spans = list(zip([0, *cuts], [*cuts, 5000], strict=True))
    for chunk in (16, 1000):
        assert exact_dedup.Hasher(chunk=chunk).whole(data) == whole
    df = spark.createDataFrame([(1, data[a:b].decode(), 5000 - b) for a, b in spans], "doc long, text string, after long")
    got = exact_dedup.combine_parts(df.withColumn("f", exact_dedup.fingerprint(F.col("text"))), "doc", "after").first()
    assert (got["h1"], got["h2"], got["n"]) == whole


@pytest.mark.parametrize("order", [2, 3])
def test_language_model(spark, docs, order):
    found = deleted_interpolation.score_corpus(docs, order=order, batch_chars=20000).collect()
    want = brute.unigrams(awkward())
    assert len(found) == len(want)
    for r in found:
        held, n, known, total, base = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total)
        assert r["base_score"] == pytest.approx(base, abs=1e-8)
        assert r["score"] < 0


def test_language_model_is_a_distribution_and_beats_unigrams(spark, real):
    found = deleted_interpolation.score_corpus(spark.createDataFrame(real, KIND)).toPandas()
    held = found[found["held_out"]]
    assert held["score"].sum() > held["base_score"].sum()
    # over all words of a tiny closed vocabulary the probabilities of one-word texts and the end add up
    tiny = [(i, t) for i, t in enumerate(["a b a", "b a", "a", "b b", "a b", "a a b"])]
    texts = [(100 + i, t) for i, t in enumerate(["a", "b"])]
    learnt = deleted_interpolation.score_corpus(spark.createDataFrame(tiny + texts, KIND), folds=100, held_out=99)
    p = {r["doc_id"]: 10 ** r["score"] for r in learnt.collect()}
    assert p[100] + p[101] < 1


def test_sketches(spark, docs):
    order = sorted(awkward(), key=lambda d: (-d[0], d[1] or ""))
    texts = [t or "" for _, t in order]
    found = {r["doc_id"]: r for r in sketches.fingerprint_edits(docs).collect()}
    assert len(found) == len(texts)
    for (i, _), t, after in zip(order, texts, texts[1:] + texts[:1], strict=True):
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        r = found[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), brute.sha(edited))
        own = brute.shingles(t)
        exact = len(own | brute.shingles(edited)) <= sketches.K
        assert r["near_edited"] == pytest.approx(brute.jaccard(own, brute.shingles(edited)), abs=1e-9 if exact else 0.2)
        exact = len(own | brute.shingles(after)) <= sketches.K
        assert r["near_next"] == pytest.approx(brute.jaccard(own, brute.shingles(after)), abs=1e-9 if exact else 0.2)
    assert found[3]["fingerprint"] == found[100]["fingerprint"] == found[101]["fingerprint"]


def test_sketches_merge_and_stay_native(spark, docs):
    parts = spark.createDataFrame([(1, "a b c d e f"), (1, "b c d e f g"), (2, "")], "doc long, text string")
    merged = {r["doc"]: r["sketch"] for r in sketches.merge_parts(parts.select("doc", sketches.sketch(F.col("text")).alias("sketch")), "doc").collect()}
    assert merged == {1: merged[1]} and len(merged[1]) == 3
    plan = sketches.fingerprint_edits(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("least", [20, 60])
def test_line_dedup(spark, least):
    rng = random.Random(3)
    pool = ["a" * 3, "b" * 5, "", "c" * 12, "d" * 41, "e"] + [f"line {i}" for i in range(30)]
    plain = [(i, "\n".join(rng.choices(pool, k=rng.randint(1, 25)))) for i in range(80)]
    plain += [(200, plain[3][1]), (201, plain[4][1] + "\nfoo"), (202, ""), (203, "\n" * 30)]
    found = line_dedup.line_report(spark.createDataFrame(plain, KIND).withColumn("d", F.lit(0)), least)
    assert {r["doc_id"]: r["kept_text"] for r in found.collect()} == brute.lines(plain, least)


def test_line_dedup_of_repeated_rows_and_nulls(spark):
    long = "x" * 50
    df = spark.createDataFrame([(1, long), (1, long), (2, long + "\nnew"), (None, long), (3, None)], KIND)
    assert rows(line_dedup.line_report(df).fillna(99, ["doc_id"]), "doc_id", "kept_text") == [(1, long), (1, long), (2, "new"), (3, ""), (99, "")]


def test_secrets(spark, docs):
    planted = [
        (1000, 'é PASSWORD = "hunter22" and tokens: abc'), (1001, "AKIA" + "Z9" * 9 + " AKIA12"), (1002, "x" + "0123456789abcdef" * 2),
        (1003, "Kelvin toKen = abcdefgh"), (1004, "api key is q7Zx91LmPp0aVt3RkW82nB with that"), (1005, "token: " + "a" * 5),
        (1006, "the secret path is thethethethethethethe12 here the the"),
    ]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(planted, KIND))
    found = {r["doc_id"]: r for r in secrets.scan(df).collect()}
    for i, t in awkward() + planted:
        spans, n = brute.secrets(t)
        r = found[i]
        assert r["base_sha256"] == brute.sha(spans)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == (n["assign"], n["access"], n["hex"])
    assert found[1004]["spans"].startswith("novel:") and found[1006]["n_novel"] == 0
    assert all(found[i]["n_novel"] == 0 for i, _ in awkward())


def test_language_id(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    found = language_id.identify(df)
    joined = found.join(df.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert joined.filter("lang = lang_pred").count() >= 0.97 * joined.count() > 0
    odd = spark.createDataFrame([(1, None, "en"), (2, "12 34", "en"), (3, "the of and", None), (4, "", "de"), (None, "the and", "en")], KIND + ", lang string")
    got = {r["doc_id"]: r for r in language_id.identify(odd).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 4)] == ["und"] * 3 and got[1]["score"] == 0.0
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_id_backs_off(spark):
    df = spark.createDataFrame([("the thing thinks", "en"), ("der schnee schmilzt", "de")] * 3, "text string, lang string")
    model = language_id.fit(df)
    (a, *_), (b, *_), (_, even, fit) = language_id.Reader(model).judge(["thinking", "schneemann", "漢字"])
    assert (a, b) == ("en", "de") and even == pytest.approx(0.5) and fit == 0.0


def test_pieces_equal_the_library(spark, docs):
    import sentencepiece

    known = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.MODEL)
    fst = sentencepieces.Transducer(**sentencepieces.read_model(sentencepieces.MODEL))
    rng = random.Random(1)
    pool = ["a", "e", "t", "th", "in", " ", "  ", "    ", "\n", "é", "你", "𝔘", ".", "0", "A", "<0x0A>", "</s>", "▁", "\0"]
    for _ in range(3000):
        text = "".join(rng.choices(pool, k=rng.randint(0, 14)))
        assert fst.encode(text).tolist() == known.encode(text)
        assert fst.decode(fst.encode(text)) == text.replace("▁", " ")
    for r in sentencepieces.round_trip(docs).collect():
        text = dict(awkward())[r["doc_id"]] or ""
        assert list(r["ids"]) == known.encode(text) and r["exact"] and r["decoded_sha256"] == brute.sha(text)


def test_unigram_models_take_the_cheapest_path():
    pieces = ["<unk>", "a", "b", "ab", "abb", "▁"]
    fst = sentencepieces.Transducer(False, False, pieces, [0, -1.0, -1.0, -1.5, -4.0, -1.0], [2, 1, 1, 1, 1, 1])
    assert dict(fst.paths(["abb", "acb", "ab"])) == {"abb": [3, 2], "acb": [1, 0, 2], "ab": [3]}


def test_mixing_meets_targets(spark):
    df, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    weights = {"clean": 0.8, "rough": 0.2, "toxic": 0.0}
    rated, model = mixing.mix(df, mixing.label_domains(labels), weights)
    found = rated.select("_mix.*").toPandas()
    got = (np.stack(found["p"]) * (found["tokens"] * found["rate"]).to_numpy()[:, None]).sum(axis=0)
    want = np.array([weights[d] for d in model.domains]) * found["tokens"].sum()
    assert (found["rate"] >= 0).all() and np.abs(got - want).sum() < 0.05 * want.sum()
    assert abs(found["copies"].mean() - found["rate"].mean()) < 0.15
    assert rated.columns[:-1] == df.columns


def test_mixing_without_labels_keeps_all(spark, docs):
    none = spark.createDataFrame([], "doc_id long, domain string")
    rated, model = mixing.mix(docs, none, {"clean": 1.0})
    assert model.domains == [] and rated.filter("_mix.rate <> 1 OR _mix.copies <> 1").count() == 0


def test_largest(spark):
    df = spark.createDataFrame([(str(i), float(i)) for i in range(1000)], "item string, v double")
    kept = [r["v"] for r in largest(df, "v", "item", 100).collect()]
    assert 60 <= len(kept) <= 130 and min(kept) > 850
    assert largest(df, "v", "item", 5000).count() == 999


EMPTY = {
    "op1": lambda d: suffix_dedup.remove_repeats(d), "op2": lambda d: simhash.near_groups(d), "op3": lambda d: exact_dedup.exact_groups(d),
    "op4": lambda d: deleted_interpolation.score_corpus(d), "op5": lambda d: sketches.fingerprint_edits(d), "op6": lambda d: line_dedup.line_report(d),
    "op8": lambda d: secrets.scan(d), "op9": lambda d: language_id.identify(d), "op10": lambda d: sentencepieces.round_trip(d),
}


@pytest.mark.parametrize("op", EMPTY)
def test_empty_tables(spark, op):
    df = spark.createDataFrame([], KIND + ", lang string")
    assert EMPTY[op](df).collect() == []


@pytest.mark.parametrize("op", EMPTY)
def test_nulls_and_repeated_rows(spark, op):
    df = spark.createDataFrame([(None, None, None), (None, "a b", "en"), (1, "a b", None), (1, "a b", "en"), (2, None, "de")], KIND + ", lang string")
    assert len(EMPTY[op](df).collect()) == 5


def test_stages_keep_columns_and_clean_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    junk = spark.createDataFrame([(9001, "1234 5678 !!", None, "x", 12), (9002, None, None, "x", 0)], df.schema)
    kept = stages.keep_known_languages(df.unionByName(junk))
    assert kept.columns == df.columns and kept.count() == df.count()
    near = stages.one_per_near_group(df)
    want = {i for i, _, c in brute.near([tuple(r) for r in df.select("doc_id", "text").collect()]) if i == c}
    assert near.columns == df.columns and {r["doc_id"] for r in near.collect()} == want
    fewer = stages.without_repeated_lines(df)
    assert fewer.columns == df.columns and fewer.filter("n_chars <> length(text)").count() == 0


def test_pipeline(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "source_mixing", "sentencepiece"]
    done = corpus_pipeline.run(spark, SF)
    assert set(df.columns) < set(done.columns)
    assert 0 < done.select("doc_id").distinct().count() <= df.count() and done.filter("NOT round_trip").count() == 0


def test_registered_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in LLM_QUERIES) == list(range(1, 14))
    assert set(LLM_CHECKS) <= set(LLM_QUERIES)
