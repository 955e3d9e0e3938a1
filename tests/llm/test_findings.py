"""The whole job of stages and operators, each case one that a shortcut of theirs once missed."""

import random
import string
import sys
import tracemalloc
from itertools import combinations
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402
import numpy as np  # noqa: E402
import pandas as pd  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from starcard.llm import deleted_interpolation, language_id, line_dedup, mixing, secrets, stages  # noqa: E402

SF = "/root/testdata/sf0.01"
KIND = "doc_id long, text string"


def edited(rng, words, share):
    return [rng.choice(words) + "x" if rng.random() < share else w for w in words]


def test_one_document_of_each_near_group_stays(spark):
    rng = random.Random(4)
    plain = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    for i in range(40):
        words = [f"w{rng.randint(0, 3000)}" for _ in range(rng.randint(40, 400))]
        plain += [(10_000 + 10 * i + k, " ".join(edited(rng, words, share))) for k, share in enumerate((0, 0.01, 0.02, 0.05))]
    plain += [(90_000, ""), (90_001, None), (90_002, "one two"), (90_003, "One\ttwo")]
    ids = {i: c for i, _, c in brute.near(plain)}
    kept = [r["doc_id"] for r in stages.one_per_near_group(spark.createDataFrame(plain, KIND)).collect()]
    assert sorted(kept) == sorted(i for i, c in ids.items() if i == c)


def test_near_groups_of_odd_ids_lose_no_text(spark):
    a, b, c = ("alpha beta gamma delta " * 9, "one two three four five " * 8, "x y z u v w " * 7)
    rows = [(None, a, {"k": 1}), (None, b, None), (None, b, None), (1, a, None), (1, c, {"k": 2}), (1, c, {"k": 2}), (2, c, None), (None, "lone words stand here alone now", None)]
    df = spark.createDataFrame(rows, KIND + ", tags map<string, int>").withColumn("_key", F.lit("mine")).withColumn("fp", F.lit(1))
    kept = stages.one_per_near_group(df)
    assert kept.columns == df.columns
    found = sorted(((r["doc_id"] or 0, r["text"], r["tags"], r["_key"]) for r in kept.collect()), key=str)
    assert found == sorted([(1, a, None, "mine"), (0, b, None, "mine"), (1, c, {"k": 2}, "mine"), (0, "lone words stand here alone now", None, "mine")], key=str)
    assert stages.one_per_near_group(df.limit(0)).collect() == []


def test_clashing_names_pass_through(spark):
    labels = spark.createDataFrame([(1, "clean"), (2, "toxic"), (3, "clean")], "doc_id long, domain string")
    rows = [(1, "a good text\nsame", "en", 9, "m1"), (2, "a bad bad text\nsame", "en", 9, "m2"), (3, "another good text", "en", 9, "m3"), (None, None, None, None, "m4")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long, _d string")
    for c in ("_t", "_w", "_lines", "_member", "_id", "_label", "_rate", "_mix", "_copy", "_likeliest", "domain"):
        df = df.withColumn(c, F.col("_d"))
    for done in (stages.without_repeated_lines(df), stages.mixed_keeping_clean(df, labels)):
        assert done.columns == df.columns
        for r in done.collect():
            assert {r[c] for c in df.columns[4:]} == {f"m{r['doc_id'] or 4}"}
    assert stages.without_repeated_lines(df.limit(0)).collect() == stages.mixed_keeping_clean(df.limit(0), labels).collect() == []


def test_mixing_of_an_empty_table_and_odd_rows(spark):
    labels = spark.createDataFrame([(1, "clean"), (2, "rough"), (None, "clean"), (3, None)], "doc_id long, domain string")
    df = spark.createDataFrame([(None, None), (None, "a b"), (1, "a b"), (1, "a b"), (2, "c d e")], KIND).withColumn("_member", F.lit(1))
    rated, model = mixing.mix(df, labels, {"clean": 0.5, "rough": 0.5})
    assert rated.count() == 5 and set(model.reached) == {"clean", "rough"} and rated.columns[:-1] == df.columns
    assert mixing.mix(df.limit(0), labels, {"clean": 1.0})[0].collect() == []


def test_novel_secrets_of_any_length_copied_or_beside_the_word(spark):
    rng = random.Random(6)
    alphabets = ["0123456789ABCDEF", string.ascii_uppercase + "234567", string.ascii_lowercase + string.digits, string.ascii_letters + string.digits + "+/"]
    keys = ["".join(rng.choices(a, k=n)) for a in alphabets for n in (20, 40, 64, 128, 200, 1024) for _ in range(5)]
    plain = [(i, f"the api key is {k} here") for i, k in enumerate(keys)]
    key = "q7Zx91LmPp0aVt3RkW82nBc5Yd"
    plain += [(1000, f"{key} is the api key"), (1001, f"private key\n{key}"), (1002, f"{key}\nfor the bearer"), (1003, f"{key} a\n\n\nprivate key")]
    plain += [(1004, f"credential {key} or {key}"), (1005, "the secret way is " + "abcdefgh1" * 20)]
    found = {r["doc_id"]: r["n_novel"] for r in secrets.scan(spark.createDataFrame(plain, KIND)).collect()}
    assert all(found[i] == 1 for i in range(len(keys)))
    assert [found[i] for i in range(1000, 1006)] == [1, 1, 1, 0, 2, 0]


def test_short_repeated_lines_go(spark):
    rng = random.Random(8)
    pool = ["", " \t", "}", "Home", "Released under the MIT License."] + [f"own line {i}" for i in range(200)]
    plain = [(i, "\n".join(rng.choices(pool, [9, 5, 5, 5, 5] + [1] * 200, k=rng.randint(1, 25)))) for i in range(60)]
    found = {r["doc_id"]: r["kept_text"].split("\n") for r in line_dedup.line_report(spark.createDataFrame(plain, KIND)).collect()}
    kept = [x for i in sorted(found) for x in found[i] if x.strip()]
    assert sorted(kept) == sorted({x for _, t in plain for x in t.split("\n") if x.strip()})
    bare = [(i, "\n".join(x if x.strip() else "" for x in t.split("\n"))) for i, t in plain]
    found = line_dedup.line_report(spark.createDataFrame(bare, KIND))
    assert {r["doc_id"]: r["kept_text"] for r in found.collect()} == brute.lines(bare, 1)


def test_ngrams_count_words_beyond_the_list_and_slots_are_shared(spark):
    df = spark.createDataFrame([("the the thing qzjv", "en"), ("the", "en"), ("der schnee", "de"), ("un", "xx")], "text string, lang string")
    small = language_id.fit(df, words=3)
    assert len(small.words) <= 3 and {"qzjv", "^sch", "nee$"} <= set(small.grams)
    assert language_id._shares({"big": 100, "small": 3, "mid": 9}, 30) == {"small": 3, "mid": 9, "big": 18}


def test_foreign_and_noise_texts_go(spark):
    rng = random.Random(2)
    df = spark.read.parquet(f"{SF}/documents.parquet")
    foreign = [
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw",
        "Minden emberi lény szabadon születik és egyenlő méltósága és joga van", "漢字 仮名", "xkcdq zzgh wrtpl qqx",
        " ".join("".join(rng.choices(string.ascii_lowercase, k=6)) for _ in range(30)),
    ]
    schema = df.select("doc_id", "text", "lang", "source", "n_chars").schema
    odd = [(90_000 + i, t, None, "x", len(t)) for i, t in enumerate(foreign)]
    clean = [(91_000, "The and of", None, "x", 10), (91_001, "der und ich", None, "x", 11)]
    kept = stages.keep_known_languages(df.select(schema.names).unionByName(spark.createDataFrame(odd + clean, schema)))
    assert {r["doc_id"] for r in kept.filter("doc_id >= 90000").collect()} == {91_000, 91_001}
    assert kept.filter("doc_id < 90000").count() == df.count()


def test_mixing_keeps_all_clean_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    labels = mixing.label_domains(spark.read.parquet(f"{SF}/labels.parquet"))
    label = {r["doc_id"]: r["domain"] for r in labels.dropna().collect()}
    # 95 % clean: of the documents that aren't labelled clean only every twentieth
    most = df.join(labels.filter("domain = 'clean'").select("doc_id"), "doc_id", "left_semi").select(df.columns)
    most = most.unionByName(df.join(labels.filter("domain <> 'clean'").select("doc_id"), "doc_id", "left_semi").filter("doc_id % 6 = 0").select(df.columns))
    for docs in (df, most):
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        kept = {r["doc_id"] for r in stages.mixed_keeping_clean(docs, labels).select("doc_id").distinct().collect()}
        assert {i for i in ids if label.get(i) in ("clean", "rough")} <= kept
        assert not {i for i in kept if label.get(i) == "toxic"}
    rated, _ = mixing.mix_keeping(df, labels, "clean", "toxic")
    sums = rated.agg(F.sum("_mix.tokens"), F.sum(F.col("_mix.tokens") * F.col("_mix.rate"))).first()
    assert abs(sums[1] / sums[0] - 1) < 1e-6


def test_cells_of_a_batch_are_counted_within_few_arrays():
    rng = np.random.default_rng(1)
    columns = [rng.integers(0, 20, 200_000), -rng.integers(0, 60, 200_000), np.where(rng.random(200_000) < 0.3, deleted_interpolation.NEVER, 0)]
    tracemalloc.start()
    cells = deleted_interpolation.count_cells(columns, ["bucket", "q1", "q2"])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    plain = pd.DataFrame(dict(zip(["bucket", "q1", "q2"], columns, strict=True))).groupby(["bucket", "q1", "q2"], as_index=False).size()
    assert sorted(map(tuple, cells.to_numpy())) == sorted(map(tuple, plain.to_numpy()))
    assert peak < 9 * columns[0].nbytes
    assert deleted_interpolation.count_cells([np.zeros(0, np.int64)] * 2, ["bucket", "q1"]).empty
