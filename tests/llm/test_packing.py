"""Packing against the library's ids, and its balance against a plain version."""

import random
import sys
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

from starcard.llm import packing  # noqa: E402
from starcard.llm.queries import LLM_QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
KIND = "doc_id long, text string"


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tokenizers

    return tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check(rows, texts, library, capacity=2048):
    """Every id in one piece, right checksums, sequences gapless and without padding."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"], r["sequence_tokens"]))
    assert sorted(pieces) == sorted(texts)
    for doc, own in pieces.items():
        ids, at = np.array([*library.encode(texts[doc] or "", add_special_tokens=False).ids, 1], "<u4"), 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["length"] > 0
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for offset, length, tokens in sorted(own):
            assert offset == at
            at += length
        assert at == tokens <= capacity and at & (at - 1) == 0
    return sequences


def awkward():
    rng = random.Random(3)
    words = ["alpha", "Über", "naïve", "漢字", "don't", "12", "x" * 70, "<|endoftext|>", " ", "…", "\U0001f600"]
    texts = {i: rng.choice([" ", "\n", "  ", "\t"]).join(rng.choices(words, k=rng.randint(0, 60))) for i in range(150)}
    long = " ".join(rng.choices(words, k=80_000))
    return texts | {200: "", 201: None, 202: long, 203: " " * 300_000 + "a", 204: "z" * 200_000, 205: long, -4: " \n" * 50_000, 206: "a b"}


def test_every_id_in_one_piece(spark, library):
    texts = awkward()
    df = spark.createDataFrame(list(texts.items()), KIND).withColumn("length", F.lit("clash")).withColumn("start", F.lit(None).cast("int"))
    for parts, group in ((1, 1 << 22), (5, 10_000)):
        rows = packing.pack_documents(df.repartition(parts), group_tokens=group).collect()
        found = check(rows, texts, library)
        short = sum(1 for own in found.values() if own[0][2] < 2048)
        assert short <= 11 * parts


def test_query_covers_all_documents(spark, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    check(LLM_QUERIES["op12_cost_balanced_packing"](spark, SF).collect(), texts, library)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(None, None), (None, "a b"), (1, "a b"), (1, "a b"), (2, "")], KIND)
    rows = packing.pack_documents(df.coalesce(1)).collect()
    assert sorted((r["doc_id"] or 0, r["length"]) for r in rows if r["doc_tokens"] == r["length"])[:2] == [(0, 1), (0, 3)]
    assert sum(r["length"] for r in rows) == 3 * 3 + 2
    assert packing.pack_documents(spark.createDataFrame([], KIND)).collect() == []


def plain(lengths, rooms):
    """The rule as told: whole where there is room at the lowest cost, else cut."""
    left, cost, out, items = list(rooms), [0.0] * len(rooms), [], sorted(((-n, i) for i, n in enumerate(lengths)))
    while items:
        n, i = -items[0][0], items[0][1]
        items = items[1:]
        fit = [k for k in range(len(left)) if left[k].bit_length() > n.bit_length()]
        for bits in {left[k].bit_length() for k in range(len(left))} & {n.bit_length()}:
            first = min((k for k in range(len(left)) if left[k].bit_length() == bits), key=lambda k: (cost[k], k))
            fit += [first] if left[first] >= n else []
        most = max((x.bit_length() for x in left), default=0)
        fit = fit or [k for k in range(len(left)) if left[k].bit_length() == most and left[k]]
        if not fit:
            out.append((i, n, None))
            continue
        k = min(fit, key=lambda k: (cost[k], k))
        take = min(n, left[k])
        left[k] -= take
        cost[k] += take + take * take / 6144
        out.append((i, take, k))
        if take < n:
            items = sorted([*items, (take - n, i)])
    return out, cost


def test_assignment_follows_the_rule_and_balances():
    rng = random.Random(1)
    for _ in range(30):
        lengths = [rng.choice([rng.randint(1, 2047), rng.randint(1, 90)]) for _ in range(rng.randint(0, 80))]
        many, rest = divmod(sum(lengths), 2048)
        rooms = [2048] * many + ([1 << b for b in range(11) if rest >> b & 1] if rng.random() < 0.7 else [])
        placed, over, cost = packing.assign(lengths, rooms)
        want, want_cost = plain(lengths, rooms)
        assert sorted((i, n, k) for i, _, n, k, _ in placed) == sorted(x for x in want if x[2] is not None)
        assert sorted((i, n) for i, _, n in over) == sorted((i, n) for i, n, k in want if k is None)
        assert cost == pytest.approx(want_cost)
    lengths = [min(700, int(rng.lognormvariate(5, 1))) for _ in range(4000)]  # longer ones dominate their sequence whatever is done
    rooms = [2048] * (sum(lengths) // 2048)
    placed, _, cost = packing.assign(lengths, rooms)
    filled, dealt = [0] * len(rooms), [0.0] * len(rooms)
    for n in lengths:  # first fit in the order given
        k = next((k for k in range(len(rooms)) if filled[k] + n <= 2048), None)
        if k is not None:
            filled[k] += n
            dealt[k] += n + n * n / 6144
    assert np.std(cost) < 0.5 * np.std(dealt) and len(placed) < 1.1 * len(lengths)


def test_both_libraries_agree(library):
    codes = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000][::7]
    texts = [f"a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)}2  {chr(c)}\n{chr(c)}.{chr(c)}" for c in codes]
    encoder = packing.Encoder()
    for text, known in zip(texts, library.encode_batch_fast(texts, add_special_tokens=False), strict=True):
        assert encoder.ids(text).tolist() == known.ids
