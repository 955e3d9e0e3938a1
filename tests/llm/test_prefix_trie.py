"""The prefix trie against a plain version, with every screening outcome forced."""

import hashlib
import random
import sys
import zlib
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from starcard.llm import prefix_trie  # noqa: E402
from starcard.llm.queries import LLM_QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
KIND = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()


def plain(rows):
    """Sorted node rows, by walking every rebuilt conversation."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, digest(role or "", text or ""), len(brute.words(text))))
    own = {c: [(d, w) for _, _, d, w in sorted(ts)] for c, ts in own.items()}
    members, words = defaultdict(list), {(): 0}
    sequences = {}
    for c in own:
        h, base = zlib.crc32(str(c).encode()) % 4, c - (abs(c) % 20) * (1 if c >= 0 else -1)
        seq = own.get(base, [])[:h] + own[c][h:]
        sequences[c] = tuple(d for d, _ in seq)
        for d in range(len(seq) + 1):
            members[sequences[c][:d]].append(c)
            if d:
                words[sequences[c][:d]] = seq[d - 1][1]
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[c] for c in children[p]) or 1
        saved[p] = (len(members[p]) - 1) * words[p] + sum(saved[c] for c in children[p])
    out = []
    for p, own_members in members.items():
        ends = ",".join(str(c) for c in sorted(own_members) if sequences[c] == p)
        out.append((
            min(own_members), len(p), min(members[p[:-1]]) if p else None, len(own_members), len(children[p]), leaves[p], saved[p],
            hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def awkward():
    rng = random.Random(11)
    turns = [("user", "hi there"), ("assistant", "hello"), ("user", "a b\tc"), ("system", ""), (None, None), ("", "ß é"), ("user", "x " * 3000)]
    rows = []
    for c in [*range(0, 90, 1), *range(400, 460), -3, -20, -25, 10**15 + 7]:
        if c % 13 == 5 and c % 20:
            continue
        kind = rng.random()
        seq = turns[:1] * 3 + turns[1:4] if kind < 0.4 else rng.choices(turns, k=rng.randint(1, 9))
        rows += [(c, i if rng.random() < 0.95 else None, r, t) for i, (r, t) in enumerate(seq)]
    rows += [(25, 1, "user", "only"), (45, 0, "user", "one"), (45, 0, "user", "one"), (None, 1, "user", "lost")]
    rows += [(500, i, "user", f"turn {i // 3}") for i in range(400)] + [(501, i, "user", f"turn {i // 3}") for i in range(399)]
    return rows


@pytest.fixture(scope="module")
def talks(spark):
    df = spark.createDataFrame(awkward(), KIND).repartition(5)
    return df.withColumn("depth", F.lit("clash")).withColumn("a", F.lit(1)).withColumn("_seg", F.lit(None).cast("int"))


def test_trie(spark, talks):
    assert found(prefix_trie.conversation_trie(talks)) == plain(awkward())


@pytest.mark.parametrize("block", [8, 256])
def test_trie_whatever_the_sketch_proves(spark, talks, block, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)  # far too few counters: singletons look shared, also below proven ones
    monkeypatch.setattr(prefix_trie, "BLOCKS", (1, 1))
    monkeypatch.setattr(prefix_trie, "BLOB", 20)
    monkeypatch.setattr(prefix_trie, "SLOTS", 50)
    assert found(prefix_trie.conversation_trie(talks)) == plain(awkward())


def test_the_sketch_proves_most_singletons_and_never_a_shared_prefix(spark, talks):
    turns, _ = prefix_trie.rebuilt(talks)
    rows = prefix_trie.prefixes(turns).cache()
    flagged = prefix_trie.screened(rows).toPandas()
    many = flagged.groupby(["a", "b"])["conv_id"].transform("count")
    assert flagged.loc[many > 1, "shared"].all()
    assert (~flagged.loc[many == 1, "shared"]).mean() > 0.95


def test_query_equals_the_plain_version(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(LLM_QUERIES["op13_conversation_prefix_trie"](spark, SF)) == plain(rows)


def test_hot_end_and_copies(spark):
    rows = [(c, i, "user", f"t{i}") for c in range(0, 3000, 20) for i in range(3)] + [(c, 0, "user", "t0") for c in range(3000, 3400)]
    assert found(prefix_trie.conversation_trie(spark.createDataFrame(rows, KIND))) == plain(rows)


def test_empty_and_turnless(spark):
    assert prefix_trie.conversation_trie(spark.createDataFrame([], KIND)).collect() == []
    assert prefix_trie.conversation_trie(spark.createDataFrame([(None, 1, "user", "x")], KIND)).collect() == []
    lone = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(lone, 0, "user", "x")]
    assert found(prefix_trie.conversation_trie(spark.createDataFrame(rows, KIND))) == plain(rows) == [
        (lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())
    ]
