"""Prefix trie of conversations: which share their first turns, and how many tokens storing shared turns once saves.

A prefix is named by a digest: the sum, over its turns, of 120 bits of a SHA-256 of place and turn. Sums run along a conversation
by range segments, so a conversation of any length is spread out, and a parent's digest is the sum without the last turn.

A count-min sketch of all digests screens them. An estimate of one proves that a prefix belongs to one conversation alone: its node, and
every node below, is emitted where the row is, with no shuffle (the first of such a tail asks its parent, one row a conversation).
Only prefixes that may be shared are grouped exactly. The estimate only has to tell one from more, so of each counter one bit
travels to the tasks: whether it exceeds one.

Sums over subtrees take log2(depth) rounds of pointer doubling on the nodes that may be shared. The SHA-256 of the ids that end at a node
runs over blobs of sorted ids, streamed, so a node where a third of all conversations end needs no list of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starcard.llm.common import SPACE
from starcard.operators.segments import SEG, running_sums, spread_join
from starcard.session import stored

#: Rows of the sketch, counters in a block, and the least and most blocks in a row: 3 x 2^28 bits are 96 MB, of use up to some 10^8
#: prefixes. With more of them fewer singletons are proven and more prefixes are grouped, with the same result.
HASHES, BLOCK, BLOCKS = 3, 1 << 16, (1, 1 << 12)
#: Counters to a prefix; at 8 a singleton stays unproven one time in 500.
ROOM = 8
#: Slots that a task gathers before it sends them off, and characters in a blob of ids.
SLOTS, BLOB = 1 << 21, 1 << 20
MODULUS = 1 << 60
NODE = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
)
_EMPTY = hashlib.sha256(b"").hexdigest()


def turn_digest(role: Column, text: Column) -> Column:
    """SHA-256 of role and text; null counts as empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)


def ranked_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, rank, turn_hash, words, _seg): turns in order, a null turn first, turns of one number by their digest.

    Rows without a conv_id belong to no conversation and go.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    narrow = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        turn_digest(F.col("role").cast("string"), text).alias("turn_hash"),
        F.regexp_count(text, F.lit(f"[^{SPACE}]+")).cast("long").alias("words"),
        F.monotonically_increasing_id().alias("row"),
    )
    ranked = running_sums(narrow, "conv_id", ["turn", "turn_hash", "row"], {"rank": F.lit(1)}, keep_segment=True)
    return ranked.select("conv_id", F.col("rank").cast("long"), "turn_hash", "words", SEG)


def rebuilt(conversations: DataFrame, family: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Turns and members of the rebuilt conversations.

    Conversation c takes its first h turns from conversation c - c % ``family`` (the remainder has the sign of c, as in SQL) and goes on
    with its own turns after its first h; h is crc32 of c as text, modulo ``heads``. Turns: (conv_id, depth, turn_hash, words, last);
    members: (conv_id, total), with total 0 for a conversation that is left without a turn.
    """
    ranked = stored(ranked_turns(conversations), "ranked-turns")
    sizes = ranked.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    c = F.col("conv_id")
    convs = sizes.select(
        c, "n", (c - c % family).alias("base"), (F.crc32(c.cast("string")) % heads).cast("long").alias("h")
    )
    of_base = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    taken = F.least("h", F.coalesce("n_base", F.lit(0)))
    convs = convs.join(of_base, "base", "left").select(
        c, "base", "h", taken.alias("m"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total")
    )
    convs = stored(convs, "conversations")
    own = spread_join(ranked, convs.drop("base"), ["conv_id"], nulls=False).filter("rank > h").select(
        "conv_id", (F.col("rank") - F.col("h") + F.col("m")).alias("depth"), "turn_hash", "words", "total"
    )
    first = ranked.filter(F.col("rank") < heads).select(F.col("conv_id").alias("base"), "rank", "turn_hash", "words")
    begun = first.join(convs, "base").filter("rank <= m").select(
        "conv_id", F.col("rank").alias("depth"), "turn_hash", "words", "total"
    )
    turns = own.unionByName(begun)
    return turns.withColumn("last", F.col("depth") == F.col("total")).drop("total"), convs.select("conv_id", "total")


def _half(which: int) -> Column:
    salted = F.sha2(F.concat(F.col("depth").cast("string"), F.lit(":"), F.col("turn_hash")), 256)
    return F.conv(F.substring(salted, 1 + 15 * which, 15), 16, 10).cast("decimal(19,0)")


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, words, last, a, b, pa, pb): the digest of the prefix that ends with each turn, and its parent's."""
    terms = turns.withColumn("ta", _half(0)).withColumn("tb", _half(1))
    sums = running_sums(terms, "conv_id", ["depth"], {"a": F.col("ta"), "b": F.col("tb")})

    def within(x: Column) -> Column:
        return F.pmod(x, F.lit(MODULUS).cast("decimal(38,0)")).cast("long")

    return sums.select(
        "conv_id", F.col("depth").cast("long"), "words", "last", within(F.col("a")).alias("a"), within(F.col("b")).alias("b"),
        within(F.col("a") - F.col("ta")).alias("pa"), within(F.col("b") - F.col("tb")).alias("pb"),
    )


def _slots(a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    """The counter of each digest in each row of the sketch, all rows being numbered through."""
    a, b = a.astype(np.uint64), b.astype(np.uint64) | np.uint64(1)
    return np.concatenate([(a + np.uint64(j) * b) % np.uint64(width) + np.uint64(j * width) for j in range(HASHES)])


def sketch(rows: DataFrame, width: int) -> np.ndarray:
    """One bit per counter of a count-min sketch of ``rows`` (a, b): whether it counted more than one."""

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def sent() -> pa.RecordBatch:
            slots, times = np.unique(np.concatenate(held), return_counts=True)
            slots = np.repeat(slots, np.minimum(times, 2))  # counters stop at two
            block = slots // np.uint64(BLOCK)
            edges = np.flatnonzero(np.diff(block, prepend=np.uint64(2**63)))
            offsets = (slots % np.uint64(BLOCK)).astype("<u2")
            parts = [x.tobytes() for x in np.split(offsets, edges[1:])]
            return pa.RecordBatch.from_arrays([pa.array(block[edges].astype(np.int64)), pa.array(parts, pa.binary())], ["block", "offsets"])

        for batch in batches:
            if batch.num_rows:
                held.append(_slots(batch.column(0).to_numpy(), batch.column(1).to_numpy(), width))
                n += len(held[-1])
            if n > SLOTS:
                yield sent()
                held, n = [], 0
        if n:
            yield sent()

    def above_one(group: pd.DataFrame) -> pd.DataFrame:
        seen = np.zeros(BLOCK, np.int64)
        for data in group["offsets"]:
            seen += np.bincount(np.frombuffer(data, "<u2"), minlength=BLOCK)
        return pd.DataFrame({"block": [group["block"].iloc[0]], "bits": [np.packbits(seen > 1, bitorder="little").tobytes()]})

    parts = rows.select("a", "b").mapInArrow(gather, "block long, offsets binary")
    found = parts.groupBy("block").applyInPandas(above_one, "block long, bits binary")
    bits = np.zeros(HASHES * width // 8, np.uint8)
    size = BLOCK // 8
    for r in found.toLocalIterator():  # as many rows as the sketch has blocks
        bits[r["block"] * size : (r["block"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return bits


def screened(rows: DataFrame) -> DataFrame:
    """``rows`` with ``shared`` and ``parent_shared``: False where the sketch proves that only one conversation has the prefix."""
    many, blocks = rows.count(), BLOCKS[0]
    while blocks < BLOCKS[1] and blocks * BLOCK < ROOM * many:
        blocks *= 2
    width = blocks * BLOCK
    bits = rows.sparkSession.sparkContext.broadcast(sketch(rows, width))

    def look(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bits.value

        def above_one(a: pa.Array, b: pa.Array) -> np.ndarray:
            slots = _slots(a.to_numpy(), b.to_numpy(), width)
            hit = known[(slots >> np.uint64(3)).astype(np.int64)] >> (slots & np.uint64(7)).astype(np.uint8) & 1
            return hit.reshape(HASHES, -1).all(axis=0)

        for batch in batches:
            if not batch.num_rows:
                continue
            own = above_one(batch["a"], batch["b"])
            parent = above_one(batch["pa"], batch["pb"]) | (batch["depth"].to_numpy() == 1)  # every one hangs on the root
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own), pa.array(parent)], [*batch.schema.names, "shared", "parent_shared"])

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(look, f"{kind}, shared boolean, parent_shared boolean")


def ends(rows: DataFrame) -> DataFrame:
    """(a, b, ends_sha256): per node the SHA-256 of its ``conv_id``s, ascending and joined by commas, from rows (a, b, conv_id)."""

    def blobs(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, first, held, size = None, None, [], 0
        done: list[tuple] = []
        for batch in batches:
            for a, b, c in zip(batch["a"].tolist(), batch["b"].tolist(), batch["conv_id"].tolist(), strict=True):
                if key != (a, b) or size > BLOB:
                    if held:
                        done.append((*key, first, ",".join(held)))
                    key, first, held, size = (a, b), c, [], 0
                held.append(str(c))
                size += len(held[-1]) + 1
            yield pd.DataFrame(done, columns=["a", "b", "first", "ids"])
            done = []
        if held:
            yield pd.DataFrame([(*key, first, ",".join(held))], columns=["a", "b", "first", "ids"])

    def digests(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for batch in batches:
            done = []
            for a, b, ids in zip(batch["a"].tolist(), batch["b"].tolist(), batch["ids"], strict=True):
                if key == (a, b):
                    state.update(b",")
                else:
                    if key:
                        done.append((*key, state.hexdigest()))
                    key, state = (a, b), hashlib.sha256()
                state.update(ids.encode())
            yield pd.DataFrame(done, columns=["a", "b", "ends_sha256"])
        if key:
            yield pd.DataFrame([(*key, state.hexdigest())], columns=["a", "b", "ends_sha256"])

    order = ["a", "b", "conv_id"]
    parts = rows.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(blobs, "a long, b long, first long, ids string")
    return parts.repartition("a", "b").sortWithinPartitions("a", "b", "first").mapInPandas(digests, "a long, b long, ends_sha256 string")


def _subtree_sums(nodes: DataFrame, deepest: int) -> DataFrame:
    """(a, b, n_leaves, saved_tokens) summed over each node's subtree; after round k, over what lies less than 2^k below."""
    at = nodes.select("a", "b", "depth", F.col("pa").alias("qa"), F.col("pb").alias("qb"), "n_leaves", "saved_tokens")
    step = 1
    while step <= deepest:
        far = at.filter((F.col("depth") >= step) & F.col("qa").isNotNull())
        below = far.groupBy(F.col("qa").alias("a"), F.col("qb").alias("b")).agg(
            F.sum("n_leaves").alias("_leaves"), F.sum("saved_tokens").alias("_saved")
        )
        ahead = at.filter(F.col("qa").isNotNull()).select(F.col("a").alias("qa"), F.col("b").alias("qb"), F.col("qa").alias("na"), F.col("qb").alias("nb"))
        jump = spread_join(far.filter(F.col("depth") >= 2 * step).select("a", "b", "qa", "qb"), ahead, ["qa", "qb"], by="a", nulls=False)
        jump = jump.select("a", "b", F.col("na").alias("qa"), F.col("nb").alias("qb"))
        at = stored(
            at.drop("qa", "qb").join(below, ["a", "b"], "left").join(jump, ["a", "b"], "left").select(
                "a", "b", "depth", "qa", "qb",
                (F.col("n_leaves") + F.coalesce("_leaves", F.lit(0))).alias("n_leaves"),
                (F.col("saved_tokens") + F.coalesce("_saved", F.lit(0))).alias("saved_tokens"),
            ),
            "subtrees",
        )
        step *= 2
    return at.select("a", "b", "n_leaves", "saved_tokens")


def trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """One row per distinct prefix: smallest member, depth, parent, members, children, leaves below, tokens saved below, ends.

    ``turns``: (conv_id, depth from 1 without gaps, turn_hash, words, last), ``members``: (conv_id, total) with every conv_id once. The root
    has all members and depth 0. Without members there is no node at all.
    """
    spark = turns.sparkSession
    whole = members.agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("c"), F.max("total").alias("deepest")).first()
    if not whole["n"]:
        return spark.createDataFrame([], NODE)
    flagged = stored(screened(stored(prefixes(turns), "prefixes")), "screened")
    nodes = flagged.filter("shared").groupBy("a", "b").agg(
        F.min("depth").alias("depth"), F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.min("conv_id").alias("conv_id"),
        F.count(F.lit(1)).alias("n_convs"), F.min("words").alias("words"),
    )
    root = spark.createDataFrame(
        [(0, 0, 0, None, None, whole["c"], whole["n"], 0)],
        "a long, b long, depth long, pa long, pb long, conv_id long, n_convs long, words long",
    )
    nodes = stored(nodes.unionByName(root), "nodes")
    alone = flagged.filter("NOT shared")
    tops = alone.filter("parent_shared")
    a, b = F.col("pa").alias("a"), F.col("pb").alias("b")
    inner = nodes.filter("depth > 0").groupBy(a, b).agg(F.count(F.lit(1)).alias("_inner"))
    tails = tops.groupBy(a, b).agg(F.count(F.lit(1)).alias("_tails"))
    none = F.lit(0).cast("long")
    known = nodes.join(inner, ["a", "b"], "left").join(tails, ["a", "b"], "left").fillna(0, ["_inner", "_tails"])
    known = stored(
        known.select(
            "a", "b", "pa", "pb", "depth", "conv_id", "n_convs", (F.col("_inner") + F.col("_tails")).alias("n_children"),
            F.when(F.col("_inner") + F.col("_tails") == 0, F.lit(1)).otherwise(F.col("_tails")).cast("long").alias("n_leaves"),
            ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"),
        ),
        "known-nodes",
    )
    above = known.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    parents = spread_join(known.filter("depth > 0").select("a", "b", "pa", "pb"), above, ["pa", "pb"], by="a", nulls=False)
    ended = flagged.filter("last AND shared").select("a", "b", "conv_id").unionByName(
        members.filter("total = 0").select(none.alias("a"), none.alias("b"), "conv_id")
    )
    sums = _subtree_sums(known, whole["deepest"])
    # a prefix that shares counters by chance may hang on a proven singleton, which is its own conversation's
    parent = F.when(F.col("depth") > 0, F.coalesce("parent_conv_id", "conv_id"))
    grouped = (
        known.drop("n_leaves", "saved_tokens").join(sums, ["a", "b"])
        .join(parents.select("a", "b", "parent_conv_id"), ["a", "b"], "left").join(ends(ended), ["a", "b"], "left")
        .select(
            "conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"),
        )
    )

    def single(rows: DataFrame, parent: str) -> DataFrame:
        one, ended_here = F.lit(1).cast("long"), F.sha2(F.col("conv_id").cast("string"), 256)
        return rows.select(
            "conv_id", "depth", F.col(parent).alias("parent_conv_id"), one.alias("n_convs"), (~F.col("last")).cast("long").alias("n_children"),
            one.alias("n_leaves"), none.alias("saved_tokens"), F.when(F.col("last"), ended_here).otherwise(F.lit(_EMPTY)).alias("ends_sha256"),
        )

    tops = spread_join(tops.select("conv_id", "depth", "last", "pa", "pb"), above, ["pa", "pb"], by="conv_id", nulls=False)
    return grouped.unionByName(single(tops, "parent_conv_id")).unionByName(single(alone.filter("NOT parent_shared"), "conv_id"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations; null role or text is empty, further columns are not looked at."""
    return trie(*rebuilt(conversations.select("conv_id", "turn", "role", "text")))
