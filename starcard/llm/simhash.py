"""SimHash near-dedup over a segment-popcount embedding.

A fingerprint's 64 bits are cut into 32 segments of two bits. The vector of the segments' bit counts is
its place on a grid; the Manhattan distance of two places never exceeds the number of differing bits.
Fingerprints within ``radius`` are found by a range join on that grid: the 32 coordinates form
radius + 2 blocks, so two places within the radius agree on at least two whole blocks. Every
pair of blocks gives a grid of cells; within a cell the Manhattan bound is checked first, then the
bits themselves. Cells above ``block`` fingerprints are cut into blocks that meet in pairs.

Inside a cell links are folded into a spanning forest before they leave the task: the components
stay the same, and a cell of n alike fingerprints sends n - 1 links, not n squared.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starcard.llm.common import id_and_text
from starcard.llm.components import components
from starcard.session import stored

BITS, SEGMENT = 64, 2
RADIUS = 4
#: Fixed value: the low bit of every two-bit segment.
LOW_BITS = 0x5555555555555555
SEED = 42


def simhash(text: str | None, words_per_shingle: int = 4) -> int:
    """The fingerprint as a signed 64-bit number; no words: zero."""
    words = (text or "").encode().lower().split()
    n = max(1, len(words) - words_per_shingle + 1) if words else 0
    if not n:
        return 0
    counts = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, 1 << 15):
        stop = min(n, at + (1 << 15))
        hashes = np.array(
            [digest(b" ".join(words[i : i + words_per_shingle]), SEED) for i in range(at, stop)], np.uint64
        )
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    set_bits = np.packbits(counts * 2 > n, bitorder="little")
    return int(set_bits.view("<i8")[0])


def fingerprint_column(text: Column, words_per_shingle: int = 4) -> Column:
    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(t, words_per_shingle) for t in texts], dtype="int64")

    return run(text)


def _place(fp: Column) -> Column:
    """Bit counts of the segments, each as a run of ones: 0, 1 or 3 for no, one or two bits."""
    low = F.lit(LOW_BITS)
    ahead = F.shiftrightunsigned(fp, 1)
    any_bit = fp.bitwiseOR(ahead).bitwiseAND(low)
    both = fp.bitwiseAND(ahead).bitwiseAND(low)
    return any_bit.bitwiseOR(F.shiftleft(both, 1))


def _masks(radius: int) -> list[int]:
    """For each pair of blocks of segments, the bits of both; as signed numbers."""
    blocks, segments = radius + 2, BITS // SEGMENT
    of = [s * blocks // segments for s in range(segments)]
    out = []
    for pair in combinations(range(blocks), 2):
        mask = sum(0b11 << (SEGMENT * s) for s in range(segments) if of[s] in pair)
        out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def _places(fps: np.ndarray) -> np.ndarray:
    low = np.uint64(LOW_BITS)
    ahead = fps >> np.uint64(1)
    return ((fps | ahead) & low) | ((fps & ahead & low) << np.uint64(1))


def _join(lab: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union the ends of all links in ``lab``, where every row points at the first of its set."""
    while len(a):
        la, lb = lab[a], lab[b]
        apart = la != lb
        if not apart.any():
            return
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(lab, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            jumped = lab[lab]
            if (jumped == lab).all():
                break
            lab[:] = jumped


def forest(cell: np.ndarray, fps: np.ndarray, radius: int, wide: int = 512) -> np.ndarray:
    """For rows sorted by cell: the first row of each row's set, links being fingerprints within ``radius``."""
    n = len(fps)
    lab, at = np.arange(n), _places(fps)
    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    ends = np.r_[starts[1:], n]
    last = np.repeat(ends, ends - starts)
    size = np.repeat(ends - starts, ends - starts)
    rows = np.flatnonzero(size <= wide)
    step = 1
    while True:
        rows = rows[rows + step < last[rows]]
        if not len(rows):
            break
        near = rows[np.bitwise_count(at[rows] ^ at[rows + step]) <= radius]
        near = near[np.bitwise_count(fps[near] ^ fps[near + step]) <= radius]
        _join(lab, near, near + step)
        step += 1
    for lo, hi in zip(starts, ends, strict=True):
        if hi - lo <= wide:
            continue
        own, part, place = np.arange(hi - lo), fps[lo:hi], at[lo:hi]
        for r in range(0, hi - lo, 128):
            a, b = np.nonzero(np.bitwise_count(place[r : r + 128, None] ^ place[None, :]) <= radius)
            near = np.bitwise_count(part[a + r] ^ part[b]) <= radius
            _join(own, a[near] + r, b[near])
        lab[lo:hi] = own + lo
    return lab


def links(fingerprints: DataFrame, radius: int = RADIUS, block: int = 4096, fp: str = "fp") -> DataFrame:
    """Links (a, b) between distinct fingerprints that span the same components as all links within ``radius``."""
    masks = _masks(radius)
    cells = F.array(*[F.struct(F.lit(i).alias("grid"), F.col("place").bitwiseAND(F.lit(m)).alias("cell"))
                      for i, m in enumerate(masks)])
    placed = (
        fingerprints.select(F.col(fp).alias("fp")).withColumn("place", _place(F.col("fp")))
        .select("fp", F.explode(cells).alias("c")).select("fp", "c.*")
    )
    # A cell is cut where it holds more than two blocks; most hold a handful.
    full = placed.groupBy("grid", "cell").count().filter(F.col("count") > 2 * block)
    full = full.select("grid", "cell", F.ceil(F.col("count") / block).cast("int").alias("k"))
    cut = F.pmod(F.xxhash64("fp"), F.col("k")).cast("int")
    meets = F.when(F.col("k").isNull(), F.array(F.lit("")))
    others = F.filter(F.sequence(F.lit(0), F.col("k") - 1), lambda t: t != cut)
    meets = meets.otherwise(F.transform(others, lambda t: F.concat_ws("-", F.least(t, cut), F.greatest(t, cut))))
    dealt = placed.join(full, ["grid", "cell"], "left").select("fp", "grid", "cell", F.explode(meets).alias("part"))
    order = ["grid", "cell", "part"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def found(rows: pd.DataFrame) -> pd.DataFrame:
            fps = rows["fp"].to_numpy().astype(np.uint64)
            new = np.zeros(len(rows) - 1, bool)
            for c in order:
                values = rows[c].to_numpy()
                new |= values[1:] != values[:-1]
            lab = forest(np.r_[0, np.cumsum(new)], fps, radius)
            moved = np.flatnonzero(lab != np.arange(len(lab)))
            return pd.DataFrame({"a": fps[moved].astype(np.int64), "b": fps[lab[moved]].astype(np.int64)})

        rest = None
        for batch in batches:
            rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            tail = np.zeros(len(rows), bool)
            for c in order:
                tail |= rows[c].to_numpy() != rows[c].iloc[-1]
            cut_at = int(np.flatnonzero(tail)[-1]) + 1 if tail.any() else 0
            rest = rows.iloc[cut_at:]
            if cut_at:
                yield found(rows.iloc[:cut_at])
        if rest is not None and len(rest):
            yield found(rest)

    return (
        dealt.repartition(*order).sortWithinPartitions(*order).mapInPandas(run, "a long, b long").distinct()
    )


def with_roots(distinct: DataFrame, radius: int = RADIUS, block: int = 4096) -> DataFrame:
    """``distinct`` (one row per fingerprint ``fp``) with ``root``, the same for all fingerprints that links connect."""
    distinct = stored(distinct, "simhash-distinct")
    roots = components(stored(links(distinct, radius, block), "simhash-links")).withColumnRenamed("node", "fp")
    return stored(distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "simhash-roots")


def near_groups(docs: DataFrame, radius: int = RADIUS, words_per_shingle: int = 4, id_col: str = "doc_id",
                text_col: str = "text", block: int = 4096) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id (smallest doc_id in reach), one row per input row.

    A null or wordless text has fingerprint zero and is linked like any other. Rows with equal fingerprints are
    linked; a null doc_id belongs to its component but never names it. An empty table gives an empty result.
    """
    rows = id_and_text(docs, id_col, text_col)
    seen = stored(rows.select("doc_id", fingerprint_column(F.col("text"), words_per_shingle).alias("fp")), "simhash")
    named = with_roots(seen.groupBy("fp").agg(F.min("doc_id").alias("least")), radius, block)
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = named.join(least, "root").select("fp", "component_id")
    return seen.join(of_fp, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
