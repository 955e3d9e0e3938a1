"""Line dedup: later copies of repeated line runs are deleted, found by distributed prefix doubling.

Lines become 128-bit ids. Ranks of the suffixes of all line sequences are refined as for a suffix array: the
rank by 2h lines is the dense number of (rank by h lines here, rank by h lines h further on). Suffixes of
one rank at depth h are an LCP interval of value h or more, so only suffixes that still share their interval
take part in the next round; most lines are unique and leave at once.

A run counts when it has ``min_chars`` characters in lines that aren't blank; with 1, the default, every run with a non-blank
line counts, however short. For every line the shortest windows of that size that start
or end there are looked up among the intervals (a window of w lines is a pair of overlapping intervals of
depth h, h <= w < 2h). The union of windows that occur earlier is the union of the maximal repeated runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starcard.llm.common import free_name
from starcard.operators.segments import dense_number
from starcard.session import stored

MIN_CHARS = 1
PLACE = ["d", "t", "line"]
LAST = (1 << 63) - 1


def windows(chars: np.ndarray, least: int) -> list[list[int]]:
    """Per line, the sizes of the shortest windows of ``least`` characters that begin there.

    Those are the shortest one from the line on, and the shortest ones up to some later line.
    """
    n = len(chars)
    total = np.r_[0, np.cumsum(chars)]
    ends = np.searchsorted(total, total[:-1] + least)
    starts = np.searchsorted(total, total[1:] - least, side="right") - 1
    found: list[set[int]] = [set() for _ in range(n)]
    for i, end in enumerate(ends):
        if end <= n:
            found[i].add(max(1, int(end) - i))
    for j, start in enumerate(starts):
        if start >= 0:
            found[min(start, j)].add(max(1, j + 1 - int(start)))
    return [sorted(f) for f in found]


def _lines(least: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("d", "t", "line", "a", "b", "w")}
            for d, t, text in zip(batch["d"], batch["t"], batch["text"], strict=True):
                lines = text.split("\n")
                ids = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.encode()) for x in lines), "<i8")
                out["d"].append(np.full(len(lines), d))
                out["t"].append(np.full(len(lines), t))
                out["line"].append(np.arange(len(lines)))
                out["a"].append(ids[::2])
                out["b"].append(ids[1::2])
                out["w"] += windows(np.array([len(x) if x.strip() else 0 for x in lines]), least)
            if out["d"]:
                yield pd.DataFrame({c: v if c == "w" else np.concatenate(v) for c, v in out.items()})

    return run


def repeated_windows(docs: DataFrame, least: int = MIN_CHARS) -> DataFrame:
    """(d, t, line, w): windows of w lines that occur at an earlier place, places ordered by (d, t, line).

    ``docs`` has d, t and text, (d, t) naming the document.
    """
    spark = docs.sparkSession
    kind = "d long, t long, line long, a long, b long, w array<int>"
    lines = stored(docs.mapInPandas(_lines(least), kind).dropDuplicates(PLACE), "lines")
    shared = lines.groupBy("a", "b").count().filter("count > 1").select("a", "b")
    ranks = lines.join(dense_number(shared, ["a", "b"], "rank"), ["a", "b"]).select(*PLACE, "rank", "w")
    ranks = stored(ranks, "line-ranks")
    widest = ranks.agg(F.max(F.array_max("w"))).first()[0] or 0
    place = F.struct(*PLACE)
    found, h = spark.createDataFrame([], "d long, t long, line long, w int"), 1
    while h <= widest:
        asked = ranks.select(*PLACE, "rank", F.explode("w").alias("w")).filter(F.col("w").between(h, 2 * h - 1))
        ends = ranks.select("d", "t", F.col("line").alias("end"), F.col("rank").alias("next"))
        asked = asked.withColumn("end", F.col("line") + F.col("w") - h).join(ends, ["d", "t", "end"])
        first = asked.groupBy("w", "rank", "next").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
        later = asked.join(first.filter("n > 1"), ["w", "rank", "next"]).filter(place != F.col("first"))
        found = found.unionByName(stored(later.select(*PLACE, "w"), "line-windows"))
        h *= 2
        if h > widest:
            break
        ahead = ranks.select("d", "t", (F.col("line") - h // 2).alias("line"), F.col("rank").alias("next"))
        pairs = ranks.join(ahead, PLACE)
        shared = pairs.groupBy("rank", "next").count().filter("count > 1").select("rank", "next")
        numbered = dense_number(shared, ["rank", "next"], "deeper")
        ranks = stored(
            pairs.join(numbered, ["rank", "next"]).select(*PLACE, F.col("deeper").alias("rank"), "w"), "line-ranks"
        )
        if ranks.isEmpty():
            break
    return found


def _without(texts: pd.Series, starts: pd.Series, sizes: pd.Series) -> pd.DataFrame:
    rows = []
    for text, first, size in zip(texts, starts, sizes, strict=True):
        lines = (text or "").split("\n")
        if first is None or not len(first):
            rows.append((text or "", len(lines), 0, 0))
            continue
        edge = np.zeros(len(lines) + 1, np.int64)
        np.add.at(edge, np.asarray(first), 1)
        np.add.at(edge, np.asarray(first) + np.asarray(size), -1)
        gone = np.cumsum(edge[:-1]) > 0
        runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
        rows.append(("\n".join(x for x, g in zip(lines, gone, strict=True) if not g), len(lines), int(gone.sum()), runs))
    return pd.DataFrame(rows, columns=["kept", "n_lines", "n_removed", "n_runs"])


def dedup_lines(docs: DataFrame, least: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text", name: str = "_lines") -> DataFrame:
    """``docs`` with a struct ``name`` (kept text, n_lines, n_removed, n_runs) added; every row stays.

    A run of whole lines with at least ``least`` characters in non-blank lines is deleted where it occurs again, in a document with a
    larger id or further down in the same one. Null ids come last, rows of one id in the order of a hash of their text;
    rows equal in both are one document and get the same result. A null text is one empty line. An empty table gives an
    empty result. Other columns, whatever their names, are left alone.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d, t, w = (free_name(docs, c) for c in ("_d", "_t", "_w"))
    named = docs.withColumn(d, F.coalesce(F.col(id_col).cast("long"), F.lit(LAST))).withColumn(t, F.xxhash64(text))
    found = repeated_windows(named.select(F.col(d).alias("d"), F.col(t).alias("t"), text.alias("text")), least)
    by_doc = found.groupBy(F.col("d").alias(d), F.col("t").alias(t)).agg(F.collect_list(F.struct("line", "w")).alias(w))
    without = F.pandas_udf(_without, "kept string, n_lines long, n_removed long, n_runs long")
    return named.join(by_doc, [d, t], "left").withColumn(name, without(text, F.col(w)["line"], F.col(w)["w"])).select(*docs.columns, name)


def line_report(docs: DataFrame, least: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_removed, n_runs, kept_text of ``dedup_lines``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return dedup_lines(rows, least).select(
        "doc_id", "_lines.n_lines", "_lines.n_removed", "_lines.n_runs", F.col("_lines.kept").alias("kept_text")
    )
