"""Exact dedup by composable polynomial fingerprints.

A text is hashed in chunks: h(s) = sum of (byte + 1) * B^(bytes behind it), modulo two primes. Hashes of
neighbouring chunks combine by shifting the left one by the length of the right one, so parts of a
huge document can be hashed wherever they lie (``combine_parts``). Texts with equal fingerprints
are then compared with the text that stays, chunk by chunk, so a collision can't merge two texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starcard.llm.common import id_and_text, lower_ascii
from starcard.session import stored

CHUNK = 1 << 16
#: Two primes below 2^31 and a base for each.
PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 1402024253)
FINGERPRINT = "h1 long, h2 long, n long, sha string"
#: Shares of a group of equal texts; each share meets a copy of the text that stays.
SHARES = 256


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    """B^(n-1) ... B^0, by doubling."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), prime)) % np.uint64(prime)])
    return out[:n][::-1].copy()


class Hasher:
    """Fingerprints of byte strings; ``combine`` joins those of neighbours."""

    def __init__(self, primes: tuple[int, int] = PRIMES, bases: tuple[int, int] = BASES, chunk: int = CHUNK):
        self.primes, self.bases, self.chunk = primes, bases, chunk
        self.tables = [_powers(b, p, chunk) for b, p in zip(bases, primes, strict=True)]

    def part(self, data: bytes) -> tuple[int, int, int]:
        """One chunk: at most 2^16 products below 2^39, so a 64-bit sum holds them."""
        values = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
        n = len(values)
        h = [int(np.dot(values, t[self.chunk - n :])) % p for t, p in zip(self.tables, self.primes, strict=True)]
        return h[0], h[1], n

    def combine(self, left: tuple[int, int, int], right: tuple[int, int, int]) -> tuple[int, int, int]:
        h = [
            (a * pow(b, right[2], p) + c) % p
            for a, c, b, p in zip(left[:2], right[:2], self.bases, self.primes, strict=True)
        ]
        return h[0], h[1], left[2] + right[2]

    def whole(self, data: bytes) -> tuple[int, int, int]:
        found = (0, 0, 0)
        for at in range(0, len(data), self.chunk):
            found = self.combine(found, self.part(data[at : at + self.chunk]))
        return found


def fingerprint(text: Column, hasher_args: dict | None = None) -> Column:
    """Struct (h1, h2, n, sha) of the UTF-8 bytes of ``text`` with A-Z lower-cased; null counts as empty."""
    made: list[Hasher] = []

    @F.pandas_udf(FINGERPRINT)
    def run(texts: pd.Series) -> pd.DataFrame:
        if not made:
            made.append(Hasher(**(hasher_args or {})))
        rows = []
        for data in ((t or "").encode().lower() for t in texts):  # of bytes, lower() changes A-Z only
            rows.append((*made[0].whole(data), hashlib.sha256(data).hexdigest()))
        return pd.DataFrame(rows, columns=["h1", "h2", "n", "sha"])

    return run(text)


def combine_parts(parts: DataFrame, doc: str, after: str, h: str = "f") -> DataFrame:
    """Fingerprints of documents whose parts lie in rows of their own.

    ``h`` is a part's fingerprint and ``after`` the bytes that follow the part in its document. Each
    part is shifted by what follows it; the shifted hashes only have to be added, so map-side sums
    meet in one row per document however many parts there are.
    """

    @F.pandas_udf("h1 long, h2 long")
    def shifted(f: pd.DataFrame, behind: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(
            [
                [a * pow(BASES[0], int(k), PRIMES[0]) % PRIMES[0], b * pow(BASES[1], int(k), PRIMES[1]) % PRIMES[1]]
                for a, b, k in zip(f["h1"].tolist(), f["h2"].tolist(), behind, strict=True)
            ],
            columns=["h1", "h2"],
        )

    moved = parts.select(F.col(doc), shifted(F.col(h), F.col(after)).alias("s"), F.col(h)["n"].alias("n"))
    return moved.groupBy(doc).agg(
        F.pmod(F.sum("s.h1"), F.lit(PRIMES[0])).alias("h1"),
        F.pmod(F.sum("s.h2"), F.lit(PRIMES[1])).alias("h2"),
        F.sum("n").alias("n"),
    )


def _chunks(rows: DataFrame, chunk: int) -> DataFrame:
    """A row per chunk of the text; an empty text has one empty chunk."""
    count = F.ceil(F.greatest(F.length("raw"), F.lit(1)) / F.lit(chunk)).cast("int")
    return rows.withColumn("c", F.explode(F.sequence(F.lit(0), count - 1))).withColumn(
        "raw", F.substring(F.col("raw"), F.col("c") * chunk + 1, F.lit(chunk))
    )


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk: int = CHUNK,
    hasher_args: dict | None = None,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_bytes.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The largest doc_id
    stays. Rows that repeat a doc_id and its text are one document given twice: each is returned and
    counted, and all carry the same ``kept``. A null doc_id stays only if no text of its group has an
    id. An empty table gives an empty result.
    """
    base = id_and_text(docs, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("raw"))
    key = ["h1", "h2", "n"]
    share = F.pmod(F.xxhash64("doc_id"), F.lit(SHARES)).cast("int").alias("share")
    hashed = base.withColumn("f", fingerprint(F.col("raw"), hasher_args))
    seen = stored(
        hashed.select("doc_id", "f.h1", "f.h2", "f.n", share, F.col("f.sha").alias("text_sha256")), "exact-fingerprints"
    )
    groups = seen.groupBy(*key).agg(F.count(F.lit(1)).alias("rows"), F.max("doc_id").alias("keep"))
    groups = groups.filter("rows > 1").drop("rows")
    texts = hashed.select("doc_id", "raw", "f.h1", "f.h2", "f.n")
    stays = texts.join(groups, key).filter(F.col("doc_id").eqNullSafe(F.col("keep"))).select("raw", *key)
    shares = seen.select(*key, "share").distinct()
    left = _chunks(texts.select("*", share), chunk)
    right = _chunks(stays, chunk).join(shares, key).withColumnRenamed("raw", "kept")
    unlike = (
        left.join(right, [*key, "share", "c"]).filter(lower_ascii(F.col("raw")) != lower_ascii(F.col("kept")))
        .select("doc_id", *key).distinct()
    )
    collided = stored(unlike, "exact-collisions").select(
        F.lit(True).alias("hit"), *[F.col(c).alias(f"x_{c}") for c in ("doc_id", *key)]
    )
    # texts that only share a fingerprint are told apart by their digest from here on
    on = F.col("doc_id").eqNullSafe(F.col("x_doc_id"))
    for k in key:
        on &= F.col(k) == F.col(f"x_{k}")
    parted = seen.join(collided, on, "left").select(
        "doc_id", *key, "share", "text_sha256", F.when(F.col("hit"), F.col("text_sha256")).otherwise("").alias("apart")
    )
    group = [*key, "apart"]
    totals = parted.groupBy(*group).agg(F.count(F.lit(1)).alias("group_size"), F.max("doc_id").alias("keep_id"))
    spread = parted.select(*group, "share").distinct().join(totals, group)
    return parted.join(spread, [*group, "share"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256", F.col("n").alias("n_bytes"),
    )
