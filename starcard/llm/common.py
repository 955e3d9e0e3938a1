"""What the training-data operators share: column picking, folds and the scratch folder."""

from __future__ import annotations

import gc
import string
import time

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase
#: Fixed value: what separates words in the shingle and language-model contracts (space and \t to \r).
SPACE = "\x20\x09-\x0d"
JAVA_SPACE = r"[ \t-\r]+"


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text), so that further columns, whatever their names, can't clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it until no column is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text (fold 0)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(folds))


def largest(rows: DataFrame, value: str, item: str, keep: int) -> DataFrame:
    """The rows with the largest positive ``value``, about ``keep`` of them, without sorting them in one place.

    A histogram of sixteenths of octaves tells which values are surely in; of the one at the edge a share is taken
    by a hash of ``item``, so the choice is the same on every run.
    """
    graded = rows.filter(F.col(value) > 0).withColumn("_g", F.floor(-16 * F.log2(F.col(value))))
    room, edge, share = keep, None, 0
    for row in sorted(graded.groupBy("_g").count().collect()):
        if row["count"] > room:
            edge, share = row["_g"], (room << 20) // row["count"]
            break
        room -= row["count"]
    if edge is not None:
        part = (F.col("_g") == edge) & (F.pmod(F.xxhash64(item), F.lit(1 << 20)) < share)
        graded = graded.filter((F.col("_g") < edge) | part)
    return graded.drop("_g")


def release(spark: SparkSession) -> None:
    """Let Spark drop shuffle files of finished jobs now: its cleaner waits until the driver's references are collected.

    The first round frees what Python held on to, the second what that held in the JVM.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def pack(values: np.ndarray) -> bytes:
    """Byte planes of 64-bit numbers: of sorted or small numbers the high planes hardly vary and compress away."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def hash_ranges(keys: np.ndarray, width: int) -> np.ndarray:
    """The range of each 64-bit hash, of ``width`` equal ones; ranges follow the order of hashes."""
    return (((keys >> np.uint64(32)) * np.uint64(width)) >> np.uint64(32)).astype(np.int64)
