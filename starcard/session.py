"""Session helpers: builder, lineage cut, shared scratch paths and checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(master: str | None = None, app: str = "starcard", **conf: str) -> SparkSession:
    """Start a session; the caller's cluster defaults win for everything not named here."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def _shared_root(spark: SparkSession) -> str:
    """Folder all executors see: the cluster's checkpoint folder, or one on its default file system.

    A session without either is only served when driver and executors are one process (tests).
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named
    home = context._jvm.org.apache.hadoop.fs.FileSystem.get(context._jsc.hadoopConfiguration()).getHomeDirectory()
    if home.toUri().getScheme() != "file":
        root = f"{home}/.starcard-scratch"
    elif context.master.split("[")[0] == "local":
        root = tempfile.mkdtemp(prefix="starcard-")
    else:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(root)
    return root


class Scratch:
    """Owns the scratch paths handed out while it is open, and deletes them when it closes.

    Results made inside read from these paths, so write them before the end: ``with Scratch(spark): job().write...``.
    """

    _open: list[list[str]] = []

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        Scratch._open.append(self.paths)
        return self

    def __exit__(self, *_: object) -> None:
        Scratch._open.remove(self.paths)
        context = self.spark.sparkContext
        for path in self.paths:
            where = context._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; nothing is reused between calls. An open ``Scratch`` deletes it later."""
    path = f"{_shared_root(spark)}/starcard/{label}-{uuid.uuid4().hex}"
    if Scratch._open:
        Scratch._open[-1].append(path)
    return path


def kept_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that stays: ``name`` has to say what its content is made of."""
    return f"{_shared_root(spark)}/starcard/kept/{name}"


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later stages reread files, so a lost executor cannot change rows."""
    spark = df.sparkSession
    root = _shared_root(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return df.checkpoint()


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written inside go when its job ends; else they stay until the driver collects its garbage.

    A write plans its frame anew, so nothing else reads its shuffles.
    """
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: like ``cut``, but columnar, compressed and prunable."""
    path = scratch_path(df.sparkSession, label)
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fits(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """True when ``df`` has at most ``rows`` rows; a plain count, so no rows are moved for it."""
    return df.count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """Hint a broadcast only after the size check; otherwise hand the frame back unhinted."""
    if fits(df, rows):
        return F.broadcast(df), True
    return df, False


def shuffled(df: DataFrame) -> DataFrame:
    """A join's side that grows with the data: it is shuffled, however small its plan looks.

    Spark's size check doesn't see how many rows an exploded array has, nor how well a file is compressed, and a wrong
    guess is collected by the driver. Adaptive execution still splits hot keys.
    """
    return df.hint("merge")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
