"""The run log as streams: folding progress and appending runs once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from starcard.operators.runlog import fold_progress, key_differences
from starcard.session import scratch_path


#: Run ids of a range, which is a folder of the log.
RANGE_RUNS = 100_000


def read_stream(spark: SparkSession, folder: str, schema: StructType, glob: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder)


def _stream_name(batch: DataFrame) -> str:
    """The stream's own name, kept in its checkpoint: two streams into one folder never use each other's batch folders."""
    name = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
    return (name or "stream").replace("-", "")


def _run_to_end(stream: DataFrame, mode: str, write: Callable[[DataFrame, int], None], state: str) -> None:
    started = (
        stream.writeStream.outputMode(mode).foreachBatch(write)
        .option("checkpointLocation", state).trigger(availableNow=True).start()
    )
    started.awaitTermination()


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def stream_progress(
    events: DataFrame, run: str, at: str, seq: str, value: str, step: str, path: str | None = None,
    checkpoint: str | None = None,
) -> DataFrame:
    """Fold what the stream holds by now; the last update of each run is its state.

    Only changed runs leave each batch, straight to files; nothing passes through the driver. With a ``path`` the
    fold goes on from where the last call with that path stopped; its state lies beside it unless ``checkpoint``
    names another folder. Without one it starts anew.
    """
    spark = events.sparkSession
    out = path or scratch_path(spark, "progress")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")  # a batch run twice leaves one copy

    folded = fold_progress(events, run, at, seq, value, step)
    _run_to_end(folded, "update", write, checkpoint or f"{out.rstrip('/')}.state")
    updates = spark.read.option("basePath", out).parquet(out)
    latest = updates.groupBy(run).agg(
        F.max_by(F.struct("last_value", "last_step", "steps"), "batch").alias("s")
    )
    return latest.select(run, "s.*")


def _range_of(run: Column) -> Column:
    """The folder of a run id: ids of one range lie together; those without an id have one of their own."""
    return F.coalesce(F.floor(run / RANGE_RUNS).cast("long"), F.lit(-1).cast("long"))


def _logged(spark: SparkSession, path: str, kind: StructType, ranges: list[int], own: str) -> DataFrame:
    """Run ids of the log in the given ranges, without what batch ``own`` wrote; other ranges aren't listed for reading."""
    log = spark.read.schema(kind).option("basePath", path).parquet(path)
    return log.filter(F.col("run_range").isin(ranges) & (F.col("part") != own)).select("run_id")


def stream_run_log(runs: DataFrame, path: str, fields: list[str], checkpoint: str | None = None) -> DataFrame:
    """Append runs as they finish, one row per run id however often and however late it is delivered.

    The log lies in folders by batch and by range of ``RANGE_RUNS`` run ids. A batch reads the ranges that it has runs of, and leaves out
    the runs found there, so its work grows with those ranges and not with the log. The stream's state lies beside the log unless
    ``checkpoint`` names another folder, so a later call goes on with what is new; a stream with a state of its
    own may append to the same log. Of deliveries in one batch the least row stays.
    """
    missing, extra = key_differences(runs.columns, fields)
    if missing or extra:
        raise ValueError(f"run row does not match the log: missing {missing}, extra {extra}")
    spark = runs.sparkSession
    once = runs.select(*fields)
    kind = StructType([*once.schema.fields]).add("part", "string").add("run_range", "long")

    def write(batch: DataFrame, batch_id: int) -> None:
        own = f"{_stream_name(batch)}-{batch_id}"
        new = batch.groupBy("run_id").agg(F.min(F.struct(*fields)).alias("r")).select("r.*").withColumn("run_range", _range_of(F.col("run_id")))
        new = new.persist()
        try:
            if _exists(batch.sparkSession, path):
                ranges = sorted(r[0] for r in new.select("run_range").distinct().collect())  # a number per range of ids
                new_only = new.join(_logged(batch.sparkSession, path, kind, ranges, own), "run_id", "left_anti")
            else:
                new_only = new
            new_only.select(*fields, "run_range").write.mode("overwrite").partitionBy("run_range").parquet(f"{path}/part={own}")
        finally:
            new.unpersist()

    _run_to_end(once, "append", write, checkpoint or f"{path.rstrip('/')}.state")
    if not _exists(spark, path):  # nothing has been delivered yet
        return spark.createDataFrame([], once.schema)
    return spark.read.schema(kind).option("basePath", path).parquet(path).select(*fields)
