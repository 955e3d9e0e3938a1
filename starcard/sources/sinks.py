"""Writers: cards, samples, the run log and state dumps."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from starcard.operators.runlog import key_differences
from starcard.rules import RUN_FIELDS, RUN_FILE
from starcard.session import shuffle_width, shuffled, shuffles_dropped
from starcard.sources.files import CARD_BUCKETS, card_bucket

SAMPLE_ROWS = 1000


def first_rows(df: DataFrame, order: list[str], n: int = SAMPLE_ROWS) -> DataFrame:
    return df.orderBy(*order).limit(n)


def export_samples(tables: dict[str, tuple[DataFrame, list[str]]], root: str) -> dict[str, str]:
    """First rows of each table as CSV; a table that fails is reported and the rest go on."""
    done = {}
    for name, (df, order) in tables.items():
        try:
            sample = first_rows(df, order)
            sample.write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{root}/{name}")
            done[name] = "exported"
        except Exception as error:  # noqa: BLE001 - one bad table must not stop the export
            done[name] = f"skipped: {str(error).splitlines()[0]}"
    return done


def write_cards(
    cards: DataFrame, path: str, existing: DataFrame | None = None, overwrite: bool = False,
    filtered: Column | None = None,
) -> dict[str, int]:
    """Store cards as compressed JSON lines in bucket folders; cards already stored stay unless ``overwrite``.

    Cards for which ``filtered`` holds are left out and counted.

    Folders are hash buckets of the schema name: a folder or file per schema or table would leave
    millions of tiny files. ``existing``: cards already at ``path``. Counts generated, skipped and filtered.
    """
    seen = Observation()
    name = F.lower(F.col("table_metadata.qualified_name"))
    out = F.lit(False) if filtered is None else F.coalesce(filtered, F.lit(False))
    rows = cards.withColumn("_name", name).withColumn("_kept", F.lit(False)).withColumn("_out", out)
    if existing is not None and not overwrite:
        have = existing.select(name.alias("_name")).distinct().withColumn("_have", F.lit(True))
        rows = rows.join(shuffled(have), "_name", "left").withColumn("_kept", F.col("_have").isNotNull()).drop("_have")
    sums = [
        F.count_if(~F.col("_kept") & ~F.col("_out")).alias("generated"),
        F.count_if(F.col("_kept") & ~F.col("_out")).alias("skipped"), F.count_if("_out").alias("filtered"),
    ]
    counted, rows = rows, rows.observe(seen, *sums)
    bucket = card_bucket(F.col("table_metadata.schema_name")).alias("schema_bucket")
    new = rows.filter(~F.col("_kept") & ~F.col("_out")).select(*cards.columns, bucket)
    # A bucket is written by several tasks, more of them the wider shuffles are, so one schema with most of the tables is split as well.
    share = max(4, shuffle_width(cards.sparkSession) // CARD_BUCKETS)
    spread = new.repartition("schema_bucket", F.pmod(F.xxhash64("table_metadata.name"), F.lit(share)))
    writer = spread.write.mode("overwrite" if overwrite else "append").partitionBy("schema_bucket")
    with shuffles_dropped(cards.sparkSession):
        writer.option("compression", "gzip").json(path)
    try:
        return dict(seen.get)
    except Py4JJavaError:  # nothing to write: the plan ended before the counts
        return counted.agg(*sums).first().asDict()


def append_runs(runs: DataFrame, path: str, fields: list[str] = RUN_FIELDS) -> None:
    """Append to the run log; the columns must be exactly the log's fields."""
    missing, extra = key_differences(runs.columns, fields)
    if missing or extra:
        raise ValueError(f"run row does not match the log: missing {missing}, extra {extra}")
    runs.select(*fields).write.mode("append").parquet(path)


def state_dumps(states: DataFrame) -> DataFrame:
    """file, run_id, value: one JSON text per run, in files named after the run id."""
    body = F.struct(*[c for c in states.columns if c != "run_id"])
    return states.select(
        F.format_string(RUN_FILE, F.col("run_id")).alias("file"), "run_id",
        F.to_json(body, {"ignoreNullFields": "false"}).alias("value"),
    )


def write_dumps(states: DataFrame, path: str, bucket_rows: int = 100_000) -> None:
    """Dumps partitioned by run id range, so one run is found without reading the rest."""
    bucket = F.floor(F.col("run_id") / bucket_rows).alias("bucket")
    state_dumps(states).select("*", bucket).write.mode("append").partitionBy("bucket").parquet(path)


def list_dumps(spark: SparkSession, path: str) -> DataFrame:
    """Names of stored runs, sorted; ``read_dump`` opens one. What they hold is neither read nor sorted."""
    return spark.read.parquet(path).select("file", "run_id").orderBy("file")


def open_dumps(spark: SparkSession, path: str) -> DataFrame:
    """All stored runs with what they hold, by file name."""
    return spark.read.parquet(path).select("file", "run_id", "value").orderBy("file")


def read_dump(spark: SparkSession, path: str, run_id: int, bucket_rows: int = 100_000) -> DataFrame:
    rows = spark.read.parquet(path).filter(F.col("bucket") == run_id // bucket_rows)
    return rows.filter(F.col("run_id") == run_id).select("file", "value")
