"""Run-log queries; every event stands for one run of the assistant."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starcard.operators import runlog as R
from starcard.plans.registry import query, table
from starcard.streaming.runs import read_stream, stream_progress, stream_run_log
from starcard.session import scratch_path

RUN_SQL = """
runs AS (
  SELECT event_id AS run_id, k % 3 AS repair_attempts,
    CASE WHEN k = 7 THEN NULL WHEN event_type = 'error' AND k < 50 THEN ['near ' || k, 'bad token'] ELSE [] END AS syn,
    CASE WHEN k = 7 THEN NULL WHEN k >= 90 OR (event_type = 'error' AND k % 2 = 0) THEN ['no such table: T' || k]
         ELSE [] END AS exp
  FROM (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
),
checked AS (
  SELECT *, len(syn) = 0 AS syntax_ok, len(exp) = 0 AS explain_ok,
    CASE WHEN len(syn) = 0 AND len(exp) = 0 THEN 'No errors - validation passed' ELSE concat_ws(chr(10),
      CASE WHEN len(syn) > 0 THEN 'Syntax errors: ' || array_to_string(syn, '; ') END,
      CASE WHEN len(exp) > 0 THEN 'EXPLAIN errors: ' || array_to_string(exp, '; ') END) END AS summary
  FROM runs
)"""


def runs(spark: SparkSession, d: str) -> DataFrame:
    """run_id, repair_attempts and the two error lists, read off the events."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    events = table(spark, d, "events").select("event_id", "event_type", k.alias("k"))
    none = F.array().cast("array<string>")
    number, bad = F.col("k"), F.col("event_type") == "error"
    syntax = F.when(
        bad & (number < 50), F.array(F.concat(F.lit("near "), number.cast("string")), F.lit("bad token"))
    ).otherwise(none)
    explain = F.when(
        (number >= 90) | (bad & (number % 2 == 0)),
        F.array(F.concat(F.lit("no such table: T"), number.cast("string"))),
    ).otherwise(none)
    unknown = number == 7
    return events.select(
        F.col("event_id").alias("run_id"), (number % 3).alias("repair_attempts"),
        F.when(~unknown, syntax).alias("syntax_errors"), F.when(~unknown, explain).alias("explain_errors"),
    )


@query(
    "validation_outcome",
    f"""WITH {RUN_SQL} SELECT run_id, syntax_ok, explain_ok, syntax_ok AND explain_ok AS is_valid,
          array_to_string(list_concat(syn, exp), '|') AS all_errors, summary FROM checked WHERE syn IS NOT NULL""",
)
def validation_outcome(spark: SparkSession, d: str) -> DataFrame:
    known = runs(spark, d).filter(F.col("syntax_errors").isNotNull())
    return R.validated(known).select(
        "run_id", "syntax_ok", "explain_ok", "is_valid",
        F.array_join("all_errors", "|").alias("all_errors"), "summary",
    )


@query(
    "route_outcome",
    f"""WITH {RUN_SQL} SELECT CASE WHEN syn IS NULL THEN 'validation_failed'
          WHEN len(syn) = 0 AND len(exp) = 0 THEN 'sql_executor'
          WHEN repair_attempts >= 1 THEN 'validation_failed' ELSE 'sql_repairer' END AS step,
          count(*) AS n FROM runs GROUP BY 1""",
)
def route_outcome(spark: SparkSession, d: str) -> DataFrame:
    steps = runs(spark, d).select(R.route().alias("step"))
    return steps.groupBy("step").agg(F.count(F.lit(1)).alias("n"))


@query(
    "blocked_result",
    f"""WITH {RUN_SQL} SELECT run_id, false AS success, 0 AS row_count, 'Validation failed: ' ||
          CASE WHEN syn IS NULL THEN 'Validation failed (no details available)' ELSE summary END AS error_message,
          true AS validation_failed
        FROM checked WHERE syn IS NULL OR len(syn) > 0 OR len(exp) > 0""",
)
def blocked_result(spark: SparkSession, d: str) -> DataFrame:
    return R.blocked(runs(spark, d))


@query(
    "next_run_id",
    """SELECT o_orderkey, (SELECT max(event_id) FROM events) + row_number() OVER (ORDER BY o_orderdate, o_orderkey)
              AS run_id FROM orders""",
)
def next_run_id(spark: SparkSession, d: str) -> DataFrame:
    """Orders are a new batch of runs, the events the log they are appended to."""
    log = table(spark, d, "events").select(F.col("event_id").alias("run_id"))
    batch = table(spark, d, "orders").select("o_orderdate", "o_orderkey")
    return R.assign_run_ids(batch, ["o_orderdate", "o_orderkey"], log).select("o_orderkey", "run_id")


FOLD_SQL = """SELECT user_id, arg_max(value, (ts, event_id)) AS last_value,
  arg_max(event_type, (ts, event_id)) AS last_step,
  string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS steps FROM events GROUP BY 1"""


@query("progress_fold", FOLD_SQL)
def progress_fold(spark: SparkSession, d: str) -> DataFrame:
    return R.fold_progress(table(spark, d, "events"), "user_id", "ts", "event_id", "value", "event_type")


def _in_two_deliveries(spark: SparkSession, d: str, label: str) -> tuple[str, list[DataFrame]]:
    """A landing folder and the files that reach it: later rows first, the others (every third, with old times) after."""
    events = table(spark, d, "events")
    late = F.col("event_id") % 3 == 0
    return scratch_path(spark, label), [events.filter(~late), events.filter(late)]


@query("stream_progress_fold", FOLD_SQL)
def stream_progress_fold(spark: SparkSession, d: str) -> DataFrame:
    """The fold is called twice and goes on from its state."""
    folder, deliveries = _in_two_deliveries(spark, d, "progress-landing")
    out = scratch_path(spark, "progress")
    for rows in deliveries:
        rows.write.mode("append").parquet(folder)
        events = read_stream(spark, folder, rows.schema)
        state = stream_progress(events, "user_id", "ts", "event_id", "value", "event_type", path=out)
    return state


@query(
    "stream_run_log",
    "SELECT event_id AS run_id, event_type AS user_query, value AS took FROM events",
)
def stream_run_log_query(spark: SparkSession, d: str) -> DataFrame:
    """Every run is delivered twice, a third of them late and in a second call; the log holds each once."""
    folder, deliveries = _in_two_deliveries(spark, d, "run-log-landing")
    path = scratch_path(spark, "run-log")
    for rows in deliveries:
        rows.write.mode("append").parquet(folder)
        runs = read_stream(spark, folder, rows.schema).select(
            F.col("event_id").alias("run_id"), F.col("ts").cast("timestamp").alias("ended"),
            F.col("event_type").alias("user_query"), F.col("value").alias("took"),
        )
        twice = runs.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
        log = stream_run_log(twice, path, ["run_id", "ended", "user_query", "took"])
    return log.select("run_id", "user_query", "took")
