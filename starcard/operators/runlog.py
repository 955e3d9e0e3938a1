"""The run log: validation outcome, routing, ids, folding of progress events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starcard.operators.segments import dense_number
from starcard.rules import BLOCKED_PREFIX, BLOCKED_WITHOUT_DETAIL, MAX_REPAIR_ATTEMPTS


def validation_columns() -> dict[str, Column]:
    """Derived fields of a run with ``syntax_errors`` and ``explain_errors`` arrays."""
    syntax, explain = F.col("syntax_errors"), F.col("explain_errors")
    syntax_ok, explain_ok = F.size(syntax) == 0, F.size(explain) == 0
    lines = F.concat_ws(
        "\n",
        F.when(~syntax_ok, F.concat(F.lit("Syntax errors: "), F.array_join(syntax, "; "))),
        F.when(~explain_ok, F.concat(F.lit("EXPLAIN errors: "), F.array_join(explain, "; "))),
    )
    return {
        "syntax_ok": syntax_ok,
        "explain_ok": explain_ok,
        "is_valid": syntax_ok & explain_ok,
        "all_errors": F.concat(syntax, explain),
        "summary": F.when(syntax_ok & explain_ok, "No errors - validation passed").otherwise(lines),
    }


def validated(runs: DataFrame) -> DataFrame:
    return runs.select("*", *[c.alias(n) for n, c in validation_columns().items()])


def route(max_attempts: int = MAX_REPAIR_ATTEMPTS) -> Column:
    """Next step of a run; arrays are null when there is no validation result at all."""
    known = F.col("syntax_errors").isNotNull() & F.col("explain_errors").isNotNull()
    valid = (F.size("syntax_errors") == 0) & (F.size("explain_errors") == 0)
    return (
        F.when(~known, "validation_failed")
        .when(valid, "sql_executor")
        .when(F.col("repair_attempts") >= max_attempts, "validation_failed")
        .otherwise("sql_repairer")
    )


def blocked(runs: DataFrame) -> DataFrame:
    """The failed result of every run that may not execute."""
    checked = validated(runs)
    known = F.col("syntax_errors").isNotNull() & F.col("explain_errors").isNotNull()
    text = F.when(known, F.col("summary")).otherwise(BLOCKED_WITHOUT_DETAIL)
    return checked.filter(~known | ~F.col("is_valid")).select(
        "run_id", F.lit(False).alias("success"), F.lit(0).alias("row_count"),
        F.concat(F.lit(BLOCKED_PREFIX), text).alias("error_message"),
        F.lit(True).alias("validation_failed"),
    )


def assign_run_ids(new_runs: DataFrame, order: list[str], log: DataFrame | None = None) -> DataFrame:
    """Number a batch of runs from the highest logged id + 1, or from 1 for an empty log."""
    top = None
    if log is not None:
        bad = log.filter(F.col("run_id").isNotNull() & F.col("run_id").try_cast("bigint").isNull())
        if not bad.isEmpty():
            raise RuntimeError("the run log holds a run id that is not a number")
        top = log.agg(F.max(F.col("run_id").cast("bigint"))).first()[0]
    return dense_number(new_runs, order, "run_id", start=(top or 0) + 1)


def fold_progress(events: DataFrame, run: str, at: str, seq: str, value: str, step: str) -> DataFrame:
    """Last written value and the finished steps of every run; merged map-side first."""
    return events.groupBy(run).agg(
        F.max_by(value, F.struct(at, seq)).alias("last_value"),
        F.max_by(step, F.struct(at, seq)).alias("last_step"),
        F.array_join(F.array_sort(F.collect_set(step)), ",").alias("steps"),
    )


def key_differences(given: list[str], expected: list[str]) -> tuple[list[str], list[str]]:
    """(missing, extra) field names."""
    return sorted(set(expected) - set(given)), sorted(set(given) - set(expected))
