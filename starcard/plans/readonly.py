"""Read-only SQL: one SELECT or WITH statement is analysed and handed back as a DataFrame.

The text is wrapped in ``SELECT * FROM (...)``, so Spark's own parser refuses writes, DDL,
session commands and statement lists before anything runs. Rows stay in the DataFrame.
"""

from __future__ import annotations

import re
import time
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


# leading white space, comments and brackets, then the first word
_OPENING = re.compile(r"(?:\s|\(|--[^\n]*(?:\n|\Z)|/\*.*?\*/)*(\w*)", re.S)


@dataclass
class Outcome:
    """What the gate and the dry run said about one statement."""

    original_sql: str
    syntax_errors: list[str] = field(default_factory=list)
    explain_errors: list[str] = field(default_factory=list)
    column_names: list[str] = field(default_factory=list)
    success: bool = False
    row_count: int = 0
    error_message: str | None = None
    execution_time_ms: float | None = None
    validation_failed: bool = False

    @property
    def is_valid(self) -> bool:
        return not self.syntax_errors and not self.explain_errors

    def summary(self) -> str:
        if self.is_valid:
            return "No errors - validation passed"
        parts = [
            f"{label} errors: {'; '.join(found)}"
            for label, found in (("Syntax", self.syntax_errors), ("EXPLAIN", self.explain_errors))
            if found
        ]
        return "\n".join(parts)


def _first_line(error: Exception) -> str:
    return str(error).strip().splitlines()[0]


def check_sql(
    spark: SparkSession, sql: str | None, **tables: DataFrame
) -> tuple[DataFrame | None, Outcome]:
    """Parse and analyse; nothing is executed."""
    outcome = Outcome(original_sql=sql or "")
    text = (sql or "").strip().rstrip(";").strip()
    if not text:
        outcome.syntax_errors.append("there is no statement to check")
        return None, outcome
    word = _OPENING.match(text).group(1).upper()
    if word not in ("SELECT", "WITH"):
        outcome.syntax_errors.append(
            f"a statement has to begin with SELECT or WITH, this one begins with {word or text[:20]}"
        )
        return None, outcome
    try:
        df = spark.sql(f"SELECT * FROM (\n{text}\n)", **tables)
    except ParseException as error:
        outcome.syntax_errors.append(f"SQL syntax error: {_first_line(error)}")
        return None, outcome
    except AnalysisException as error:
        outcome.explain_errors.append(f"EXPLAIN validation error: {_first_line(error)}")
        return None, outcome
    outcome.column_names = df.columns
    return df, outcome


def run_readonly(
    spark: SparkSession, sql: str | None, **tables: DataFrame
) -> tuple[DataFrame | None, Outcome]:
    """Gate one statement; a refused one gives no frame and a failed outcome, never an exception.

    ``tables`` may bind ``{name}`` placeholders of the text to DataFrames.
    """
    df, outcome = check_sql(spark, sql, **tables)
    if df is None:
        outcome.validation_failed = True
        outcome.error_message = f"Validation failed: {outcome.summary()}"
    else:
        outcome.success = True
    return df, outcome


def write_result(df: DataFrame, outcome: Outcome, path: str) -> Outcome:
    """Execute into Parquet and record row count and time; errors land in the outcome."""
    doubled = sorted({c for c in df.columns if df.columns.count(c) > 1})
    if doubled:
        outcome.success = False
        outcome.error_message = f"SQL execution error: repeated column names {doubled}"
        return outcome
    seen = Observation()
    started = time.perf_counter()
    try:
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
    except Exception as error:  # noqa: BLE001 - data errors surface as several types
        outcome.success = False
        outcome.error_message = f"SQL execution error: {_first_line(error)}"
        return outcome
    outcome.execution_time_ms = round((time.perf_counter() - started) * 1000, 2)
    outcome.row_count = seen.get["n"]
    return outcome
