"""Column expressions over source type names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from starcard.functions.text import strip
from starcard.rules import PARAMETRIC_NUMBER, SIZED_CHAR_TYPES, TYPE_PREFIXES


def _starts(c: Column, prefixes: list[str]) -> Column:
    return c.rlike("^(?:" + "|".join(prefixes) + ")")


def affinity(source_type: Column) -> Column:
    """INTEGER, REAL, TEXT or BLOB for a source type; unknown types are TEXT."""
    t = F.upper(strip(source_type))
    scale = F.regexp_extract(t, PARAMETRIC_NUMBER, 2)
    whole = (scale == "") | scale.rlike(r"^0+$")
    out = F.when(t.rlike(PARAMETRIC_NUMBER), F.when(whole, "INTEGER").otherwise("REAL"))
    out = out.when(t == "NUMBER", "REAL")
    for prefixes, name in TYPE_PREFIXES:
        out = out.when(_starts(t, prefixes), name)
    return F.when(source_type.isNotNull(), out.otherwise("TEXT"))


def spark_type(source_type: Column) -> Column:
    """Spark DDL type to read a source column with."""
    t = F.upper(strip(source_type))
    p = F.regexp_extract(t, PARAMETRIC_NUMBER, 1).try_cast("int")
    s = F.coalesce(F.regexp_extract(t, PARAMETRIC_NUMBER, 2).try_cast("int"), F.lit(0))
    number = (
        F.when((s == 0) & (p <= 18), "bigint")
        .when(p <= 38, F.format_string("decimal(%d,%d)", p, s))
        .otherwise("double")
    )
    return (
        F.when(t.rlike(PARAMETRIC_NUMBER), number)
        .when(t == "NUMBER", "double")
        .when(_starts(t, ["DATE", "TIMESTAMP"]), "timestamp")
        .when(affinity(source_type) == "INTEGER", "bigint")
        .when(affinity(source_type) == "REAL", "double")
        .when(affinity(source_type) == "BLOB", "binary")
        .otherwise("string")
    )


def type_string(
    data_type: Column, precision: Column, scale: Column, char_length: Column, data_length: Column
) -> Column:
    """The declared form of a column type, such as ``VARCHAR2(30)`` or ``NUMBER(12,2)``."""
    name = F.coalesce(data_type, F.lit(""))
    size = F.coalesce(F.nullif(char_length, F.lit(0)), F.nullif(data_length, F.lit(0)))
    inside = F.concat_ws(",", precision.cast("string"), scale.cast("string"))
    return (
        F.when(
            name.isin(SIZED_CHAR_TYPES) & size.isNotNull(),
            F.concat(name, F.lit("("), size.cast("string"), F.lit(")")),
        )
        .when(
            (name == "NUMBER") & precision.isNotNull(),
            F.concat(name, F.lit("("), inside, F.lit(")")),
        )
        .otherwise(name)
    )
