"""Lookup value maps in long form: one row per (lookup, key), nested only on output."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starcard.rules import FULL_MAP_ROWS, SAMPLED_ROWS
from starcard.session import broadcast_if_small, cut

MAP_SCHEMA = "ref_table string, map_key string, map_value string, n bigint, value_column string"


def _filled(c: Column) -> Column:
    """Not null and not blank; the stored text keeps its spaces."""
    return c.isNotNull() & c.rlike(r"\S")


def usable_pairs(lookup: DataFrame, key: str, value: str, seq: str | None = None) -> DataFrame:
    """(seq, map_key, map_value) rows with both sides filled, as text."""
    k, v = F.col(key).cast("string"), F.col(value).cast("string")
    return lookup.select(
        F.col(seq or key).alias("seq"), k.alias("map_key"), v.alias("map_value")
    ).filter(_filled(F.col("map_key")) & _filled(F.col("map_value")))


def _last_wins(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("map_key").agg(F.max_by("map_value", "seq").alias("map_value"))


def full_map(
    lookup: DataFrame, name: str, key: str, value: str, n: Column | None = None, seq: str | None = None
) -> DataFrame:
    """Every usable pair of a lookup, a later row replacing an earlier one with the same key."""
    return _last_wins(usable_pairs(lookup, key, value, seq)).select(
        F.lit(name).alias("ref_table"), "map_key", "map_value",
        (F.lit(None) if n is None else n).cast("bigint").alias("n"),
        F.lit(None).cast("string").alias("value_column"),
    )


def sampled_map(
    lookup: DataFrame, name: str, key: str, value: str, n: Column, seq: str | None = None,
    sampled_rows: int = SAMPLED_ROWS,
) -> DataFrame:
    """The first usable rows in file order; a repeated key uses up one of the places."""
    first = usable_pairs(lookup, key, value, seq).orderBy("seq").limit(sampled_rows)
    return _last_wins(first).select(
        F.lit(name).alias("ref_table"), "map_key", "map_value",
        n.cast("bigint").alias("n"), F.lit(value).alias("value_column"),
    )


def value_map(
    lookup: DataFrame, name: str, key: str, value: str, rows: int | None, seq: str | None = None,
    full_rows: int = FULL_MAP_ROWS, sampled_rows: int = SAMPLED_ROWS,
) -> DataFrame | None:
    """Full up to ``full_rows`` rows by the catalog statistics, else the first ``sampled_rows``; none without statistics."""
    if rows is None:
        return None
    if rows <= full_rows:
        return full_map(lookup, name, key, value, F.lit(rows), seq)
    return sampled_map(lookup, name, key, value, F.lit(rows), seq, sampled_rows)


def resolve_keys(values: DataFrame, label: str) -> DataFrame:
    """map_key of every entry whose label is ``label``, to join facts on; however many there are."""
    return values.filter(F.col("map_value") == label).select("map_key").distinct()


def lookup_rows(lookups: dict[str, DataFrame], seq: str = "_seq") -> DataFrame:
    """One long table over all lookups: ref_table, seq, cells (column name to text)."""
    parts = [
        rows.select(
            F.lit(name).alias("ref_table"), F.col(seq).cast("long").alias("seq"),
            F.create_map(
                *[x for c in rows.columns if c != seq for x in (F.lit(c), F.col(c).cast("string"))]
            ).alias("cells"),
        )
        for name, rows in lookups.items()
    ]
    if not parts:
        raise ValueError("no lookup rows at hand")
    return reduce(DataFrame.unionByName, parts)


def long_maps(
    lookups: dict[str, DataFrame], wanted: DataFrame, seq: str = "_seq", partial: bool = False,
    full_rows: int = FULL_MAP_ROWS, sampled_rows: int = SAMPLED_ROWS,
) -> DataFrame:
    """Value maps of all wanted lookups: ref_table, key_column, map_key, map_value, n, value_column.

    ``wanted``: ref_table, key_column, value_column, n. Lookups are scanned once each, whatever the number of
    maps; the maps asked for are few (checked) and travel to the rows. A map
    is full up to ``full_rows`` rows by the catalog's statistics and else made of the first ``sampled_rows`` usable rows;
    without statistics there is none. A wanted lookup without rows at hand is an error unless ``partial`` allows it.
    """
    wanted = cut(wanted.select("ref_table", "key_column", "value_column", "n").distinct())
    if not partial:
        lost = [r[0] for r in wanted.filter(~F.col("ref_table").isin(list(lookups))).select("ref_table").distinct().take(5)]
        if lost:
            raise ValueError(f"lookups without rows: {', '.join(sorted(lost))}")
    few, _ = broadcast_if_small(wanted.filter("n IS NOT NULL"))
    cell = F.col("cells")
    pairs = (
        lookup_rows(lookups, seq).join(few, "ref_table")
        .select(
            "ref_table", "key_column", "value_column", "n", "seq",
            cell[F.col("key_column")].alias("map_key"), cell[F.col("value_column")].alias("map_value"),
        )
        .filter(_filled(F.col("map_key")) & _filled(F.col("map_value")))
    )
    each = ["ref_table", "key_column", "value_column", "n"]
    place = F.row_number().over(Window.partitionBy(*each).orderBy("seq"))
    first = pairs.filter(F.col("n") > full_rows).withColumn("_place", place).filter(F.col("_place") <= sampled_rows)
    kept = pairs.filter(F.col("n") <= full_rows).unionByName(first.drop("_place"))
    return kept.groupBy(*each, "map_key").agg(F.max_by("map_value", "seq").alias("map_value")).select(
        "ref_table", "key_column", "map_key", "map_value", F.col("n").cast("bigint").alias("n"),
        F.when(F.col("n") > full_rows, F.col("value_column")).alias("value_column"),
    )
