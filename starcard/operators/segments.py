"""Ordered work that stays spread out when one key holds a large share of the rows.

A window over ``partitionBy(key)`` puts the whole key in one task. Here the rows are range
partitioned on (key, order columns): the range cut falls inside a hot key as readily as between
keys. Each segment is worked on alone and what crosses a segment border travels in a table with
one row per segment, so it is bounded by the number of partitions.

The order columns must end in something unique, or the order is not defined.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starcard.session import shuffle_width, stored

SEG = "_seg"


def _columns(order: list[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def range_segments(df: DataFrame, order: list[str | Column], parts: int | None = None) -> DataFrame:
    """Add ``_seg``, an increasing segment number along ``order``, fixed by writing it down."""
    width = parts or shuffle_width(df.sparkSession)
    ranged = df.repartitionByRange(width, *_columns(order)).withColumn(SEG, F.spark_partition_id())
    return stored(ranged, "segments")


def dense_number(
    df: DataFrame, order: list[str | Column], name: str, start: int = 1, parts: int | None = None
) -> DataFrame:
    """Number all rows start, start+1, ... along ``order`` without one global sort task."""
    seg = range_segments(df, order, parts)
    before = Window.orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1)
    base = seg.groupBy(SEG).count().select(
        SEG, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base")
    )
    local = F.row_number().over(Window.partitionBy(SEG).orderBy(*_columns(order)))
    return (
        seg.withColumn("_n", local)
        .join(F.broadcast(base), SEG)
        .withColumn(name, F.col("_base") + F.col("_n") + F.lit(start - 1))
        .drop(SEG, "_n", "_base")
    )


def _same(a: str, b: str, columns: list[str]) -> Column:
    """Equal in all ``columns``, null being equal to null, as a window's partitions have it."""
    out = F.lit(True)
    for c in columns:
        out &= F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def spread_join(
    rows: DataFrame, per_group: DataFrame, on: list[str], by: str | None = None, nulls: bool = True
) -> DataFrame:
    """Bring one row per group to all rows of the group, with hot groups spread over many tasks.

    Rows are joined on (share, group) instead of the group alone. A share is the row's segment,
    or a hash of the unique column ``by``; the table in between has one row per share and group.
    Null keys form a group of their own, or with ``nulls=False`` match nothing and go.
    """
    if by is not None:
        width = shuffle_width(rows.sparkSession)
        rows = rows.withColumn(SEG, F.pmod(F.xxhash64(by), F.lit(width)).cast("int"))
    if not nulls:
        shares = rows.select(SEG, *on).distinct().join(per_group, on)
        return rows.join(shares, [SEG, *on])
    added = [c for c in per_group.columns if c not in on]
    shares = rows.select(SEG, *on).distinct().alias("a").join(per_group.alias("b"), _same("a", "b", on)).select(
        F.col(f"a.{SEG}"), *[F.col(f"a.{c}") for c in on], *[F.col(f"b.{c}") for c in added]
    )
    return rows.alias("a").join(shares.alias("b"), _same("a", "b", [SEG, *on])).select(
        "a.*", *[F.col(f"b.{c}") for c in added]
    )


def _parts(value: Column, fractional: bool, scale: int) -> dict[str, Column]:
    """What a sum of ``value`` consists of; every part adds and subtracts exactly."""
    if not fractional:
        return {"n": value.isNotNull().cast("long"), "x": value}
    value = value.cast("double")
    plain = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))
    return {
        "n": value.isNotNull().cast("long"),
        "x": F.when(plain, value).try_cast(f"decimal(38,{scale})"),
        "nan": F.coalesce(F.isnan(value), F.lit(False)).cast("long"),
        "up": F.coalesce(value == F.lit(float("inf")), F.lit(False)).cast("long"),
        "down": F.coalesce(value == F.lit(float("-inf")), F.lit(False)).cast("long"),
    }


def _whole(part: Callable[[str], Column], fractional: bool) -> Column:
    """The sum from its parts; null without a value."""
    if not fractional:
        return F.when(part("n") > 0, part("x"))
    odd = (part("nan") > 0) | ((part("up") > 0) & (part("down") > 0))
    return (
        F.when(part("n") == 0, F.lit(None).cast("double")).when(odd, F.lit(float("nan")))
        .when(part("up") > 0, F.lit(float("inf"))).when(part("down") > 0, F.lit(float("-inf")))
        .otherwise(F.coalesce(part("x").cast("double"), F.lit(0.0)))
    )


def _fractional(df: DataFrame, value: Column) -> bool:
    return df.select(value.alias("v")).schema["v"].dataType.typeName() in ("double", "float")


def running_sums(
    df: DataFrame,
    key: str,
    order: list[str | Column],
    sums: dict[str, Column],
    parts: int | None = None,
    keep_segment: bool = False,
    scale: int = 10,
) -> DataFrame:
    """Inclusive running sums per ``key`` along ``order``; ``sums`` maps new names to terms.

    As over a window, null keys are one group, null terms add nothing, and a sum is null as long as no term was given.
    Floating-point terms are summed as decimals of ``scale`` places (exact for absolute values below 10^(38 - scale) and one
    place less); NaN and infinities count apart. ``keep_segment`` leaves ``_seg`` on the rows for a later ``spread_join``.
    """
    kinds = {name: _fractional(df, term) for name, term in sums.items()}
    columns = {}
    for name, term in sums.items():
        for part, c in _parts(term, kinds[name], scale).items():
            columns[name, part] = c
    cell = {at: f"_t{i}" for i, at in enumerate(columns)}
    seg = range_segments(df, [key, *order], parts)
    seg = seg.select("*", *[c.alias(cell[at]) for at, c in columns.items()])
    name_of = F.struct(F.col(key).isNotNull().alias("f"), F.col(key).alias("v"))  # nulls first, as they are dealt
    edges = (
        seg.groupBy(SEG, key).agg(*[F.sum(t).alias(t) for t in cell.values()])
        .groupBy(SEG)
        .agg(
            F.min(name_of).alias("_first"), F.max(name_of).alias("_last"),
            *[F.max_by(t, name_of).alias(t) for t in cell.values()],
        )
    )
    along = Window.partitionBy("_last").orderBy(SEG).rowsBetween(Window.unboundedPreceding, 0)
    totals = edges.select(SEG, "_first", "_last", *[F.sum(t).over(along).alias(t) for t in cell.values()])
    step = Window.orderBy(SEG)
    same = F.lag("_last").over(step)["v"].eqNullSafe(F.col("_first")["v"]) & (F.lag(SEG).over(step).isNotNull())
    carry = totals.select(
        SEG, F.col("_first")["v"].alias("_ck"), same.alias("_cs"),
        *[F.lag(t).over(step).alias(f"_c{t}") for t in cell.values()],
    )
    local = Window.partitionBy(SEG, key).orderBy(*_columns(order)).rowsBetween(Window.unboundedPreceding, 0)
    spread = seg.select("*", *[F.sum(t).over(local).alias(f"_l{t}") for t in cell.values()]).join(F.broadcast(carry), SEG)
    on = F.col("_cs") & F.col(key).eqNullSafe(F.col("_ck"))

    def summed(name: str) -> Callable[[str], Column]:
        def part(p: str) -> Column:
            t = cell[name, p]
            own, before = F.col(f"_l{t}"), F.when(on, F.col(f"_c{t}"))
            return F.coalesce(own + before, own, before)

        return part

    return spread.select(
        *df.columns, *([SEG] if keep_segment else []), *[_whole(summed(n), kinds[n]).alias(n) for n in sums],
    )


def recent_sums(
    df: DataFrame, key: str, order: list[str | Column], value: str, width: int, name: str, parts: int | None = None,
    segmented: bool = False,
) -> DataFrame:
    """Sum over a row and the ``width - 1`` rows before it (ROWS frame), per ``key`` along ``order``.

    A segment takes the last rows of the segments before it along, so no frame is a difference of long sums.
    ``segmented``: ``df`` has kept ``_seg`` from an operator with the same key and order.
    """
    seg = df if segmented else range_segments(df, [key, *order], parts)
    full = [F.col(key), *_columns(order)]
    place = F.row_number().over(Window.partitionBy(SEG).orderBy(*full))
    last = F.count(F.lit(1)).over(Window.partitionBy(SEG))
    cell = F.struct(F.col(key).alias("k"), F.col(value).alias("v"))
    tails = (
        seg.withColumn("_n", place).withColumn("_l", last).filter(F.col("_l") - F.col("_n") < width - 1)
        .groupBy(SEG).agg(F.array_sort(F.collect_list(F.struct(F.col("_n").alias("n"), cell.alias("c")))).alias("_tail"))
    )
    before = Window.orderBy(SEG).rowsBetween(1 - width, -1)
    segs = seg.select(SEG).distinct().join(tails, SEG, "left").select(
        SEG, F.transform(F.flatten(F.collect_list("_tail").over(before)), lambda t: t["c"]).alias("_before")
    )
    own = Window.partitionBy(SEG, key).orderBy(*_columns(order))
    placed = seg.withColumn("_r", F.row_number().over(own)).withColumn(
        "_s", F.sum(value).over(own.rowsBetween(1 - width, 0))
    ).join(F.broadcast(segs), SEG)
    mine = F.transform(F.filter("_before", lambda t: t["k"].eqNullSafe(F.col(key))), lambda t: t["v"])
    missing = F.lit(width) - F.col("_r")
    taken = F.filter(F.slice(mine, F.greatest(F.size(mine) - missing + 1, F.lit(1)), missing), lambda v: v.isNotNull())
    zero = F.lit(0).cast(placed.schema["_s"].dataType)
    extra = F.when((missing > 0) & (F.size(taken) > 0), F.aggregate(taken, zero, lambda a, v: (a + v).cast(placed.schema["_s"].dataType)))
    keep = [c for c in df.columns if c != SEG] + ([SEG] if segmented else [])
    return placed.select(*keep, F.coalesce(F.col("_s") + extra, F.col("_s"), extra).alias(name))


def neighbours(
    df: DataFrame,
    key: str,
    order: list[str | Column],
    value: str,
    back: str = "lag",
    ahead: str = "lead",
    parts: int | None = None,
    keep_segment: bool = False,
) -> DataFrame:
    """Previous and next ``value`` per ``key`` along ``order`` (null at the ends of a key)."""
    seg = range_segments(df, [key, *order], parts)
    full = [F.col(key), *_columns(order)]
    pos = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(full)])
    cell = F.struct(F.col(key).alias("k"), F.col(value).alias("v"))
    ends = seg.groupBy(SEG).agg(
        F.min_by(cell, pos).alias("_head"), F.max_by(cell, pos).alias("_tail")
    )
    step = Window.orderBy(SEG)
    ends = ends.select(
        SEG, F.lag("_tail").over(step).alias("_prev"), F.lead("_head").over(step).alias("_next")
    )
    local = Window.partitionBy(SEG).orderBy(*full)
    inside = seg.select(
        "*", F.lag(cell).over(local).alias("_b"), F.lead(cell).over(local).alias("_a")
    ).join(F.broadcast(ends), SEG)
    before = F.coalesce(F.col("_b"), F.col("_prev"))
    after = F.coalesce(F.col("_a"), F.col("_next"))
    own = F.col(key)
    return inside.select(
        *df.columns,
        *([SEG] if keep_segment else []),
        F.when(before["k"].eqNullSafe(own), before["v"]).alias(back),
        F.when(after["k"].eqNullSafe(own), after["v"]).alias(ahead),
    )


def range_frame_sums(
    df: DataFrame,
    key: str,
    at: str,
    value: Column,
    start: Column,
    end: Column,
    name: str,
    open_start: bool = False,
    by: str | None = None,
    scale: int = 10,
) -> DataFrame:
    """Sum of ``value`` over rows of the same key with time from ``at+start`` to ``at+end``.

    One row per (key, at), or per value of the unique column ``by``. No pairs are formed: every frame is the difference
    of two exact running sums, read off at probe points placed among the rows. A frame without a value is null.
    """
    fractional = _fractional(df, value)
    parts = _parts(value, fractional, scale)
    level = df.select(key, at, *([by] if by else []), *[c.alias(f"_v{p}") for p, c in parts.items()])
    if by is None:
        level = level.groupBy(key, at).agg(*[F.sum(f"_v{p}").alias(f"_v{p}") for p in parts])
    group = [by] if by else [key, at]
    kept = list(dict.fromkeys([key, at, *group]))
    none = [F.lit(0).cast(level.schema[f"_v{p}"].dataType).alias(f"_v{p}") for p in parts]

    def points(place: Column, kind: int, weight: int) -> DataFrame:
        values = none if weight else [F.col(f"_v{p}") for p in parts]
        return level.select(*kept, place.alias("_p"), F.lit(kind).alias("_o"), F.lit(weight).alias("_w"), *values)

    marks = points(F.col(at), 1, 0).unionByName(points(F.col(at) + start, 2 if open_start else 0, -1)).unionByName(
        points(F.col(at) + end, 3, 1)
    )
    cum = running_sums(marks, key, ["_p", "_o"], {f"_c{p}": F.col(f"_v{p}") for p in parts}).filter("_w <> 0")
    found = cum.groupBy(*group).agg(
        *[F.sum(F.when(F.col("_w") > 0, F.col(f"_c{p}")).otherwise(-F.col(f"_c{p}"))).alias(f"_d{p}") for p in parts]
    )
    return found.select(*group, _whole(lambda p: F.col(f"_d{p}"), fractional).alias(name))
