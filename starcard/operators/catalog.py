"""Dictionary tables to table cards: keys, references, comments, skip rules, lookup columns.

All inputs carry ``owner``; a table of a database has at most some hundred columns, so work
grouped by (owner, table) stays small whatever share of the tables one owner holds.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starcard.functions.text import clean_text, fk_parts, strip
from starcard.functions.types import type_string
from starcard.session import broadcast_if_small, cut, shuffled, stored
from starcard.rules import (
    FACT_ROWS,
    KEY_NAMES,
    KEY_SUFFIXES,
    LABEL_NAMES,
    LABEL_SUFFIXES,
    LOOKUP_ROWS,
    LOOKUP_SCHEMA,
    SKIP_RULES,
    SYSTEM_TABLE_PATTERNS,
)

TABLE = ["owner", "table_name"]


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def user_tables(tables: DataFrame, owner: str | None = None) -> DataFrame:
    """Tables of one owner (or all) without the source database's own."""
    name = F.col("table_name")
    kept = tables.filter(~any_of([name.like(p) for p in SYSTEM_TABLE_PATTERNS]))
    return kept.filter(F.col("owner") == owner.upper()) if owner else kept


def is_skipped(name: Column, schema: Column, rules: list[tuple] = SKIP_RULES) -> Column:
    """True for operational tables; a name on the keep list is never skipped."""
    upper = F.upper(name)
    form = {"prefix": "^(?:{})", "suffix": r"(?:{})\z", "contains": "(?:{})"}
    grouped: dict[tuple[str, str | None], list[str]] = {}
    for kind, pattern, only in rules:
        grouped.setdefault((kind, only), []).append(pattern)
    hits = []
    for (kind, only), patterns in grouped.items():
        if kind == "keep":
            continue
        if kind == "exact":
            hit = upper.isin(patterns)
        else:
            hit = upper.rlike(form[kind].format("|".join(re.escape(p) for p in patterns)))
        hits.append(hit if only is None else hit & (schema == only))
    return ~upper.isin(grouped.get(("keep", None), [])) & any_of(hits)


def keyed_columns(constraints: DataFrame, columns: DataFrame) -> DataFrame:
    """Constraints with their columns: the one join that primary and foreign keys both start from."""
    named = constraints.select(
        "owner", "constraint_name", "constraint_type", "table_name", "r_owner", "r_constraint_name",
        F.col("seq").alias("constraint_seq"),
    )
    held = columns.select(
        "owner", "constraint_name", F.col("table_name").alias("column_table"), "column_name", "position", "seq"
    )
    return named.join(shuffled(held), ["owner", "constraint_name"])


def resolve_foreign_keys(keyed: DataFrame) -> DataFrame:
    """One row per referencing column, matched to the referenced column of the same position.

    Referenced constraints are unique per (owner, name, position), so a constraint that most
    schemas point at can only be hot on the referencing side, where adaptive execution splits it.
    """
    keyed = keyed.filter(F.col("table_name") == F.col("column_table"))
    target = keyed.select(
        F.col("owner").alias("r_owner"),
        F.col("constraint_name").alias("r_constraint_name"),
        F.col("table_name").alias("referenced_table"),
        "position",
        F.col("column_name").alias("referenced_column"),
    )
    source = keyed.filter(F.col("constraint_type") == "R").select(
        "owner", "constraint_name", "table_name", "position", "column_name", "r_owner", "r_constraint_name"
    )
    return source.join(shuffled(target), ["r_owner", "r_constraint_name", "position"]).drop("r_constraint_name")


def foreign_key_map(resolved: DataFrame) -> DataFrame:
    """(owner, table, column) -> ``SCHEMA.TABLE.COLUMN``; the last constraint by name wins."""
    fk = F.concat_ws(".", "r_owner", "referenced_table", "referenced_column")
    return resolved.groupBy(*TABLE, "column_name").agg(
        F.max_by(fk, F.struct("constraint_name", "position")).alias("fk")
    )


def primary_keys(keyed: DataFrame) -> DataFrame:
    """Columns of each table's first primary constraint, by position, as ``primary_key``."""
    spot = F.struct(
        "constraint_seq", F.coalesce("position", F.lit(0)).alias("p"), "seq", "column_name"
    )
    spots = (
        keyed.filter(F.col("constraint_type") == "P")
        .groupBy(*TABLE)
        .agg(F.sort_array(F.collect_list(spot)).alias("k"))
    )
    first = F.filter("k", lambda x: x["constraint_seq"] == F.col("k")[0]["constraint_seq"])
    return spots.select(*TABLE, F.transform(first, lambda x: x["column_name"]).alias("primary_key"))


def declared_type() -> Column:
    return type_string(
        F.col("data_type"), F.col("data_precision"), F.col("data_scale"),
        F.col("char_length"), F.col("data_length"),
    )


def described(df: DataFrame, comments: DataFrame, on: list[str]) -> DataFrame:
    """Left join comments as ``description``; an empty comment counts as none."""
    text = comments.select(*on, F.nullif(F.col("comments"), F.lit("")).alias("description"))
    return df.join(shuffled(text), on, "left")


def first_row_counts(tables: DataFrame) -> DataFrame:
    """(owner, table) -> row count of the first statistics row."""
    return tables.groupBy(*TABLE).agg(F.min_by(F.struct("num_rows"), "seq")["num_rows"].alias("row_count"))


def _priority(name: Column, tbl: Column, names: list[str], suffixes: list[str]) -> Column:
    """Rank of a column as a candidate: table name + suffix, exact name, any name + suffix."""
    tests = (
        [name == F.concat(tbl, F.lit(s)) for s in suffixes]
        + [name == n for n in names]
        + [name.endswith(s) for s in suffixes]
    )
    out = F.when(tests[0], 0)
    for i, test in enumerate(tests[1:], 1):
        out = out.when(test, i)
    return out


def lookup_columns(columns: DataFrame) -> DataFrame:
    """(owner, table) -> key and label column of a lookup; both null when they cannot be told."""
    name, tbl = F.upper("column_name"), F.upper("table_name")
    ranked = columns.select(
        *TABLE, "seq", "column_name",
        _priority(name, tbl, KEY_NAMES, KEY_SUFFIXES).alias("kp"),
        _priority(name, tbl, LABEL_NAMES, LABEL_SUFFIXES).alias("vp"),
    )

    def best(prio: str) -> Column:
        return F.min(
            F.when(F.col(prio).isNotNull(), F.struct(F.col(prio), F.col("seq"), F.col("column_name")))
        )["column_name"]

    picked = ranked.groupBy(*TABLE).agg(
        best("kp").alias("k"), best("vp").alias("v"), F.count(F.lit(1)).alias("n"),
        F.min_by("column_name", "seq").alias("c1"), F.max_by("column_name", "seq").alias("c2"),
    )

    def other(than: str) -> Column:
        return F.when(F.col("c1") == F.col(than), F.col("c2")).otherwise(F.col("c1"))

    two = F.col("n") == 2
    no_k, no_v = F.col("k").isNull(), F.col("v").isNull()
    key = F.when(two & no_k & no_v, F.col("c1")).when(two & no_k, other("v")).otherwise(F.col("k"))
    label = F.when(two & no_k & no_v, F.col("c2")).when(two & no_v, other("k")).otherwise(F.col("v"))
    both = picked.select(*TABLE, key.alias("key_column"), label.alias("value_column"))
    good = F.col("key_column") != F.col("value_column")
    return both.select(
        *TABLE,
        F.when(good, F.col("key_column")).alias("key_column"),
        F.when(good, F.col("value_column")).alias("value_column"),
    )


def usable_lookups(
    columns: DataFrame, row_counts: DataFrame, lookup_schema: str, exported: list[str] | None = None
) -> DataFrame:
    """Lookup tables that yield a value map: one row each, with all their column names.

    A lookup needs a label column and a row count. ``exported`` names the lookups whose rows are
    at hand (all when null).
    """
    mine = columns.filter(F.col("owner") == lookup_schema)
    usable = lookup_columns(mine).filter(F.col("value_column").isNotNull())
    names = mine.groupBy(*TABLE).agg(F.collect_list("column_name").alias("real"))
    counted = row_counts.filter((F.col("owner") == lookup_schema) & F.col("row_count").isNotNull())
    usable = usable.join(counted, TABLE).join(names, TABLE).select(
        F.col("table_name").alias("ref_table"), F.col("key_column").alias("picked"), "value_column",
        F.col("row_count").alias("n"), "real",
    )
    return usable if exported is None else usable.filter(F.col("ref_table").isin(exported))


def with_lookups(fk: DataFrame, lookups: DataFrame, lookup_schema: str) -> DataFrame:
    """Add ``ref`` (lookup, key, label, rows) to references whose lookup yields a value map.

    The key is the column the reference really points at when the lookup has it. Lookups are few
    (checked), so they travel; hot lookups are then no matter.
    """
    few, _ = broadcast_if_small(cut(lookups))
    part = fk_parts(F.col("fk"))
    mine = (part["schema"] == lookup_schema) & (F.col("owner") != lookup_schema)
    key = F.when(F.array_contains("real", part["column"]), part["column"]).otherwise(F.col("picked"))
    ref = F.struct("ref_table", key.alias("key_column"), "value_column", "n")
    joined = fk.join(few, mine & (part["table"] == F.col("ref_table")), "left")
    return joined.select(*fk.columns, F.when(F.col("ref_table").isNotNull(), ref).alias("ref"))


def one_map_per_lookup(references: DataFrame) -> DataFrame:
    """Of the columns of a table that point at one lookup, the first decides the map's key."""
    return references.groupBy(*TABLE, "ref_table").agg(
        F.min_by(F.struct("key_column", "value_column", "n"), "column_id").alias("m")
    ).select(*TABLE, "ref_table", "m.*")


def assemble(
    tables: DataFrame,
    columns: DataFrame,
    constraints: DataFrame,
    constraint_columns: DataFrame,
    lookup_schema: str = LOOKUP_SCHEMA,
    filter_tables: bool = True,
    exported: list[str] | None = None,
    foreign_keys: DataFrame | None = None,
) -> DataFrame:
    """One row per table: owner, table_name, primary_key, row_count, description, cols.

    Columns, references, keys and statistics are each brought to one row per (owner, table) and
    joined on just that, so every input is shuffled once on the way here. ``foreign_keys`` (owner, table_name, column_name, fk) are
    references that are resolved already.
    """
    keyed = stored(keyed_columns(constraints, constraint_columns), "keyed-columns")
    row_counts = first_row_counts(tables)
    fk = with_lookups(
        foreign_key_map(resolve_foreign_keys(keyed)) if foreign_keys is None else foreign_keys,
        usable_lookups(columns, row_counts, lookup_schema, exported),
        lookup_schema,
    )
    fks = fk.groupBy(*TABLE).agg(
        F.map_from_entries(F.collect_list(F.struct("column_name", F.struct("fk", "ref")))).alias("fks")
    )
    kept = columns
    if filter_tables:
        kept = columns.filter(~is_skipped(F.col("table_name"), F.col("owner")))
    cell = F.struct(
        F.coalesce("column_id", F.lit(0)).alias("column_id"), "seq", F.col("column_name").alias("name"),
        declared_type().alias("type"),
        F.coalesce(F.col("nullable") == "Y", F.lit(False)).alias("nullable"),
        F.nullif(F.col("comments"), F.lit("")).alias("description"),
    )
    listed = kept.groupBy(*TABLE).agg(F.sort_array(F.collect_list(cell)).alias("cols"))
    facts = table_facts(tables)
    joined = (
        listed.join(shuffled(fks), TABLE, "left")
        .join(shuffled(primary_keys(keyed)), TABLE, "left")
        .join(shuffled(facts), TABLE, "left")
    )
    target = F.try_element_at
    return joined.select(
        *TABLE,
        F.coalesce("primary_key", F.array().cast("array<string>")).alias("primary_key"),
        "row_count", "description",
        F.transform(
            "cols",
            lambda c: c.withField("fk", target("fks", c["name"])["fk"]).withField(
                "ref", target("fks", c["name"])["ref"]
            ),
        ).alias("cols"),
    )


def table_facts(tables: DataFrame) -> DataFrame:
    """Statistics and comment per table: of the first row with the name, and of the last."""
    return tables.groupBy(*TABLE).agg(
        F.min_by(F.struct("num_rows"), "seq")["num_rows"].alias("row_count"),
        F.nullif(F.max_by(F.struct("comments"), "seq")["comments"], F.lit("")).alias("description"),
    )


def table_heads(tables: DataFrame, columns: DataFrame, filter_tables: bool = True) -> DataFrame:
    """Names, row count and comment of the tables that get a card, without assembling cards."""
    kept = columns
    if filter_tables:
        kept = columns.filter(~is_skipped(F.col("table_name"), F.col("owner")))
    names = kept.select(*TABLE).distinct()
    return names.join(shuffled(table_facts(tables)), TABLE, "left").select(
        *TABLE, F.concat_ws(".", *TABLE).alias("qualified_name"), "row_count", "description"
    )


def table_rows(assembled: DataFrame) -> DataFrame:
    return assembled.select(
        *TABLE, F.concat_ws(".", *TABLE).alias("qualified_name"), "primary_key", "row_count", "description"
    )


def column_rows(assembled: DataFrame) -> DataFrame:
    c = F.col("c")
    return assembled.select(*TABLE, F.explode("cols").alias("c")).select(
        *TABLE, c["name"].alias("column_name"), c["column_id"].alias("column_id"), c["type"].alias("type"),
        c["nullable"].alias("nullable"), c["description"].alias("description"), c["fk"].alias("fk"),
        c["ref"].alias("ref"),
    )


def reference_rows(assembled: DataFrame) -> DataFrame:
    """Columns that point at a lookup with a value map."""
    return column_rows(assembled).filter(F.col("ref").isNotNull()).select(
        *TABLE, "column_name", "column_id", "ref.*"
    )


def size_class(rows: Column) -> Column:
    """Millions of rows: fact. Under a thousand: lookup."""
    return F.when(rows >= FACT_ROWS, "fact").when(rows < LOOKUP_ROWS, "lookup").otherwise("other")


def fill_descriptions(assembled: DataFrame, table_texts: DataFrame, column_texts: DataFrame) -> DataFrame:
    """Fill empty descriptions of assembled tables only; ``filled`` marks tables and columns.

    ``table_texts`` (owner or null, table_name, text): the owner's own text goes before the one
    without owner. ``column_texts`` (table_name, column_name, text) ignores the schema. Each table
    is met by one row of column texts, so columns are filled where they are, inside the card.
    """
    up_owner, up_table = F.upper("owner"), F.upper("table_name")
    own = table_texts.filter(F.col("owner").isNotNull()).select(
        F.col("owner").alias("_o"), F.col("table_name").alias("_t"), F.col("text").alias("_own")
    )
    shared = table_texts.filter(F.col("owner").isNull()).select(
        F.col("table_name").alias("_s"), F.col("text").alias("_shared")
    )
    per_table = column_texts.groupBy(F.col("table_name").alias("_c")).agg(
        F.map_from_entries(F.collect_list(F.struct("column_name", "text"))).alias("_texts")
    )

    def missing(text: Column) -> Column:
        return F.coalesce(text, F.lit("")) == ""

    def filled(c: Column) -> Column:
        text = F.try_element_at("_texts", F.upper(c["name"]))
        now = missing(c["description"]) & text.isNotNull()
        return c.withField("filled", now).withField("description", F.when(now, text).otherwise(c["description"]))

    text = F.coalesce("_own", "_shared")
    now = missing(F.col("description")) & text.isNotNull()
    return (
        assembled.join(shuffled(own), (up_owner == F.col("_o")) & (up_table == F.col("_t")), "left")
        .join(shared, up_table == F.col("_s"), "left")
        .join(per_table, up_table == F.col("_c"), "left")
        .withColumn("cols", F.transform("cols", filled))
        .withColumn("filled", now)
        .withColumn("description", F.when(now, text).otherwise(F.col("description")))
        .drop("_o", "_t", "_own", "_s", "_shared", "_c", "_texts")
    )


def _latest(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The last row of each key. Only row numbers are aggregated; texts wait for the winners."""
    last = rows.groupBy(*keys).agg(F.max(seq).alias("_last"))
    named = last.select("_last", *[F.col(k).alias(f"_k_{k}") for k in keys])
    match = F.col(seq) == F.col("_last")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return rows.join(named, match, "left_semi").drop(seq)


def description_sheets(
    table_sheet: DataFrame, column_sheet: DataFrame, seq: str = "row_no"
) -> tuple[DataFrame, DataFrame]:
    """Sheets (Owner, Name, Comment) and (Table, Name, Comment) to lookup frames.

    Names are trimmed and upper-cased, rows without a comment dropped, the later duplicate wins.
    """
    def key(c: str) -> Column:
        return F.upper(strip(F.col(c)))

    t = table_sheet.select(
        F.upper(clean_text(F.col("Owner"))).alias("owner"), key("Name").alias("table_name"),
        clean_text(F.col("Comment")).alias("text"), seq,
    ).filter((F.col("table_name") != "") & F.col("text").isNotNull())
    c = column_sheet.select(
        key("Table").alias("table_name"), key("Name").alias("column_name"),
        clean_text(F.col("Comment")).alias("text"), seq,
    ).filter((F.col("table_name") != "") & (F.col("column_name") != "") & F.col("text").isNotNull())
    return _latest(t, ["owner", "table_name"], seq), _latest(c, ["table_name", "column_name"], seq)
