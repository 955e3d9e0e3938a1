"""Nested table cards: building, projecting and rendering them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starcard.functions.text import normalize_name, safe_id
from starcard.functions.types import affinity
from starcard.operators.catalog import TABLE
from starcard.rules import NOISE_VALUE_MAPS
from starcard.session import shuffled

_MAPS = "map<string,struct<n:bigint,value_column:string,entries:map<string,string>>>"
CARD_SCHEMA = """
table_metadata struct<qualified_name: string, schema_name: string, name: string, description: string,
  synonyms: array<string>, primary_key: array<string>, row_count: bigint>,
columns array<struct<name: string, type: string, description: string, nullable: boolean, fk: string,
  value_map_ref: string>>,
special_handling map<string, string>,
value_maps map<string, struct<n: bigint, value_column: string, entries: map<string, string>>>
"""


def _by_name(a: Column, b: Column) -> Column:
    """Order of value maps inside a card (maps themselves cannot be compared)."""
    return F.when(a["ref_table"] < b["ref_table"], -1).when(a["ref_table"] > b["ref_table"], 1).otherwise(0)


def nest(assembled: DataFrame, maps: DataFrame | None = None) -> DataFrame:
    """Cards from assembled tables. ``maps``: owner, table_name, ref_table, n, value_column, entries."""
    cards = assembled
    body = F.struct("n", "value_column", "entries")
    if maps is not None:
        per_table = maps.groupBy(*TABLE).agg(
            F.map_from_entries(F.array_sort(F.collect_list(F.struct("ref_table", body)), _by_name)).alias("value_maps")
        )
        cards = cards.join(shuffled(per_table), TABLE, "left")
    else:
        cards = cards.withColumn("value_maps", F.lit(None).cast(_MAPS))
    meta = F.struct(
        F.concat_ws(".", *TABLE).alias("qualified_name"), F.col("owner").alias("schema_name"),
        F.col("table_name").alias("name"), "description",
        F.array().cast("array<string>").alias("synonyms"), "primary_key", "row_count",
    )
    cols = F.transform(
        "cols",
        lambda c: F.struct(
            c["name"].alias("name"), c["type"].alias("type"), c["description"].alias("description"),
            c["nullable"].alias("nullable"), c["fk"].alias("fk"),
            c["ref"]["ref_table"].alias("value_map_ref"),
        ),
    )
    return cards.select(
        meta.alias("table_metadata"), cols.alias("columns"),
        F.lit(None).cast("map<string,string>").alias("special_handling"), "value_maps",
    )


def nested_entries(values: DataFrame) -> DataFrame:
    """Long value maps (ref_table, key_column, map_key, map_value) to one map per lookup and key."""
    return values.groupBy("ref_table", "key_column").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("map_key", "map_value")))).alias("entries")
    )


def flatten(cards: DataFrame) -> DataFrame:
    """One row per column of every card."""
    return cards.select(
        "table_metadata.*", F.posexplode("columns").alias("pos", "c"), "value_maps"
    ).select(
        "qualified_name", "row_count", F.array_join("primary_key", ",").alias("primary_key"),
        F.col("description").alias("table_description"), "pos",
        F.col("c.name").alias("column_name"), F.col("c.type").alias("type"),
        F.col("c.nullable").alias("nullable"), F.col("c.description").alias("description"),
        F.col("c.fk").alias("fk"), F.col("c.value_map_ref").alias("value_map_ref"),
    )


def retype(cards: DataFrame, source: str, target: str) -> DataFrame:
    """Column types mapped for oracle -> sqlite; any other pair leaves the cards as they are."""
    if (source.lower(), target.lower()) != ("oracle", "sqlite"):
        return cards
    return cards.withColumn(
        "columns", F.transform("columns", lambda c: c.withField("type", affinity(c["type"])))
    )


def _text_or_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def search_documents(cards: DataFrame) -> DataFrame:
    """Search fields of every card; ``doc_seq`` (see ``number_documents``) makes the id."""
    meta, cols = F.col("table_metadata"), F.col("columns")
    names = F.array_join(
        F.filter(F.transform(cols, lambda c: normalize_name(c["name"])), lambda n: n != ""), " "
    )
    refs = F.array_join(
        F.transform(
            F.filter(cols, lambda c: F.coalesce(c["fk"], F.lit("")) != ""),
            lambda c: F.concat(c["name"], F.lit(" references "), c["fk"]),
        ),
        " ",
    )
    texts = F.array_join(
        F.transform(
            F.filter(cols, lambda c: F.coalesce(c["description"], F.lit("")) != ""),
            lambda c: F.concat(c["name"], F.lit(": "), c["description"]),
        ),
        " ",
    )
    content = F.concat_ws(
        " ", *[_text_or_null(p) for p in (meta["name"], meta["description"], names, refs, texts)]
    )
    return cards.select(
        meta["schema_name"].alias("schema_name"),
        meta["name"].alias("table_name"),
        meta["qualified_name"].alias("qualified_name"),
        F.coalesce(meta["description"], F.lit("")).alias("description"),
        F.transform(cols, lambda c: c["name"]).alias("column_names"),
        names.alias("normalized_column_names"),
        texts.alias("column_descriptions"),
        content.alias("searchable_content"),
        F.coalesce(meta["row_count"], F.lit(0)).alias("row_count"),
        F.size(cols).alias("column_count"),
    )


def document_id(schema: Column, table: Column, index: Column) -> Column:
    return F.concat_ws("_", safe_id(schema), safe_id(table), index.cast("string"))


def summary(cards: DataFrame) -> DataFrame:
    """Primary key and first columns of a card as display text."""
    meta, cols = F.col("table_metadata"), F.col("columns")
    shown = F.array_join(
        F.transform(
            F.slice(cols, 1, 6), lambda c: F.concat(c["name"], F.lit(" ("), c["type"], F.lit(")"))
        ),
        ", ",
    )
    keys = _text_or_null(F.array_join(meta["primary_key"], ", "))
    return cards.select(
        meta["qualified_name"].alias("qualified_name"),
        F.coalesce(keys, F.lit("—")).alias("keys"),
        F.concat(shown, F.when(F.size(cols) > 6, " …").otherwise("")).alias("shown"),
    )


def selector_json(cards: DataFrame, noise: list[str] = NOISE_VALUE_MAPS) -> DataFrame:
    """A card as JSON without redundant fields and without technical value maps."""
    meta = F.col("table_metadata").dropFields("schema_name", "name", "synonyms")
    cols = F.transform("columns", lambda c: c.dropFields("value_map_ref"))
    upper = [n.upper() for n in noise]
    maps = F.map_filter("value_maps", lambda k, _: ~F.upper(k).isin(upper))
    body = F.struct(meta.alias("table_metadata"), cols.alias("columns"), maps.alias("value_maps"))
    return cards.select(
        F.col("table_metadata.qualified_name").alias("qualified_name"),
        F.to_json(body, {"ignoreNullFields": "false"}).alias("card_json"),
    )
