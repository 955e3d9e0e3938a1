"""Whole dictionary exports: one multi-line JSON object per schema with twelve arrays, to rows and on to card assembly.

A file holds one object, or many with a record separator between or before them (JSON text sequences): a folder of millions of files is
slow to list and to write, and text in JSON can't hold the separator itself.

Exports differ: a database adds columns to its views or leaves some out, and an array may be null. So a file is parsed as a variant, its
arrays are taken apart by position, and every field is read by name with the type it should have; what is missing or doesn't
fit is null. Positions are kept, as the first or the last row of a name decides in places.

An object is one row until its arrays are taken apart; from there on rows are dealt freely. All arrays are written in one pass, in a folder
each, so reading one of them touches nothing else.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starcard.operators.catalog import TABLE, assemble
from starcard.rules import LOOKUP_SCHEMA
from starcard.session import scratch_path, shuffled

#: Between the objects of a file (RFC 7464).
SEPARATOR = "\x1e"

# --- fixed values: arrays of an export and their fields -----------------------------------------
ARRAYS = {
    "tables": "owner string, table_name string, tablespace_name string, temporary string, partitioned string, compression string, "
    "logging string, num_rows bigint, last_analyzed string",
    "table_comments": "owner string, table_name string, comments string",
    "columns": "owner string, table_name string, column_name string, column_id int, data_type string, data_length int, data_precision int, "
    "data_scale int, nullable string, data_default string, char_length int, char_used string, char_col_decl_length int, "
    "virtual_column string, identity_column string",
    "column_comments": "owner string, table_name string, column_name string, comments string",
    "constraints": "owner string, constraint_name string, constraint_type string, table_name string, search_condition string, r_owner string, "
    "r_constraint_name string, delete_rule string, deferrable string, deferred string, status string",
    "constraint_columns": "owner string, constraint_name string, table_name string, column_name string, position int",
    "foreign_keys": "owner string, table_name string, constraint_name string, r_owner string, referenced_table string, delete_rule string, "
    "deferrable string, deferred string, status string, column_name string, position int, referenced_column string",
    "indexes": "owner string, index_name string, table_name string, uniqueness string, index_type string, tablespace_name string, "
    "compression string, status string",
    "index_columns": "index_owner string, index_name string, table_name string, column_name string, column_position int, descend string",
    "triggers": "owner string, trigger_name string, table_name string, triggering_event string, trigger_type string, status string, "
    "when_clause string, description string",
    "grants": "owner string, table_schema string, table_name string, grantee string, privilege string, grantable string, type string, "
    "hierarchy string",
    "synonyms": "owner string, synonym_name string, table_owner string, table_name string, db_link string",
}


def fields(array: str) -> list[tuple[str, str]]:
    return [tuple(f.split()) for f in ARRAYS[array].split(", ")]


class Exports:
    """The arrays of all exports below a path, read once."""

    def __init__(self, spark: SparkSession, path: str, glob: str = "*.json"):
        """Files may lie in folders; an object without a schema name, or text that is no JSON, is an error."""
        reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob)
        text = reader.text(path, lineSep=SEPARATOR).filter("value <> ''")
        whole = text.select(F.parse_json("value").alias("v"))
        named = F.try_variant_get("v", "$.schema", "string")
        fault = F.raise_error(F.lit("dictionary export without a schema")).cast("string")
        parts = F.array(*[
            F.struct(F.lit(a).alias("part"), F.try_variant_get("v", f"$.{a}", "array<variant>").alias("rows")) for a in ARRAYS
        ])
        each = whole.select(F.coalesce(named, fault).alias("schema"), F.explode(parts).alias("p"))
        rows = each.select("schema", "p.part", F.posexplode("p.rows").alias("pos", "row"))
        self.spark, self.path = spark, scratch_path(spark, "exports")
        rows.write.partitionBy("part").parquet(self.path)

    def array(self, name: str) -> DataFrame:
        """schema, pos and the fields of one array; a field that an export doesn't have is null."""
        held = self.spark.read.schema("schema string, pos int, row variant, part string").parquet(self.path).filter(F.col("part") == name)
        got = [F.try_variant_get("row", f"$.{field}", kind).alias(field) for field, kind in fields(name)]
        return held.select("schema", "pos", *got)

    def grants(self) -> DataFrame:
        """Grants in one form, whichever names the export's view had for owner and kind."""
        rows = self.array("grants")
        return rows.select(
            "schema", "pos", F.coalesce("owner", "table_schema").alias("owner"), "table_name", "grantee", "privilege", "grantable",
            F.coalesce("type", "hierarchy").alias("kind"),
        )


def _last(rows: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """Of rows that share a name the last one counts."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(value.alias("v")), "pos")["v"].alias("comments"))


def dictionary(exports: Exports) -> dict[str, DataFrame]:
    """Inputs of ``assemble``, a schema being its owner, array positions being the order.

    Table comments come as rows after the statistics, so the first row tells the row count and the last one the comment. Null
    column ids and positions stay null, which sorts as 0.
    """
    owner = F.col("schema").alias("owner")
    stats = exports.array("tables").select(owner, F.col("pos").cast("long").alias("seq"), "table_name", "num_rows", F.lit(None).cast("string").alias("comments"))
    said = exports.array("table_comments").select(
        owner, (F.col("pos") + F.lit(1 << 40)).alias("seq"), "table_name", F.lit(None).cast("bigint").alias("num_rows"), "comments"
    )
    columns = exports.array("columns").drop("owner").withColumnRenamed("schema", "owner").withColumnRenamed("pos", "seq")
    comments = exports.array("column_comments").drop("owner").withColumnRenamed("schema", "owner")
    constraints = exports.array("constraints").drop("owner").withColumnRenamed("schema", "owner").withColumnRenamed("pos", "seq")
    held = exports.array("constraint_columns").drop("owner").withColumnRenamed("schema", "owner").withColumnRenamed("pos", "seq")
    fk = F.concat_ws(".", "r_owner", "referenced_table", "referenced_column")
    keys = exports.array("foreign_keys").drop("owner").withColumnRenamed("schema", "owner")
    return {
        "tables": stats.unionByName(said),
        "columns": columns.join(shuffled(_last(comments, [*TABLE, "column_name"], F.col("comments"))), [*TABLE, "column_name"], "left"),
        "constraints": constraints.select("owner", "seq", "constraint_name", "constraint_type", "table_name", "r_owner", "r_constraint_name"),
        "constraint_columns": held,
        "foreign_keys": keys.groupBy(*TABLE, "column_name").agg(F.max_by(fk, "pos").alias("fk")),
    }


def assemble_exports(
    exports: Exports, lookup_schema: str = LOOKUP_SCHEMA, filter_tables: bool = True, exported: list[str] | None = None
) -> DataFrame:
    """Cards' rows (see ``assemble``) from exports alone: comments from their own arrays, references as the export resolved them."""
    parts = dictionary(exports)
    return assemble(
        parts["tables"], parts["columns"], parts["constraints"], parts["constraint_columns"], lookup_schema, filter_tables, exported,
        foreign_keys=parts["foreign_keys"],
    )
