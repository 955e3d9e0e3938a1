"""Readers: CSV exports, dictionary JSON, card JSON, JDBC dictionary views, schema namespaces."""

from __future__ import annotations

import hashlib
import heapq
import logging
import re
from fnmatch import fnmatch
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from starcard.functions.text import valid_schema
from starcard.functions.types import spark_type
from starcard.operators.cards import CARD_SCHEMA
from starcard.operators.catalog import any_of, declared_type
from starcard.rules import SCHEMA_NAME, SYSTEM_TABLE_PATTERNS

log = logging.getLogger(__name__)

CARD_BUCKETS = 64

# --- fixed values: dictionary views and the array each one fills --------------------------------
DICTIONARY_VIEWS = {
    "tables": "all_tables",
    "table_comments": "all_tab_comments",
    "columns": "all_tab_columns",
    "column_comments": "all_col_comments",
    "constraints": "all_constraints",
    "constraint_columns": "all_cons_columns",
    "indexes": "all_indexes",
    "index_columns": "all_ind_columns",
    "triggers": "all_triggers",
    "grants": "all_tab_privs",
    "synonyms": "all_synonyms",
}
OWNER_COLUMN = {"index_columns": "index_owner", "synonyms": "table_owner"}


def list_files(spark: SparkSession, base: str, glob: str, recursive: bool = True) -> DataFrame:
    """path, folder, stem of files below ``base``; the listing runs on Spark, contents stay unread."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob)
    found = reader.option("recursiveFileLookup", str(recursive).lower()).load(base).select("path")
    name = F.regexp_extract("path", r"([^/]+)\.[^./]*$", 1)
    return found.select("path", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder"), name.alias("stem"))


def _exists(spark: SparkSession, path: str) -> bool:
    from pyspark.errors import AnalysisException

    try:
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        return True
    except AnalysisException:
        return False


def folder_names(spark: SparkSession, base: str) -> list[str]:
    """Names of what lies directly in a folder of whatever file system; a missing folder is empty."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(where):
        return []
    names = [status.getPath().getName() for status in system.listStatus(where)]
    return sorted(n for n in names if n[0] not in "._")


def content_name(spark: SparkSession, path: str) -> str:
    """A name for what lies at ``path``: a digest of its files' names, sizes and times of change."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    listed, held = system.listFiles(where, True), []
    while listed.hasNext():
        f = listed.next()
        held.append(f"{f.getPath().getName()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(held)).encode()).hexdigest()[:32]


def name_is_valid(schema: str) -> bool:
    return re.search(SCHEMA_NAME.replace(r"\z", r"\Z"), schema) is not None


def read_csv_folder(
    spark: SparkSession, base: str, columns: DataFrame, owner: str, multi_line: bool = False
) -> dict[str, DataFrame]:
    """One schema's exported tables, ``base/<table>.csv`` files or ``base/<table>`` folders, by table name.

    Types come from the catalog's ``columns`` of ``owner``; those of a table that the catalog doesn't know are inferred from its rows.
    """
    known = columns.filter(F.upper("owner") == owner.upper())
    ddl: dict[str, list[tuple[int, str]]] = {}
    for r in known.select(
        F.upper("table_name").alias("t"), "column_id", F.concat(F.lit("`"), "column_name", F.lit("` "), spark_type(declared_type())).alias("c")
    ).collect():  # the columns of one schema
        ddl.setdefault(r["t"], []).append((r["column_id"], r["c"]))
    found = {}
    for name in folder_names(spark, base):
        table = name.removesuffix(".csv")
        parts = ddl.get(table.upper())
        typed = ", ".join(c for _, c in sorted(parts)) if parts else None
        reader = spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line)
        found[table] = (reader.schema(typed) if typed else reader.option("inferSchema", True)).csv(f"{base}/{name}")
    return found


def csv_schema(columns: DataFrame, owner: str, table: str) -> str:
    """DDL for one table's CSV, from the catalog's declared types."""
    rows = (
        columns.filter((F.col("owner") == owner) & (F.col("table_name") == table))
        .orderBy("column_id").select("column_name", spark_type(declared_type()).alias("t")).collect()
    )
    return ", ".join(f"`{r['column_name']}` {r['t']}" for r in rows)


def read_csv_table(spark: SparkSession, path: str, ddl: str | None = None, multi_line: bool = False) -> DataFrame:
    """One exported table. Types come from ``ddl``; without it Spark infers them.

    With ``multi_line`` values may hold line breaks, and a file can't be split between tasks any more.
    """
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line)
    return reader.schema(ddl).csv(path) if ddl else reader.option("inferSchema", True).csv(path)


def build_namespace(df: DataFrame, root: str, schema: str, table: str, reset: bool = False) -> str:
    """Store a table as Parquet below ``root/schema``; an existing table is an error unless reset."""
    path = f"{root}/{schema}/{table}"
    df.write.mode("overwrite" if reset else "errorifexists").parquet(path)
    return path


def read_metadata(
    spark: SparkSession, path: str, schema: str | StructType | None = None, multi_line: bool = True
) -> DataFrame:
    """Dictionary exports, one JSON object per schema and file (or line); arrays stay nested.

    Spark does not list files whose name starts with "_" or ".", so exports named that way have to
    be stored under another name.
    """
    reader = spark.read.option("multiLine", multi_line)
    return (reader.schema(schema) if schema else reader).json(path)


def metadata_rows(metadata: DataFrame, array: str) -> DataFrame:
    """One of the twelve arrays as rows, with the schema it came from."""
    return metadata.select("schema", F.explode(array).alias("r")).select("schema", "r.*")


def card_bucket(schema: Column) -> Column:
    return F.pmod(F.xxhash64(schema), F.lit(CARD_BUCKETS)).cast("int")


def _checked(cards: DataFrame) -> DataFrame:
    meta = F.col("table_metadata")
    required = [meta["qualified_name"], meta["schema_name"], meta["name"]]
    unnamed = any_of([c.isNull() for c in required]) | F.exists(
        F.coalesce("columns", F.array()), lambda c: c["name"].isNull() | c["type"].isNull()
    )
    fault = F.raise_error(F.lit("table card without a required field")).cast("boolean")
    return cards.filter(F.when(unnamed, fault).otherwise(F.lit(True)))


def read_card_folders(spark: SparkSession, base: str, schemas: list[str] | None = None) -> DataFrame:
    """Hand-kept cards: ``base/<SCHEMA>/<table>.json``, one object per file.

    A missing base gives no cards; a missing named schema, malformed JSON or a missing required
    field fails. Other files and unknown fields are ignored.
    """
    if not _exists(spark, base):
        log.warning("no table cards at %s", base)
        return spark.createDataFrame([], CARD_SCHEMA)
    for name in schemas or []:
        if not _exists(spark, f"{base}/{name}"):
            raise ValueError(f"no folder for schema {name}")
    paths = [f"{base}/{n}" for n in schemas] if schemas is not None else base
    if schemas == []:
        return spark.createDataFrame([], CARD_SCHEMA)
    reader = (
        spark.read.schema(CARD_SCHEMA).option("mode", "FAILFAST").option("multiLine", True)
        .option("pathGlobFilter", "*.json").option("recursiveFileLookup", True)
    )
    return _checked(reader.json(paths))


def read_cards(spark: SparkSession, base: str, schemas: list[str] | None = None) -> DataFrame:
    """Cards stored by ``write_cards``; named schemas read only their bucket folders."""
    reader = spark.read.schema(CARD_SCHEMA + ", schema_bucket int").option("mode", "FAILFAST")
    cards = reader.json(base)
    if schemas is not None:
        name = F.col("table_metadata.schema_name")
        mine = any_of([F.col("schema_bucket") == card_bucket(F.lit(s)) for s in schemas])
        cards = cards.filter(mine & name.isin(schemas))
        found = {r[0] for r in cards.select(name).distinct().collect()}
        lost = sorted(set(schemas) - found)
        if lost:
            raise ValueError(f"no cards stored for schemas {lost}")
    return _checked(cards).drop("schema_bucket")


def available_schemas(cards: DataFrame) -> DataFrame:
    """schema_name -> number of cards, for schemas with a valid name."""
    name = F.col("table_metadata.schema_name")
    return cards.filter(valid_schema(name)).groupBy(name.alias("schema_name")).agg(F.count(F.lit(1)).alias("n"))


def owner_groups(sizes: list[tuple[str, int]], partitions: int) -> list[list[str]]:
    """Owners dealt to at most ``partitions`` groups of about equal size: the largest first, each to the group with the least so far."""
    groups: list[tuple[int, int, list[str]]] = [(0, i, []) for i in range(max(1, min(partitions, len(sizes))))]
    for owner, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        total, i, held = heapq.heappop(groups)
        heapq.heappush(groups, (total + size, i, [*held, owner]))
    return [held for _, _, held in sorted(groups, key=lambda g: g[1]) if held]


def owner_predicates(owner: str, groups: list[list[str]]) -> list[str]:
    """One condition per group; a quote in a name is doubled."""
    quoted = [", ".join("'" + o.replace("'", "''") + "'" for o in group) for group in groups]
    return [f"{owner} IN ({names})" for names in quoted]


def dictionary_views(
    spark: SparkSession, url: str, owners: list[str], properties: dict[str, str], partitions: int = 8
) -> dict[str, DataFrame]:
    """The eleven dictionary views over JDBC, system tables left out; a partition reads owners of about equally many columns in all."""
    wanted = sorted({o.upper() for o in owners})
    names = ", ".join("'" + o.replace("'", "''") + "'" for o in wanted)
    counted = f"(SELECT owner, count(*) AS n FROM {DICTIONARY_VIEWS['columns']} WHERE owner IN ({names}) GROUP BY owner) v"
    found = {r[0]: int(r[1]) for r in spark.read.jdbc(url, counted, properties=properties).collect()}  # a row per asked owner
    groups = owner_groups([(o, found.get(o, 0)) for o in wanted], partitions)
    read = {}
    for array, view in DICTIONARY_VIEWS.items():
        head = spark.read.jdbc(url, f"(SELECT * FROM {view} WHERE 1 = 0) v", properties=properties)
        owner = owner_column(array, head.columns)
        if owner is None:
            read[array] = head
            continue
        rows = spark.read.jdbc(url, view, predicates=owner_predicates(owner, groups), properties=properties)
        read[array] = shape_view(array, rows)
    return read


def owner_column(array: str, columns: list[str]) -> str | None:
    """The column naming the owner; grants views differ in what they call it."""
    lower = [c.lower() for c in columns]
    if array == "grants":
        return next((c for c in ("owner", "table_schema") if c in lower), None)
    return OWNER_COLUMN.get(array, "owner")


def shape_view(array: str, rows: DataFrame) -> DataFrame:
    """Lower-case names, system tables out; of a grants view only the columns both forms share."""
    rows = rows.toDF(*[c.lower() for c in rows.columns])
    rows = rows.filter(~any_of([F.col("table_name").like(p) for p in SYSTEM_TABLE_PATTERNS]))
    if array == "grants":
        kind = next((c for c in ("type", "hierarchy") if c in rows.columns), None)
        wanted = [owner_column(array, rows.columns), "table_name", "grantee", "privilege", "grantable", kind]
        rows = rows.select(*[c for c in wanted if c])
    return rows


def discover_namespaces(spark: SparkSession, base: str, pattern: str = "*") -> dict[str, dict[str, str]]:
    """Schemas and their Parquet tables, from folders ``base/<schema>/<table>``; bad names are left out."""
    found = {}
    for schema in folder_names(spark, base):
        if not fnmatch(schema, pattern):
            continue
        if not name_is_valid(schema):
            log.error("skipping schema %r: invalid name", schema)
            continue
        found[schema] = {t.removesuffix(".parquet"): f"{base}/{schema}/{t}" for t in folder_names(spark, f"{base}/{schema}")}
    return found


def attach_namespaces(spark: SparkSession, tables: dict[str, dict[str, str]], location: str | None = None) -> list[str]:
    """Make ``schema.table`` of Parquet folders queryable where they lie; schemas with bad names are skipped.

    ``location`` is where databases are declared; no rows are stored there.
    """
    attached = []
    for schema, paths in sorted(tables.items()):
        if not name_is_valid(schema):
            log.error("skipping schema %r: invalid name", schema)
            continue
        if not paths:
            log.warning("schema %s has no tables", schema)
        at = f" LOCATION '{location}/{schema}'" if location else ""
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {schema}{at}")
        for table, path in sorted(paths.items()):
            spark.sql(f"DROP TABLE IF EXISTS {schema}.`{table}`")
            spark.catalog.createTable(f"{schema}.{table}", path, "parquet")
        attached.append(schema)
    return attached


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
