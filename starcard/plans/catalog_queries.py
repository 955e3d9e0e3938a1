"""Catalog queries over the dictionary derived from ``customer`` and over the star tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starcard.functions.text import clean_text, fk_parts, fk_table, normalize_name
from starcard.functions.text import bytes_text, iso_time
from starcard.functions.types import affinity, spark_type
from starcard.operators import cards as C
from starcard.operators import catalog as K
from starcard.operators import value_maps as V
from starcard.operators.segments import dense_number, running_sums
from starcard.plans.registry import query, table
from starcard.plans.tenants import (
    CAT_SQL,
    FK_SQL,
    LOOKUPS,
    cat_columns,
    cat_constraint_columns,
    cat_constraints,
    cat_tables,
    exported_lookups,
)
from starcard.rules import SKIP_RULES
from starcard.session import scratch_path, shuffled, stored
from starcard.sources.files import available_schemas, read_cards
from starcard.sources.sinks import write_cards

EXPORTED = ["REGION", "NATION", "CUSTOMER", "SUPPLIER"]


def _cat(sql: str, *more: str) -> str:
    return "WITH " + ",\n".join([CAT_SQL, *more]) + "\n" + sql


def assembled(spark: SparkSession, d: str) -> DataFrame:
    return K.assemble(
        cat_tables(spark, d), cat_columns(spark, d), cat_constraints(spark, d),
        cat_constraint_columns(spark, d), LOOKUPS, exported=EXPORTED,
    )


def cards(spark: SparkSession, d: str) -> DataFrame:
    return C.nest(assembled(spark, d))


# --- SQL building blocks ------------------------------------------------------------------------

TYPE_STRING_SQL = """CASE
  WHEN data_type IN ('VARCHAR2', 'NVARCHAR2', 'CHAR', 'NCHAR')
       AND coalesce(nullif(char_length, 0), nullif(data_length, 0)) IS NOT NULL
    THEN data_type || '(' || coalesce(nullif(char_length, 0), data_length) || ')'
  WHEN data_type = 'NUMBER' AND data_precision IS NOT NULL
    THEN 'NUMBER(' || data_precision || coalesce(',' || data_scale, '') || ')'
  ELSE coalesce(data_type, '') END"""

AFFINITY_SQL = r"""CASE
  WHEN regexp_matches({t}, '^(NUMBER|DECIMAL|NUMERIC)\(\d+(,\s*0+)?\)') THEN 'INTEGER'
  WHEN regexp_matches({t}, '^(NUMBER|DECIMAL|NUMERIC)\(\d+,\s*\d+\)') THEN 'REAL'
  WHEN {t} = 'NUMBER' THEN 'REAL'
  WHEN regexp_matches({t}, '^(INTEGER|INT|SMALLINT|TINYINT|BIGINT)') THEN 'INTEGER'
  WHEN regexp_matches({t}, '^(FLOAT|DOUBLE|REAL|BINARY_FLOAT|BINARY_DOUBLE)') THEN 'REAL'
  WHEN regexp_matches({t}, '^(BLOB|LONG RAW|RAW|VARBINARY|BINARY)') THEN 'BLOB'
  ELSE 'TEXT' END"""


def _skip_sql(name: str, schema: str) -> str:
    def q(v: str) -> str:
        return "'" + v + "'"

    form = {
        "prefix": "starts_with({n}, {p})", "suffix": "ends_with({n}, {p})",
        "contains": "contains({n}, {p})", "exact": "{n} = {p}",
    }
    keep = ", ".join(q(p) for k, p, _ in SKIP_RULES if k == "keep")
    tests = " OR ".join(
        "(" + form[k].format(n=f"upper({name})", p=q(p)) + (f" AND {schema} = {q(s)}" if s else "") + ")"
        for k, p, s in SKIP_RULES if k != "keep"
    )
    return f"(upper({name}) NOT IN ({keep}) AND ({tests}))"


SKIP_SQL = _skip_sql("table_name", "owner")

PICK_SQL = """
ranked AS (
  SELECT owner, table_name, seq, column_name,
    CASE WHEN column_name = table_name || '_CODE' THEN 0 WHEN column_name = table_name || '_ID' THEN 1
         WHEN column_name = 'ID' THEN 2 WHEN column_name = 'CODE' THEN 3
         WHEN ends_with(column_name, '_CODE') THEN 4 WHEN ends_with(column_name, '_ID') THEN 5 END AS kp,
    CASE WHEN column_name = table_name || '_NAME' THEN 0 WHEN column_name = table_name || '_DESC' THEN 1
         WHEN column_name = 'NAME' THEN 2 WHEN column_name = 'LABEL' THEN 3
         WHEN column_name = 'DESCRIPTION' THEN 4 WHEN column_name = 'DESC' THEN 5
         WHEN column_name = 'TITLE' THEN 6 WHEN ends_with(column_name, '_NAME') THEN 7
         WHEN ends_with(column_name, '_DESC') THEN 8 END AS vp
  FROM cat_columns
),
sides AS (
  SELECT owner, table_name, count(*) AS n, arg_min(column_name, seq) AS c1, arg_max(column_name, seq) AS c2,
         arg_min(column_name, kp * 100000 + seq) FILTER (WHERE kp IS NOT NULL) AS k,
         arg_min(column_name, vp * 100000 + seq) FILTER (WHERE vp IS NOT NULL) AS v
  FROM ranked GROUP BY 1, 2
),
both_sides AS (
  SELECT owner, table_name,
    CASE WHEN n = 2 AND k IS NULL AND v IS NULL THEN c1
         WHEN n = 2 AND k IS NULL THEN CASE WHEN c1 = v THEN c2 ELSE c1 END ELSE k END AS k,
    CASE WHEN n = 2 AND k IS NULL AND v IS NULL THEN c2
         WHEN n = 2 AND v IS NULL THEN CASE WHEN c1 = k THEN c2 ELSE c1 END ELSE v END AS v
  FROM sides
),
picks AS (
  SELECT owner, table_name, CASE WHEN k <> v THEN k END AS key_column,
         CASE WHEN k <> v THEN v END AS value_column FROM both_sides
)"""

REFS_SQL = f"""
refs AS (
  SELECT c.owner, c.table_name, c.column_name, c.column_id, split_part(m.fk, '.', 2) AS ref_table,
         coalesce(r.column_name, p.key_column) AS key_column, p.value_column, t.num_rows AS n
  FROM cat_columns c JOIN fk_map m USING (owner, table_name, column_name)
  JOIN picks p ON p.owner = '{LOOKUPS}' AND p.table_name = split_part(m.fk, '.', 2)
       AND p.value_column IS NOT NULL
  JOIN cat_tables t ON t.owner = '{LOOKUPS}' AND t.table_name = p.table_name AND t.num_rows IS NOT NULL
  LEFT JOIN cat_columns r ON r.owner = '{LOOKUPS}' AND r.table_name = p.table_name
       AND r.column_name = split_part(m.fk, '.', 3)
  WHERE c.owner <> '{LOOKUPS}' AND split_part(m.fk, '.', 1) = '{LOOKUPS}'
    AND p.table_name IN ('REGION', 'NATION', 'CUSTOMER', 'SUPPLIER') AND NOT {_skip_sql('c.table_name', 'c.owner')}
)"""

PK_SQL = """
pks AS (
  SELECT f.owner, f.table_name,
         string_agg(k.column_name, ',' ORDER BY coalesce(k.position, 0), k.seq) AS primary_key
  FROM (SELECT owner, table_name, arg_min(constraint_name, seq) AS constraint_name
        FROM cat_constraints WHERE constraint_type = 'P' GROUP BY 1, 2) f
  JOIN cat_constraint_columns k USING (owner, constraint_name) GROUP BY 1, 2
)"""

CARD_SQL = f"""
card AS (
  SELECT c.owner, c.table_name, c.owner || '.' || c.table_name AS qualified_name, t.num_rows AS row_count,
         coalesce(p.primary_key, '') AS primary_key, nullif(t.comments, '') AS table_description,
         CAST(row_number() OVER (PARTITION BY c.owner, c.table_name ORDER BY c.column_id) - 1 AS INTEGER) AS pos,
         c.column_name, {TYPE_STRING_SQL} AS type, coalesce(c.nullable = 'Y', false) AS nullable,
         nullif(c.comments, '') AS description, m.fk, r.ref_table AS value_map_ref
  FROM cat_columns c
  LEFT JOIN cat_tables t USING (owner, table_name)
  LEFT JOIN pks p USING (owner, table_name)
  LEFT JOIN fk_map m USING (owner, table_name, column_name)
  LEFT JOIN refs r USING (owner, table_name, column_name)
  WHERE NOT {_skip_sql('c.table_name', 'c.owner')}
)"""

_LOOKUP_ROWS_SQL = """
lookup_rows AS (
  SELECT 'REGION' AS ref_table, 'R_REGIONKEY' AS key_column, r_regionkey AS seq,
         CAST(r_regionkey AS VARCHAR) AS map_key, r_name AS map_value FROM region
  UNION ALL SELECT 'NATION', 'NATION_ID', n_nationkey, CAST(n_nationkey AS VARCHAR), n_name FROM nation
  UNION ALL SELECT 'NATION', 'NATION_NAME', n_nationkey, n_name, n_name FROM nation
  UNION ALL SELECT 'CUSTOMER', 'ID', c_custkey, CAST(c_custkey AS VARCHAR), c_name FROM customer
  UNION ALL SELECT 'SUPPLIER', 'S_CODE', s_suppkey, CAST(s_suppkey AS VARCHAR), s_name FROM supplier
)"""

_CHOICE_SQL = """
choices AS (
  SELECT owner, table_name, ref_table, arg_min(key_column, column_id) AS key_column,
         arg_min(value_column, column_id) AS value_column, arg_min(n, column_id) AS n
  FROM refs GROUP BY 1, 2, 3
)"""

CARD_PARTS = (FK_SQL, PICK_SQL, REFS_SQL, PK_SQL, CARD_SQL)


# --- projections and predicates -----------------------------------------------------------------


@query(
    "dict_table_filter",
    _cat("""SELECT owner, table_name FROM cat_tables
            WHERE table_name NOT LIKE 'DR$%' AND table_name NOT LIKE 'BIN$%' AND table_name NOT LIKE 'MLOG$%'
              AND table_name NOT LIKE 'RUPD$%' AND table_name NOT LIKE 'ZZ_%' AND table_name NOT LIKE 'RV$%'"""),
)
def dict_table_filter(spark: SparkSession, d: str) -> DataFrame:
    return K.user_tables(cat_tables(spark, d)).select("owner", "table_name")


@query(
    "type_string",
    _cat(f"SELECT owner, table_name, column_name, {TYPE_STRING_SQL} AS type FROM cat_columns"),
)
def type_string(spark: SparkSession, d: str) -> DataFrame:
    return cat_columns(spark, d).select("owner", "table_name", "column_name", K.declared_type().alias("type"))


@query(
    "type_map",
    _cat(
        f"SELECT owner, table_name, column_name, {AFFINITY_SQL.format(t='upper(trim(type))')} AS affinity FROM typed",
        f"typed AS (SELECT owner, table_name, column_name, {TYPE_STRING_SQL} AS type FROM cat_columns)",
    ),
)
def type_map(spark: SparkSession, d: str) -> DataFrame:
    typed = cat_columns(spark, d).withColumn("type", K.declared_type())
    return typed.select("owner", "table_name", "column_name", affinity(F.col("type")).alias("affinity"))


@query(
    "type_spark",
    _cat(
        r"""SELECT kind, count(*) AS n FROM (SELECT CASE
              WHEN regexp_matches(type, '^NUMBER\(\d+(,0)?\)$') AND data_precision <= 18 THEN 'bigint'
              WHEN regexp_matches(type, '^NUMBER\(\d+') THEN 'decimal(' || data_precision || ',' || data_scale || ')'
              WHEN type IN ('NUMBER', 'FLOAT', 'BINARY_DOUBLE') THEN 'double'
              WHEN type LIKE 'DATE%' OR type LIKE 'TIMESTAMP%' THEN 'timestamp'
              WHEN type LIKE 'INT%' OR type = 'SMALLINT' THEN 'bigint'
              WHEN type = 'LONG RAW' THEN 'binary' ELSE 'string' END AS kind FROM typed) GROUP BY 1""",
        f"typed AS (SELECT data_precision, data_scale, {TYPE_STRING_SQL} AS type FROM cat_columns)",
    ),
)
def type_spark(spark: SparkSession, d: str) -> DataFrame:
    kinds = cat_columns(spark, d).select(spark_type(K.declared_type()).alias("kind"))
    return kinds.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    "card_types",
    _cat(
        f"SELECT qualified_name, column_name, {AFFINITY_SQL.format(t='upper(trim(type))')} AS type FROM card",
        *CARD_PARTS,
    ),
)
def card_types(spark: SparkSession, d: str) -> DataFrame:
    mapped = C.retype(cards(spark, d), "Oracle", "SQLite")
    return C.flatten(mapped).select("qualified_name", "column_name", "type")


@query(
    "name_normalize",
    _cat(r"""SELECT owner, table_name, column_name,
             replace(CASE WHEN contains(column_name, '_')
               THEN regexp_replace(lower(column_name), '_(id|code|key|num|pk|fk|flag|ind)$', '')
               ELSE lower(column_name) END, '_', ' ') AS spoken FROM cat_columns"""),
)
def name_normalize(spark: SparkSession, d: str) -> DataFrame:
    return cat_columns(spark, d).select(
        "owner", "table_name", "column_name", normalize_name(F.col("column_name")).alias("spoken")
    )


@query(
    "skip_rules",
    _cat(f"SELECT owner, table_name, {SKIP_SQL} AS skipped FROM cat_tables"),
)
def skip_rules(spark: SparkSession, d: str) -> DataFrame:
    skipped = K.is_skipped(F.col("table_name"), F.col("owner")).alias("skipped")
    return cat_tables(spark, d).select("owner", "table_name", skipped)


@query(
    "schema_filter",
    "SELECT doc_id, source FROM documents WHERE source IN ('src1', 'src7')",
)
def schema_filter(spark: SparkSession, d: str) -> DataFrame:
    return restrict_schemas(table(spark, d, "documents"), "source", ["src1", "src7"]).select("doc_id", "source")


def restrict_schemas(df: DataFrame, column: str, allowed: list[str] | None) -> DataFrame:
    """Rows of the allowed schemas; all when none are named. Unknown or no names are an error."""
    if allowed is None:
        return df
    if not allowed:
        raise ValueError("name at least one schema, or pass None to keep all")
    asked = df.sparkSession.createDataFrame([(a,) for a in allowed], f"{column} string")
    unknown = [r[0] for r in asked.join(shuffled(df.select(column).distinct()), column, "left_anti").collect()]
    if unknown:
        raise ValueError(f"unknown schemas: {sorted(unknown)}")
    return df.filter(F.col(column).isin(allowed))


_SP = (
    r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)


def _strip_sql(text: str) -> str:
    return f"regexp_replace({text}, '^{_SP}+|{_SP}+\\z', '', 'g')"


CLEAN_SQL = f"""CASE WHEN lower({_strip_sql("text")}) <> 'nan' THEN
  nullif({_strip_sql("replace(" + _strip_sql("text") + ", '_x000D_', chr(10))")}, '') END"""


@query("clean_text", f"SELECT doc_id, {CLEAN_SQL} AS cleaned FROM documents")
def clean_text_query(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", clean_text(F.col("text")).alias("cleaned"))


@query(
    "fk_parts",
    _cat(
        """SELECT owner, table_name, column_name, split_part(fk, '.', 1) AS ref_schema,
                  split_part(fk, '.', 2) AS ref_table, split_part(fk, '.', 3) AS ref_column,
                  split_part(fk, '.', 1) || '.' || split_part(fk, '.', 2) AS ref_qualified FROM fk_map""",
        FK_SQL,
    ),
)
def fk_parts_query(spark: SparkSession, d: str) -> DataFrame:
    part = fk_parts(F.col("fk"))
    return _fk_map(spark, d).select(
        "owner", "table_name", "column_name", part["schema"].alias("ref_schema"),
        part["table"].alias("ref_table"), part["column"].alias("ref_column"),
        fk_table(F.col("fk")).alias("ref_qualified"),
    )


_DOC_NAMES = r"""string_agg(replace(CASE WHEN contains(column_name, '_')
  THEN regexp_replace(lower(column_name), '_(id|code|key|num|pk|fk|flag|ind)$', '')
  ELSE lower(column_name) END, '_', ' '), ' ' ORDER BY pos)"""
DOC_SQL = f"""
docs AS (
  SELECT owner, table_name, qualified_name, count(*)::INTEGER AS column_count, coalesce(any_value(row_count), 0) AS row_count,
         coalesce(any_value(table_description), '') AS description, {_DOC_NAMES} AS names,
         coalesce(string_agg(column_name || ' references ' || fk, ' ' ORDER BY pos) FILTER (WHERE fk IS NOT NULL), '') AS rel,
         coalesce(string_agg(column_name || ': ' || description, ' ' ORDER BY pos)
                  FILTER (WHERE description IS NOT NULL), '') AS texts
  FROM card GROUP BY 1, 2, 3
),
search_docs AS (
  SELECT *, concat_ws(' ', table_name, nullif(description, ''), nullif(names, ''), nullif(rel, ''),
                      nullif(texts, '')) AS content FROM docs
)"""


@query(
    "search_doc",
    _cat(
        """SELECT qualified_name, content AS searchable_content, names AS normalized_column_names,
                  texts AS column_descriptions, description, row_count, column_count FROM search_docs""",
        *CARD_PARTS, DOC_SQL,
    ),
)
def search_doc(spark: SparkSession, d: str) -> DataFrame:
    return C.search_documents(cards(spark, d)).select(
        "qualified_name", "searchable_content", "normalized_column_names", "column_descriptions",
        "description", "row_count", "column_count",
    )


@query(
    "doc_id",
    _cat(
        r"""SELECT qualified_name, regexp_replace(owner, '[$./\\#?]', '_', 'g') || '_' ||
                   regexp_replace(table_name, '[$./\\#?]', '_', 'g') || '_' ||
                   (row_number() OVER (ORDER BY owner, table_name) - 1) AS id
            FROM (SELECT DISTINCT owner, table_name, owner || '.' || table_name AS qualified_name FROM cat_tables)""",
    ),
)
def doc_id(spark: SparkSession, d: str) -> DataFrame:
    names = cat_tables(spark, d).select(
        "owner", "table_name", F.concat_ws(".", "owner", "table_name").alias("qualified_name")
    ).distinct()
    numbered = dense_number(names, ["owner", "table_name"], "i", start=0)
    return numbered.select(
        "qualified_name", C.document_id(F.col("owner"), F.col("table_name"), F.col("i")).alias("id")
    )


@query(
    "card_prune_json",
    _cat(
        """SELECT qualified_name, to_json({'table_metadata': {'qualified_name': qualified_name, 'description': table_description,
                    'primary_key': string_split(primary_key, ','), 'row_count': row_count},
                  'columns': cols, 'value_maps': maps}) AS card_json
           FROM (SELECT owner, table_name, qualified_name, table_description, primary_key, row_count,
                   list({'name': column_name, 'type': type, 'description': description, 'nullable': nullable, 'fk': fk} ORDER BY pos) AS cols
                 FROM card WHERE primary_key <> '' GROUP BY ALL)
           LEFT JOIN nested USING (owner, table_name)
           UNION ALL
           SELECT qualified_name, to_json({'table_metadata': {'qualified_name': qualified_name, 'description': table_description,
                    'primary_key': [], 'row_count': row_count}, 'columns': cols, 'value_maps': maps})
           FROM (SELECT owner, table_name, qualified_name, table_description, row_count,
                   list({'name': column_name, 'type': type, 'description': description, 'nullable': nullable, 'fk': fk} ORDER BY pos) AS cols
                 FROM card WHERE primary_key = '' GROUP BY ALL)
           LEFT JOIN nested USING (owner, table_name)""",
        FK_SQL, PICK_SQL, REFS_SQL, PK_SQL, CARD_SQL, _CHOICE_SQL, _LOOKUP_ROWS_SQL,
        """entries AS (
          SELECT ref_table, key_column, map_from_entries(list((map_key, map_value) ORDER BY map_key, map_value)) AS entries
          FROM (SELECT *, row_number() OVER (PARTITION BY ref_table, key_column ORDER BY seq) AS place FROM lookup_rows) l
          WHERE place <= 20 OR (SELECT min(n) FROM choices c WHERE c.ref_table = l.ref_table) <= 500 GROUP BY 1, 2)""",
        """nested AS (
          SELECT owner, table_name, map_from_entries(list((ref_table, {'n': n,
                   'value_column': CASE WHEN n > 500 THEN value_column END, 'entries': entries}) ORDER BY ref_table)) AS maps
          FROM choices JOIN entries USING (ref_table, key_column) GROUP BY 1, 2)""",
    ),
)
def card_prune_json(spark: SparkSession, d: str) -> DataFrame:
    return C.selector_json(nested_cards(spark, d))


@query(
    "card_summary",
    _cat(
        """SELECT qualified_name, CASE WHEN primary_key = '' THEN '—' ELSE replace(primary_key, ',', ', ') END AS keys,
                  string_agg(column_name || ' (' || type || ')', ', ' ORDER BY pos) FILTER (WHERE pos < 6)
                  || CASE WHEN count(*) > 6 THEN ' …' ELSE '' END AS shown
           FROM card GROUP BY qualified_name, primary_key""",
        *CARD_PARTS,
    ),
)
def card_summary(spark: SparkSession, d: str) -> DataFrame:
    return C.summary(cards(spark, d))


@query(
    "json_values",
    """SELECT event_id, replace(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '.000000', '') AS ts_text,
              event_type AS type_text, CAST(value AS VARCHAR) AS value_text, CAST(user_id AS VARCHAR) AS user_text
       FROM events""",
)
def json_values(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        "event_id", iso_time(F.col("ts")).alias("ts_text"),
        bytes_text(F.encode("event_type", "UTF-8")).alias("type_text"),
        F.col("value").cast("string").alias("value_text"),
        F.col("user_id").cast("string").alias("user_text"),
    )


STARS = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]


@query(
    "fact_or_lookup",
    "SELECT name, n, CASE WHEN n >= 1000000 THEN 'fact' WHEN n < 1000 THEN 'lookup' ELSE 'other' END AS kind FROM ("
    + " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in STARS) + ")",
)
def fact_or_lookup(spark: SparkSession, d: str) -> DataFrame:
    counts = [
        table(spark, d, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("name"), "n") for t in STARS
    ]
    return reduce(DataFrame.union, counts).withColumn("kind", K.size_class(F.col("n")))


# --- joins --------------------------------------------------------------------------------------


def _keyed(spark: SparkSession, d: str) -> DataFrame:
    return K.keyed_columns(cat_constraints(spark, d), cat_constraint_columns(spark, d))


def _fks(spark: SparkSession, d: str) -> DataFrame:
    return K.resolve_foreign_keys(_keyed(spark, d))


def _fk_map(spark: SparkSession, d: str) -> DataFrame:
    return K.foreign_key_map(_fks(spark, d))


@query("fk_resolve", _cat("SELECT * FROM fks", FK_SQL))
def fk_resolve(spark: SparkSession, d: str) -> DataFrame:
    return _fks(spark, d)


@query("fk_column_map", _cat("SELECT * FROM fk_map", FK_SQL))
def fk_column_map(spark: SparkSession, d: str) -> DataFrame:
    return _fk_map(spark, d)


@query("pk_extract", _cat("SELECT * FROM pks", PK_SQL))
def pk_extract(spark: SparkSession, d: str) -> DataFrame:
    keys = K.primary_keys(_keyed(spark, d))
    return keys.withColumn("primary_key", F.array_join("primary_key", ","))


@query(
    "comment_join",
    _cat("""SELECT c.owner, c.table_name, c.column_name, nullif(c.comments, '') AS description,
                   nullif(t.comments, '') AS table_description
            FROM cat_columns c LEFT JOIN cat_tables t USING (owner, table_name)"""),
)
def comment_join(spark: SparkSession, d: str) -> DataFrame:
    columns = cat_columns(spark, d)
    names = columns.select("owner", "table_name", "column_name")
    with_columns = K.described(names, columns, ["owner", "table_name", "column_name"])
    heads = cat_tables(spark, d).withColumnRenamed("comments", "c").select("owner", "table_name", "c")
    return with_columns.join(shuffled(heads), ["owner", "table_name"], "left").select(
        "owner", "table_name", "column_name", "description",
        F.nullif(F.col("c"), F.lit("")).alias("table_description"),
    )


@query(
    "row_count_join",
    _cat("""SELECT DISTINCT c.owner, c.table_name, t.num_rows AS row_count
            FROM cat_columns c LEFT JOIN cat_tables t USING (owner, table_name)"""),
)
def row_count_join(spark: SparkSession, d: str) -> DataFrame:
    names = cat_columns(spark, d).select("owner", "table_name").distinct()
    return names.join(shuffled(K.first_row_counts(cat_tables(spark, d))), K.TABLE, "left")


@query(
    "value_map_ref",
    _cat(
        "SELECT owner, table_name, column_name, ref_table, key_column, value_column, n FROM refs",
        FK_SQL, PICK_SQL, REFS_SQL,
    ),
)
def value_map_ref(spark: SparkSession, d: str) -> DataFrame:
    return K.reference_rows(assembled(spark, d)).drop("column_id")


_SHEET = [
    (None, "EVENTS", "what users did"),
    (None, "DOCUMENTS", "texts by language"),
    (None, "V_SALES", "sales view"),
]
_COLUMN_SHEET = [
    ("EVENTS", "VALUE", "amount"),
    ("DOCUMENTS", "TEXT", "whole text"),
    ("NATION", "N_REGIONKEY", "region of the nation"),
    ("NATION", "N_NAME", "never used, a comment is there"),
]


def _values(rows: list[tuple]) -> str:
    return ", ".join(
        "(" + ", ".join("NULL" if v is None else f"'{v}'" for v in r) + ")" for r in rows
    )


def _sheets(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A sheet naming the labels table of every customer, with some shared rows."""
    shared = spark.createDataFrame(_SHEET, "owner string, table_name string, text string")
    own = table(spark, d, "customer").select(
        F.concat(F.lit("T"), "c_custkey").alias("owner"), F.lit("LABELS").alias("table_name"),
        F.concat(F.lit("labels of "), "c_name").alias("text"),
    )
    columns = spark.createDataFrame(_COLUMN_SHEET, "table_name string, column_name string, text string")
    return own.unionByName(shared), columns


@query(
    "enrich_fill",
    _cat(
        f"""SELECT c.owner, c.table_name, c.column_name,
              coalesce(c.table_description, o.text, s.text) AS table_description,
              c.table_description IS NULL AND coalesce(o.text, s.text) IS NOT NULL AS table_filled,
              coalesce(c.description, k.text) AS description,
              c.description IS NULL AND k.text IS NOT NULL AS column_filled
            FROM card c
            LEFT JOIN (SELECT 'T' || CAST(c_custkey AS VARCHAR) AS o, 'labels of ' || c_name AS text FROM customer) o
              ON o.o = c.owner AND c.table_name = 'LABELS'
            LEFT JOIN (VALUES {_values([r[1:] for r in _SHEET])}) s(t, text) ON s.t = c.table_name
            LEFT JOIN (VALUES {_values(_COLUMN_SHEET)}) k(t, c, text)
              ON k.t = c.table_name AND k.c = c.column_name""",
        *CARD_PARTS,
    ),
)
def enrich_fill(spark: SparkSession, d: str) -> DataFrame:
    cards = K.fill_descriptions(assembled(spark, d), *_sheets(spark, d))
    c = F.col("c")
    return cards.select(*K.TABLE, "description", "filled", F.explode("cols").alias("c")).select(
        *K.TABLE, c["name"].alias("column_name"), F.col("description").alias("table_description"),
        F.col("filled").alias("table_filled"), c["description"].alias("description"),
        c["filled"].alias("column_filled"),
    )


@query(
    "src_descriptions",
    f"""WITH sheet AS (SELECT source, lang, {CLEAN_SQL} AS text, doc_id FROM documents)
        SELECT 'table' AS sheet, upper(source) AS first, upper(lang) AS second, arg_max(text, doc_id) AS text FROM sheet
        WHERE text IS NOT NULL GROUP BY 2, 3
        UNION ALL SELECT 'column', upper(lang), upper(source) || '_' || doc_id % 7, arg_max(text, doc_id) FROM sheet
        WHERE text IS NOT NULL GROUP BY 2, 3""",
)
def src_descriptions(spark: SparkSession, d: str) -> DataFrame:
    """Both sheets: texts by owner and table, and by table and column."""
    rows = table(spark, d, "documents")
    sheet = rows.select(
        F.col("source").alias("Owner"), F.concat(F.lit(" "), "lang").alias("Name"),
        F.col("text").alias("Comment"), F.col("doc_id").alias("row_no"),
    )
    columns = rows.select(
        F.concat("lang", F.lit("\t")).alias("Table"), F.concat_ws("_", F.upper("source"), F.col("doc_id") % 7).alias("Name"),
        F.col("text").alias("Comment"), F.col("doc_id").alias("row_no"),
    )
    per_table, per_column = K.description_sheets(sheet, columns)
    return per_table.select(F.lit("table").alias("sheet"), F.col("owner").alias("first"), F.col("table_name").alias("second"), "text").unionByName(
        per_column.select(F.lit("column").alias("sheet"), F.col("table_name").alias("first"), F.col("column_name").alias("second"), "text")
    )


# --- aggregations -------------------------------------------------------------------------------


@query(
    "group_collect",
    """SELECT user_id, event_id,
              row_number() OVER (PARTITION BY user_id ORDER BY coalesce(nullif(value, 0), 0), event_id) AS pos
       FROM events""",
)
def group_collect(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a group with their place in it; long form, so a huge group stays many rows."""
    events = table(spark, d, "events").select(
        "user_id", "event_id", F.coalesce("value", F.lit(0.0)).alias("k")
    )
    placed = running_sums(events, "user_id", ["k", "event_id"], {"pos": F.lit(1)})
    return placed.select("user_id", "event_id", "pos")


@query(
    "card_build",
    _cat("""SELECT qualified_name, row_count, primary_key, table_description, pos, column_name, type, nullable,
                   description, fk, value_map_ref FROM card""", *CARD_PARTS),
)
def card_build(spark: SparkSession, d: str) -> DataFrame:
    return C.flatten(cards(spark, d))


def nested_cards(spark: SparkSession, d: str) -> DataFrame:
    """Cards with their value maps attached."""
    known = stored(assembled(spark, d), "assembled")
    choices = K.one_map_per_lookup(K.reference_rows(known))
    entries = C.nested_entries(V.long_maps(exported_lookups(spark, d), choices, partial=True))
    maps = choices.join(entries, ["ref_table", "key_column"], "left").withColumn(
        "entries", F.coalesce("entries", F.create_map().cast("map<string,string>"))
    )
    maps = maps.withColumn("value_column", F.when(F.col("n") > V.FULL_MAP_ROWS, F.col("value_column")))
    return C.nest(known, maps)


@query(
    "value_map_dedupe",
    _cat("SELECT * FROM choices", FK_SQL, PICK_SQL, REFS_SQL, _CHOICE_SQL),
)
def value_map_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return K.one_map_per_lookup(K.reference_rows(assembled(spark, d)))


@query(
    "card_value_maps",
    _cat(
        """SELECT c.owner || '.' || c.table_name AS qualified_name, c.ref_table, c.n,
                  CASE WHEN c.n > 500 THEN c.value_column END AS value_column, l.map_key, l.map_value
           FROM choices c JOIN (
             SELECT *, row_number() OVER (PARTITION BY ref_table, key_column ORDER BY seq) AS place FROM lookup_rows) l
             USING (ref_table, key_column) WHERE c.n <= 500 OR l.place <= 20""",
        FK_SQL, PICK_SQL, REFS_SQL, _CHOICE_SQL, _LOOKUP_ROWS_SQL,
    ),
)
def card_value_maps(spark: SparkSession, d: str) -> DataFrame:
    maps = nested_cards(spark, d).select(
        F.col("table_metadata.qualified_name").alias("qualified_name"),
        F.explode("value_maps").alias("ref_table", "m"),
    )
    return maps.select(
        "qualified_name", "ref_table", F.col("m.n").alias("n"),
        F.col("m.value_column").alias("value_column"), F.explode("m.entries").alias("map_key", "map_value"),
    )


@query("pick_lookup_columns", _cat("SELECT * FROM picks", PICK_SQL))
def pick_lookup_columns(spark: SparkSession, d: str) -> DataFrame:
    return K.lookup_columns(cat_columns(spark, d))


_STAR_LOOKUPS = [
    ("region", "r_regionkey", "r_name"), ("nation", "n_nationkey", "n_name"),
    ("supplier", "s_suppkey", "s_name"), ("customer", "c_custkey", "c_name"),
    ("part", "p_partkey", "p_name"),
]


def _star_maps(spark: SparkSession, d: str, full: bool) -> DataFrame:
    found = [spark.createDataFrame([], V.MAP_SCHEMA)]
    for name, key, label in _STAR_LOOKUPS:
        lookup = table(spark, d, name)
        rows = lookup.count()
        if (rows <= V.FULL_MAP_ROWS) == full:
            found.append(V.value_map(lookup, name, key, label, rows))
    return reduce(DataFrame.unionByName, found)


def _star_maps_sql(full: bool) -> str:
    parts = [
        f"""SELECT '{n}' AS ref_table, CAST({k} AS VARCHAR) AS map_key, {v} AS map_value,
            (SELECT count(*) FROM {n}) AS n, {'NULL' if full else f"'{v}'"} AS value_column
            FROM (SELECT *, row_number() OVER (ORDER BY {k}) AS place FROM {n})
            WHERE (SELECT count(*) FROM {n}) {'<=' if full else '>'} 500 {'' if full else 'AND place <= 20'}"""
        for n, k, v in _STAR_LOOKUPS
    ]
    return "\nUNION ALL ".join(parts)


@query("value_map_full", _star_maps_sql(True))
def value_map_full(spark: SparkSession, d: str) -> DataFrame:
    return _star_maps(spark, d, True)


@query("value_map_sampled", _star_maps_sql(False))
def value_map_sampled(spark: SparkSession, d: str) -> DataFrame:
    return _star_maps(spark, d, False)


# --- sorts and set operations -------------------------------------------------------------------


@query(
    "ordered_columns",
    _cat("""SELECT owner, table_name, column_name,
                   CAST(row_number() OVER (PARTITION BY owner, table_name ORDER BY coalesce(column_id, 0), seq) AS INTEGER) AS pos
            FROM cat_columns"""),
)
def ordered_columns(spark: SparkSession, d: str) -> DataFrame:
    place = Window.partitionBy(*K.TABLE).orderBy(F.coalesce("column_id", F.lit(0)), "seq")
    return cat_columns(spark, d).select(*K.TABLE, "column_name", F.row_number().over(place).alias("pos"))


@query(
    "position_order",
    _cat("""SELECT owner, constraint_name, column_name,
                   CAST(row_number() OVER (PARTITION BY owner, constraint_name ORDER BY coalesce(position, 0), seq) AS INTEGER) AS pos
            FROM cat_constraint_columns"""),
)
def position_order(spark: SparkSession, d: str) -> DataFrame:
    place = Window.partitionBy("owner", "constraint_name").orderBy(F.coalesce("position", F.lit(0)), "seq")
    return cat_constraint_columns(spark, d).select(
        "owner", "constraint_name", "column_name", F.row_number().over(place).alias("pos")
    )


@query(
    "names_except",
    _cat("""SELECT DISTINCT owner, table_name FROM cat_columns
            EXCEPT SELECT owner, table_name FROM cat_tables"""),
)
def names_except(spark: SparkSession, d: str) -> DataFrame:
    listed = cat_tables(spark, d).select(*K.TABLE)
    return cat_columns(spark, d).select(*K.TABLE).distinct().join(shuffled(listed), K.TABLE, "left_anti")


@query(
    "schema_counts",
    _cat(f"""SELECT owner AS schema_name, count(DISTINCT table_name) AS n FROM cat_columns
             WHERE regexp_matches(owner, '^[A-Za-z][A-Za-z0-9_]*$') AND NOT {SKIP_SQL} GROUP BY 1"""),
)
def schema_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counted over stored cards."""
    path = scratch_path(spark, "cards")
    write_cards(cards(spark, d), path)
    return available_schemas(read_cards(spark, path))
