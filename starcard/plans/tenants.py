"""Dictionary tables derived from ``customer``: one schema per customer plus a shared lookup schema.

Every customer row yields the dictionary rows of its own schema ``T<c_custkey>`` by exploding an
array of literals, so the catalog grows with ``customer`` and needs no cross join. The same
literals are rendered as ``VALUES`` for the SQL checks.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starcard.plans.registry import table
from starcard.session import shuffle_width

LOOKUPS = "REF"

# table, rows per nation step (null: not in the statistics), comment
TABLES = [
    ("REGION", 5, "regions of the world"),
    ("NATION", 25, "nations and the region they belong to"),
    ("CUSTOMER", 1500, "customer accounts by market segment such as machinery"),
    ("SUPPLIER", 100, "supplier accounts"),
    ("PART", 2000, "parts on offer for household and furniture"),
    ("ORDERS", 15000, "orders placed by customers"),
    ("LINEITEM", 60000, "lines of the orders with part and supplier"),
    ("EVENTS", 10000, ""),
    ("DOCUMENTS", 1000, None),
    ("EMBEDDINGS", 500, "vectors"),
    ("PAGES", 250, "raw web pages"),
    ("BENCHMARK", None, "test passages"),
    ("LABELS", 399, None),
    ("CONVERSATIONS", 536, ""),
    ("TMP_LOAD", 10, "staging"),
    ("ORDERS_HIST", 900, "old orders"),
    ("ORDERS_LOG", 70, "log"),
    ("ORDER_BK_2020", 12, None),
    ("DD_SAFETYREPORT_DUPLICATES", 33, "known duplicates"),
    ("DD_SCORES", 8, None),
    ("CRITERIA", 4, None),
    ("ZZ_X", 1, None),
    ("ZZ", 2, None),
    ("DR$IDX", 3, None),
    ("BIN$1", 3, None),
]

# table, column, type, length, precision, scale, char length, nullable, comment
_C = [
    ("REGION", "R_REGIONKEY", "NUMBER", 22, 3, 0, 0, "N", "region number"),
    ("REGION", "R_NAME", "VARCHAR2", 25, None, None, 25, "N", "region name"),
    ("NATION", "N_NATIONKEY", "NUMBER", 22, 3, 0, 0, "N", None),
    ("NATION", "N_NAME", "VARCHAR2", 25, None, None, 25, "N", "nation name"),
    ("NATION", "N_REGIONKEY", "NUMBER", 22, 3, 0, 0, "Y", ""),
    ("CUSTOMER", "C_CUSTKEY", "NUMBER", 22, 15, 0, 0, "N", "customer number"),
    ("CUSTOMER", "C_NAME", "NVARCHAR2", 60, None, None, 30, "N", None),
    ("CUSTOMER", "C_NATIONKEY", "NUMBER", 22, 3, 0, 0, "Y", "home nation"),
    ("CUSTOMER", "C_ACCTBAL", "NUMBER", 22, 12, 2, 0, "Y", "balance"),
    ("CUSTOMER", "C_MKTSEGMENT", "CHAR", 10, None, None, 0, "Y", "market segment"),
    ("CUSTOMER", "C_STATUS_ID", "NUMBER", 22, 5, 0, 0, "Y", None),
    ("SUPPLIER", "S_SUPPKEY", "NUMBER", 22, 15, 0, 0, "N", None),
    ("SUPPLIER", "S_NAME", "VARCHAR2", 25, None, None, 25, "N", None),
    ("SUPPLIER", "S_NATIONKEY", "NUMBER", 22, 3, 0, 0, "Y", "home nation"),
    ("SUPPLIER", "S_ACCTBAL", "FLOAT", 22, 126, None, 0, "Y", None),
    ("PART", "P_PARTKEY", "NUMBER", 22, 15, None, 0, "N", None),
    ("PART", "P_NAME", "VARCHAR2", 55, None, None, 55, "N", "part name"),
    ("PART", "P_BRAND", "VARCHAR2", 10, None, None, None, "Y", None),
    ("PART", "P_TYPE", "VARCHAR2", 0, None, None, 0, "Y", "kind of part"),
    ("PART", "P_SIZE", "INTEGER", 22, None, 0, 0, "Y", None),
    ("PART", "P_RETAILPRICE", "NUMBER", 22, None, 2, 0, "Y", "price"),
    ("ORDERS", "O_ORDERKEY", "NUMBER", 22, 18, 0, 0, "N", "order number"),
    ("ORDERS", "O_CUSTKEY", "NUMBER", 22, 15, 0, 0, "N", "who ordered"),
    ("ORDERS", "O_ORDERSTATUS", "CHAR", 1, None, None, 1, "Y", None),
    ("ORDERS", "O_TOTALPRICE", "NUMBER", 22, 12, 2, 0, "Y", "price in all"),
    ("ORDERS", "O_ORDERDATE", "DATE", 7, None, None, 0, "Y", "order date"),
    ("ORDERS", "O_ORDERPRIORITY", "VARCHAR2", 15, None, None, 15, "Y", None),
    ("ORDERS", "O_SHIP_NATION", "VARCHAR2", 25, None, None, 25, "Y", None),
    ("ORDERS", "O_NATION_CODE", "NUMBER", 22, 3, 0, 0, "Y", None),
    ("LINEITEM", "L_ORDERKEY", "NUMBER", 22, 18, 0, 0, "N", None),
    ("LINEITEM", "L_PARTKEY", "NUMBER", 22, 15, 0, 0, "N", None),
    ("LINEITEM", "L_SUPPKEY", "NUMBER", 22, 15, 0, 0, "N", None),
    ("LINEITEM", "L_LINENUMBER", "NUMBER", 22, 5, 0, 0, "N", "line"),
    ("LINEITEM", "L_QUANTITY", "BINARY_DOUBLE", 8, None, None, 0, "Y", None),
    ("LINEITEM", "L_EXTENDEDPRICE", "BINARY_DOUBLE", 8, None, None, 0, "Y", None),
    ("LINEITEM", "L_DISCOUNT", "NUMBER", 22, 4, 2, 0, "Y", None),
    ("LINEITEM", "L_TAX", "NUMBER", 22, 4, 2, 0, "Y", None),
    ("LINEITEM", "L_RETURNFLAG", "CHAR", 1, None, None, 1, "Y", "returned or not"),
    ("LINEITEM", "L_LINESTATUS", "CHAR", 1, None, None, 1, "Y", None),
    ("LINEITEM", "L_SHIPDATE", "TIMESTAMP(6)", 11, None, 6, 0, "Y", "ship date"),
    ("EVENTS", "EVENT_ID", "NUMBER", 22, 18, 0, 0, "N", None),
    ("EVENTS", "TS", "TIMESTAMP(6)", 11, None, 6, 0, "N", None),
    ("EVENTS", "USER_ID", "NUMBER", 22, 15, 0, 0, "Y", None),
    ("EVENTS", "EVENT_TYPE", "VARCHAR2", 20, None, None, 20, "Y", None),
    ("EVENTS", "VALUE", "NUMBER", 22, None, None, 0, "Y", None),
    ("EVENTS", "PROPS", "CLOB", 4000, None, None, 0, "Y", "free form"),
    ("DOCUMENTS", "DOC_ID", "NUMBER", 22, 18, 0, 0, "N", None),
    ("DOCUMENTS", "TEXT", "LONG", 0, None, None, 0, "Y", None),
    ("DOCUMENTS", "LANG", "CHAR", 2, None, None, 2, "Y", "language"),
    ("DOCUMENTS", "SOURCE", "VARCHAR2", 20, None, None, 20, "Y", None),
    ("DOCUMENTS", "N_CHARS", "NUMBER", 22, 10, 0, 0, "Y", None),
    ("EMBEDDINGS", "VEC_ID", "NUMBER", 22, 18, 0, 0, "N", None),
    ("EMBEDDINGS", "EMBEDDING", "LONG RAW", 0, None, None, 0, "Y", None),
    ("EMBEDDINGS", "LABEL", "NUMBER", 22, 5, 0, 0, "Y", None),
    ("PAGES", "PAGE_ID", "NUMBER", 22, 18, 0, 0, "N", None),
    ("PAGES", "URL", "VARCHAR2", 400, None, None, 400, "Y", None),
    ("PAGES", "HTML", "NCLOB", 4000, None, None, 0, "Y", None),
    ("BENCHMARK", "ITEM_ID", "NUMBER", 22, 18, 0, 0, "N", None),
    ("BENCHMARK", "TEXT", "CLOB", 4000, None, None, 0, "Y", None),
    ("LABELS", "DOC_ID", "NUMBER", 22, 18, 0, 0, "N", None),
    ("LABELS", "QUALITY", "NUMBER(*,0)", 22, None, 0, 0, "Y", None),
    ("LABELS", "TOXIC", "SMALLINT", 22, None, 0, 0, "Y", None),
    ("CONVERSATIONS", "CONV_ID", "NUMBER", 22, 18, 0, 0, "N", None),
    ("CONVERSATIONS", "TURN", "NUMBER", 22, 5, 0, 0, "N", None),
    ("CONVERSATIONS", "ROLE", "VARCHAR2", 10, None, None, 10, "Y", None),
    ("CONVERSATIONS", "TEXT", "CLOB", 4000, None, None, 0, "Y", None),
    ("CONVERSATIONS", "PAUSE", "INTERVAL DAY(2) TO SECOND(6)", 11, 2, 6, 0, "Y", None),
    ("V_SALES", "CUSTKEY", "NUMBER", 22, 15, 0, 0, "Y", None),
    ("V_SALES", "NATION_ID_CODE", "NUMBER", 22, 3, 0, 0, "Y", "nation"),
    ("TMP_LOAD", "ID", "NUMBER", 22, None, None, 0, "Y", None),
    ("ORDERS_HIST", "ID", "NUMBER", 22, None, None, 0, "Y", None),
    ("ORDERS_LOG", "ID", "NUMBER", 22, None, None, 0, "Y", None),
    ("ORDER_BK_2020", "ID", "NUMBER", 22, None, None, 0, "Y", None),
    ("DD_SAFETYREPORT_DUPLICATES", "MASTER_ID", "NUMBER", 22, 15, 0, 0, "N", "kept report"),
    ("DD_SAFETYREPORT_DUPLICATES", "COPY_ID", "NUMBER", 22, 15, 0, 0, "N", "copied report"),
    ("DD_SCORES", "ID", "NUMBER", 22, None, None, 0, "Y", None),
    ("CRITERIA", "ID", "NUMBER", 22, None, None, 0, "Y", None),
]


def _numbered(rows: list[tuple]) -> list[tuple]:
    """Put the column id (place inside its table) after the column name."""
    seen: dict[str, int] = {}
    out = []
    for row in rows:
        seen[row[0]] = seen.get(row[0], 0) + 1
        out.append((row[0], row[1], seen[row[0]], *row[2:]))
    return out


COLUMNS = _numbered(_C)

# constraint, type, table, schema of the referenced constraint (own or the lookups), its name
CONSTRAINTS = [
    ("PK_REGION", "P", "REGION", None, None),
    ("PK_NATION", "P", "NATION", None, None),
    ("FK_NATION_REGION", "R", "NATION", "REF", "PK_REF_REGION"),
    ("PK_CUSTOMER", "P", "CUSTOMER", None, None),
    ("FK_CUSTOMER_NATION", "R", "CUSTOMER", "REF", "PK_REF_NATION"),
    ("FK_CUSTOMER_STATUS", "R", "CUSTOMER", "REF", "PK_REF_STATUS"),
    ("PK_SUPPLIER", "P", "SUPPLIER", None, None),
    ("FK_SUPPLIER_NATION", "R", "SUPPLIER", "REF", "PK_REF_NATION"),
    ("PK_PART", "P", "PART", None, None),
    ("CK_ORDERS", "C", "ORDERS", None, None),
    ("PK_ORDERS", "P", "ORDERS", None, None),
    ("FK_ORDERS_CUSTOMER", "R", "ORDERS", "OWN", "PK_CUSTOMER"),
    ("FK_ORDERS_NATION", "R", "ORDERS", "REF", "UK_REF_NATION"),
    ("FK_ORDERS_SHIP", "R", "ORDERS", "REF", "UK_REF_NATION"),
    ("FK_ORDERS_NATION2", "R", "ORDERS", "REF", "PK_REF_NATION"),
    ("PK_LINEITEM", "P", "LINEITEM", None, None),
    ("FK_LINE_OFFER", "R", "LINEITEM", "REF", "PK_REF_OFFER"),
    ("FK_LINE_ORDER", "R", "LINEITEM", "OWN", "PK_ORDERS"),
    ("FK_LINE_PART", "R", "LINEITEM", "OWN", "PK_PART"),
    ("FK_LINE_SUPPLIER", "R", "LINEITEM", "OWN", "PK_SUPPLIER"),
    ("PK_EVENTS", "P", "EVENTS", None, None),
    ("FK_EVENTS_CUSTOMER", "R", "EVENTS", "REF", "PK_REF_CUSTOMER"),
    ("PK_DOCUMENTS", "P", "DOCUMENTS", None, None),
    ("PK_LABELS", "P", "LABELS", None, None),
    ("FK_LABELS_DOCUMENTS", "R", "LABELS", "OWN", "PK_DOCUMENTS"),
    ("FK_LABELS_LOST", "R", "LABELS", "OWN", "PK_GONE"),
    ("PK_CONVERSATIONS", "P", "CONVERSATIONS", None, None),
]

# constraint, table, column, position
CONSTRAINT_COLUMNS = [
    ("PK_REGION", "REGION", "R_REGIONKEY", 1),
    ("PK_NATION", "NATION", "N_NATIONKEY", 1),
    ("FK_NATION_REGION", "NATION", "N_REGIONKEY", 1),
    ("PK_CUSTOMER", "CUSTOMER", "C_CUSTKEY", 1),
    ("FK_CUSTOMER_NATION", "CUSTOMER", "C_NATIONKEY", 1),
    ("FK_CUSTOMER_STATUS", "CUSTOMER", "C_STATUS_ID", 1),
    ("PK_SUPPLIER", "SUPPLIER", "S_SUPPKEY", 1),
    ("FK_SUPPLIER_NATION", "SUPPLIER", "S_NATIONKEY", 1),
    ("PK_PART", "PART", "P_PARTKEY", 1),
    ("CK_ORDERS", "ORDERS", "O_ORDERSTATUS", None),
    ("PK_ORDERS", "ORDERS", "O_ORDERKEY", 1),
    ("FK_ORDERS_CUSTOMER", "ORDERS", "O_CUSTKEY", 1),
    ("FK_ORDERS_NATION", "ORDERS", "O_NATION_CODE", 1),
    ("FK_ORDERS_SHIP", "ORDERS", "O_SHIP_NATION", 1),
    ("FK_ORDERS_NATION2", "ORDERS", "O_NATION_CODE", 1),
    ("PK_LINEITEM", "LINEITEM", "L_LINENUMBER", 2),
    ("PK_LINEITEM", "LINEITEM", "L_ORDERKEY", 1),
    ("FK_LINE_OFFER", "LINEITEM", "L_PARTKEY", 1),
    ("FK_LINE_OFFER", "LINEITEM", "L_SUPPKEY", 2),
    ("FK_LINE_ORDER", "LINEITEM", "L_ORDERKEY", 1),
    ("FK_LINE_PART", "LINEITEM", "L_PARTKEY", 1),
    ("FK_LINE_SUPPLIER", "LINEITEM", "L_SUPPKEY", 1),
    ("PK_EVENTS", "EVENTS", "EVENT_ID", None),
    ("FK_EVENTS_CUSTOMER", "EVENTS", "USER_ID", 1),
    ("PK_DOCUMENTS", "DOCUMENTS", "DOC_ID", 1),
    ("PK_LABELS", "LABELS", "DOC_ID", 1),
    ("FK_LABELS_DOCUMENTS", "LABELS", "DOC_ID", 1),
    ("FK_LABELS_LOST", "LABELS", "QUALITY", 1),
    ("PK_CONVERSATIONS", "CONVERSATIONS", "CONV_ID", 1),
    ("PK_CONVERSATIONS", "CONVERSATIONS", "TURN", 2),
]

# the shared lookup schema: its row counts are those of the star tables
REF_COLUMNS = _numbered([
    ("REGION", "R_REGIONKEY", "NUMBER", 22, 3, 0, 0, "N", None),
    ("REGION", "R_NAME", "VARCHAR2", 25, None, None, 25, "N", "region name"),
    ("NATION", "NATION_NAME", "VARCHAR2", 25, None, None, 25, "N", "nation name"),
    ("NATION", "NATION_ID", "NUMBER", 22, 3, 0, 0, "N", None),
    ("NATION", "REGION_ID", "NUMBER", 22, 3, 0, 0, "Y", None),
    ("CUSTOMER", "ID", "NUMBER", 22, 15, 0, 0, "N", None),
    ("CUSTOMER", "C_NAME", "VARCHAR2", 30, None, None, 30, "N", None),
    ("SUPPLIER", "NATION_ID", "NUMBER", 22, 3, 0, 0, "Y", None),
    ("SUPPLIER", "S_CODE", "NUMBER", 22, 15, 0, 0, "N", None),
    ("SUPPLIER", "S_NAME", "VARCHAR2", 25, None, None, 25, "N", None),
    ("OFFER", "OFFER_PART", "NUMBER", 22, 15, 0, 0, "N", None),
    ("OFFER", "OFFER_SUPP", "NUMBER", 22, 15, 0, 0, "N", None),
    ("OFFER", "PRICE", "NUMBER", 22, 12, 2, 0, "Y", None),
    ("STATUS", "STATUS_CODE", "NUMBER", 22, 5, 0, 0, "N", None),
    ("STATUS", "STATUS_ID", "NUMBER", 22, 5, 0, 0, "N", None),
    ("STATUS", "STATUS_NAME", "VARCHAR2", 25, None, None, 25, "N", None),
])
REF_CONSTRAINTS = [
    ("PK_REF_REGION", "P", "REGION", None, None),
    ("PK_REF_NATION", "P", "NATION", None, None),
    ("UK_REF_NATION", "U", "NATION", None, None),
    ("FK_REF_NATION_REGION", "R", "NATION", "REF", "PK_REF_REGION"),
    ("PK_REF_CUSTOMER", "P", "CUSTOMER", None, None),
    ("PK_REF_SUPPLIER", "P", "SUPPLIER", None, None),
    ("PK_REF_OFFER", "P", "OFFER", None, None),
    ("PK_REF_STATUS", "P", "STATUS", None, None),
]
REF_CONSTRAINT_COLUMNS = [
    ("PK_REF_REGION", "REGION", "R_REGIONKEY", 1),
    ("PK_REF_NATION", "NATION", "NATION_ID", 1),
    ("UK_REF_NATION", "NATION", "NATION_NAME", 1),
    ("FK_REF_NATION_REGION", "NATION", "REGION_ID", 1),
    ("PK_REF_CUSTOMER", "CUSTOMER", "ID", 1),
    ("PK_REF_SUPPLIER", "SUPPLIER", "S_CODE", 1),
    ("PK_REF_OFFER", "OFFER", "OFFER_PART", 1),
    ("PK_REF_OFFER", "OFFER", "OFFER_SUPP", 2),
    ("PK_REF_STATUS", "STATUS", "STATUS_ID", 1),
]
REF_STARS = ["region", "nation", "customer", "supplier"]
# catalog column -> column of the star table
REF_FIELDS = {
    "REGION": {"R_REGIONKEY": "r_regionkey", "R_NAME": "r_name"},
    "NATION": {"NATION_NAME": "n_name", "NATION_ID": "n_nationkey", "REGION_ID": "n_regionkey"},
    "CUSTOMER": {"ID": "c_custkey", "C_NAME": "c_name"},
    "SUPPLIER": {"NATION_ID": "s_nationkey", "S_CODE": "s_suppkey", "S_NAME": "s_name"},
}
REF_SEQ = {"REGION": "r_regionkey", "NATION": "n_nationkey", "CUSTOMER": "c_custkey", "SUPPLIER": "s_suppkey"}

_T_SCHEMA = "table_name string, base_rows bigint, comments string"
_C_SCHEMA = (
    "table_name string, column_name string, column_id int, data_type string, data_length int, "
    "data_precision int, data_scale int, char_length int, nullable string, comments string"
)
_K_SCHEMA = (
    "constraint_name string, constraint_type string, table_name string, r_owner string, "
    "r_constraint_name string"
)
_KC_SCHEMA = "constraint_name string, table_name string, column_name string, position int"


def _fields(schema: str) -> list[tuple[str, str]]:
    return [tuple(part.split()) for part in schema.split(", ")]


def _literals(rows: list[tuple], schema: str) -> Column:
    """An array of structs, one per row, numbered in ``seq``; Catalyst folds it to a constant."""
    names = ["seq", *[n for n, _ in _fields(schema)]]
    data = [dict(zip(names, (i, *row))) for i, row in enumerate(rows)]
    typed = ", ".join(f"{n}: {k}" for n, k in [("seq", "int"), *_fields(schema)])
    return F.from_json(F.lit(json.dumps(data)), f"array<struct<{typed}>>")


def _per_tenant(spark: SparkSession, d: str, rows: list[tuple], schema: str) -> DataFrame:
    owner = F.concat(F.lit("T"), F.col("c_custkey").cast("string")).alias("owner")
    # The customers are spread before they are multiplied, so a single input file is no bottleneck.
    people = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    spread = people.repartition(shuffle_width(spark), "c_custkey")
    return spread.select(owner, "c_nationkey", F.explode(_literals(rows, schema)).alias("r")).select(
        "owner", "c_nationkey", "r.*"
    )


def _shared(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.range(1, numPartitions=1).select(F.explode(_literals(rows, schema)).alias("r")).select(
        F.lit(LOOKUPS).alias("owner"), "r.*"
    )


def cat_tables(spark: SparkSession, d: str) -> DataFrame:
    """owner, seq, table_name, num_rows, comments; views and one lookup have no statistics."""
    own = _per_tenant(spark, d, TABLES, _T_SCHEMA).select(
        "owner", "seq", "table_name",
        (F.col("base_rows") * (F.col("c_nationkey") + 1)).alias("num_rows"), "comments",
    )
    for i, name in enumerate(REF_STARS):
        counted = table(spark, d, name).agg(F.count(F.lit(1)).alias("num_rows"))
        own = own.unionByName(
            counted.select(
                F.lit(LOOKUPS).alias("owner"), F.lit(i).alias("seq"),
                F.lit(name.upper()).alias("table_name"), "num_rows",
                F.lit("shared " + name).alias("comments"),
            )
        )
    blank = _shared(spark, [("OFFER", None, None)], _T_SCHEMA).withColumn("seq", F.lit(9))
    return own.unionByName(blank.withColumnRenamed("base_rows", "num_rows"))


def cat_columns(spark: SparkSession, d: str) -> DataFrame:
    own = _per_tenant(spark, d, COLUMNS, _C_SCHEMA).drop("c_nationkey")
    return own.unionByName(_shared(spark, REF_COLUMNS, _C_SCHEMA))


def cat_constraints(spark: SparkSession, d: str) -> DataFrame:
    own = _per_tenant(spark, d, CONSTRAINTS, _K_SCHEMA).drop("c_nationkey")
    own = own.withColumn(
        "r_owner", F.when(F.col("r_owner") == "OWN", F.col("owner")).otherwise(F.col("r_owner"))
    )
    return own.unionByName(_shared(spark, REF_CONSTRAINTS, _K_SCHEMA))


def cat_constraint_columns(spark: SparkSession, d: str) -> DataFrame:
    own = _per_tenant(spark, d, CONSTRAINT_COLUMNS, _KC_SCHEMA).drop("c_nationkey")
    return own.unionByName(_shared(spark, REF_CONSTRAINT_COLUMNS, _KC_SCHEMA))


def exported_lookups(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Rows of the lookup tables under their catalog column names, with the file order as _seq."""
    return {
        name: table(spark, d, name.lower()).select(
            F.col(REF_SEQ[name]).alias("_seq"),
            *[F.col(star).alias(col) for col, star in fields.items()],
        )
        for name, fields in REF_FIELDS.items()
    }


def _sql_value(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return str(v)


def _sql_rows(rows: list[tuple], schema: str, alias: str) -> str:
    body = ",\n".join(
        "(" + ", ".join([str(i), *[_sql_value(v) for v in row]]) + ")" for i, row in enumerate(rows)
    )
    names = ", ".join(["seq", *[n for n, _ in _fields(schema)]])
    return f"(VALUES {body}) AS {alias}({names})"


def _cast_list(schema: str, skip: set[str] = frozenset()) -> str:
    return ", ".join(
        f"CAST(v.{n} AS {'VARCHAR' if k == 'string' else k.upper()}) AS {n}"
        for n, k in _fields(schema) if n not in skip
    )


_OWNER = "'T' || CAST(c_custkey AS VARCHAR) AS owner"

CAT_SQL = f"""
cat_tables AS (
  SELECT {_OWNER}, seq, table_name, CAST(base_rows AS BIGINT) * (c_nationkey + 1) AS num_rows, comments
  FROM customer, {_sql_rows(TABLES, _T_SCHEMA, 'v')}
  {''.join(f'''UNION ALL SELECT '{LOOKUPS}', {i}, '{t.upper()}', (SELECT count(*) FROM {t}), 'shared {t}'
  ''' for i, t in enumerate(REF_STARS))}
  UNION ALL SELECT '{LOOKUPS}', 9, 'OFFER', NULL, NULL
),
cat_columns AS (
  SELECT {_OWNER}, seq, {_cast_list(_C_SCHEMA)} FROM customer, {_sql_rows(COLUMNS, _C_SCHEMA, 'v')}
  UNION ALL SELECT '{LOOKUPS}', seq, {_cast_list(_C_SCHEMA)} FROM {_sql_rows(REF_COLUMNS, _C_SCHEMA, 'v')}
),
cat_constraints AS (
  SELECT {_OWNER}, seq, constraint_name, constraint_type, table_name,
         CASE WHEN r_owner = 'OWN' THEN 'T' || CAST(c_custkey AS VARCHAR) ELSE r_owner END AS r_owner,
         r_constraint_name
  FROM customer, {_sql_rows(CONSTRAINTS, _K_SCHEMA, 'v')}
  UNION ALL SELECT '{LOOKUPS}', seq, {_cast_list(_K_SCHEMA)} FROM {_sql_rows(REF_CONSTRAINTS, _K_SCHEMA, 'v')}
),
cat_constraint_columns AS (
  SELECT {_OWNER}, seq, {_cast_list(_KC_SCHEMA)} FROM customer, {_sql_rows(CONSTRAINT_COLUMNS, _KC_SCHEMA, 'v')}
  UNION ALL SELECT '{LOOKUPS}', seq, {_cast_list(_KC_SCHEMA)}
  FROM {_sql_rows(REF_CONSTRAINT_COLUMNS, _KC_SCHEMA, 'v')}
)"""

FK_SQL = """
fks AS (
  SELECT c.owner, c.table_name, c.constraint_name, cc.position, cc.column_name,
         c.r_owner, rc.table_name AS referenced_table, rcc.column_name AS referenced_column
  FROM cat_constraints c
  JOIN cat_constraint_columns cc ON c.owner = cc.owner AND c.constraint_name = cc.constraint_name
       AND c.table_name = cc.table_name
  JOIN cat_constraints rc ON c.r_owner = rc.owner AND c.r_constraint_name = rc.constraint_name
  JOIN cat_constraint_columns rcc ON rc.owner = rcc.owner AND rc.constraint_name = rcc.constraint_name
       AND rc.table_name = rcc.table_name AND cc.position = rcc.position
  WHERE c.constraint_type = 'R'
),
fk_map AS (
  SELECT owner, table_name, column_name,
         arg_max(r_owner || '.' || referenced_table || '.' || referenced_column,
                 (constraint_name, position)) AS fk
  FROM fks GROUP BY 1, 2, 3
)"""
