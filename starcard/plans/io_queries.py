"""Round trips through the sources and sinks."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starcard.operators import cards as C
from starcard.operators import catalog as K
from starcard.operators.runlog import assign_run_ids
from starcard.plans.catalog_queries import CARD_PARTS, EXPORTED, _cat, cards
from starcard.plans.readonly import run_readonly
from starcard.plans.registry import query, table
from starcard.plans.tenants import FK_SQL, LOOKUPS, cat_columns, cat_constraint_columns, cat_constraints, cat_tables
from starcard.rules import RUN_FIELDS
from starcard.session import scratch_path, shuffled, shuffles_dropped
from starcard.sources import exports as E
from starcard.sources import files, sinks


@query(
    "src_csv_tables",
    """SELECT 'orders' AS name, o_orderkey AS id, CAST(o_custkey AS VARCHAR) AS a, o_orderpriority AS b, o_totalprice AS x,
              o_orderdate AS at, 'bigint,bigint,string,decimal(15,2),timestamp,string' AS kinds FROM orders
       UNION ALL SELECT 'customer', c_custkey, c_name, c_mktsegment, c_acctbal, NULL, 'bigint,string,bigint,decimal(15,2),string' FROM customer
       UNION ALL SELECT 'nation', n_nationkey, n_name, NULL, NULL, NULL, 'bigint,string,bigint' FROM nation
       UNION ALL SELECT 'events', event_id, event_type, props, value, ts, 'int,timestamp,int,string,double,string' FROM events""",
)
def src_csv_tables(spark: SparkSession, d: str) -> DataFrame:
    """A folder of exports, typed by the dictionary (a table that it doesn't know by its rows), stored as the tables of a namespace."""
    exports, store = scratch_path(spark, "csv"), scratch_path(spark, "store")
    columns = []
    for name in ("orders", "customer", "nation", "events"):
        rows = table(spark, d, name)
        exact = {k: "yyyy-MM-dd'T'HH:mm:ss.SSSSSS" for k in ("timestampFormat", "timestampNTZFormat")}
        rows.write.option("header", True).option("escape", '"').options(**exact).csv(f"{exports}/{name}")
        for i, f in enumerate(rows.schema if name != "events" else []):
            kind = f.dataType.typeName().removesuffix("_ntz")
            kind = {"string": ("VARCHAR2", None, None), "timestamp": ("DATE", None, None), "double": ("NUMBER", 15, 2)}.get(kind, ("NUMBER", 15, 0))
            columns.append(("STAR", name.upper(), f.name, i, *kind))
    shape = "owner string, table_name string, column_name string, column_id int, data_type string, data_precision int, data_scale int"
    known = spark.createDataFrame(columns, shape).withColumns({c: F.lit(100) for c in ("data_length", "char_length")})
    for name, rows in files.read_csv_folder(spark, exports, known, "STAR").items():
        files.build_namespace(rows, store, "STAR", name, reset=True)
    spots = files.discover_namespaces(spark, store)["STAR"]
    none = F.lit(None)
    picked = {
        "orders": ("o_orderkey", F.col("o_custkey").cast("string"), "o_orderpriority", "o_totalprice", "o_orderdate"),
        "customer": ("c_custkey", "c_name", "c_mktsegment", "c_acctbal", none), "nation": ("n_nationkey", "n_name", none, none, none),
        "events": ("event_id", "event_type", "props", "value", "ts"),
    }
    frames = []
    for name, (key, a, b, x, at) in picked.items():
        rows = spark.read.parquet(spots[name])
        kinds = ",".join(f.dataType.simpleString() for f in rows.schema)
        cells = [c if not isinstance(c, str) else F.col(c) for c in (key, a, b, x, at)]
        cells = [c.cast(k) for c, k in zip(cells, ("long", "string", "string", "double", "timestamp"), strict=True)]
        frames.append(rows.select(F.lit(name).alias("name"), *cells, F.lit(kinds)).toDF("name", "id", "a", "b", "x", "at", "kinds"))
    return files.union_all(frames)


def _same(*names: str) -> dict[str, str]:
    return {n: n for n in names}


#: Rows of each array of an export, as expressions that Spark and the check share: (source, order, {field: expression}, name, detail).
_ARRAYS = {
    "tables": ("cat_tables", "seq", _same("table_name", "num_rows") | {"logging": "'YES'"}, "logging", "num_rows"),
    "table_comments": ("cat_tables", "seq", _same("table_name", "comments"), "table_name", "comments"),
    "columns": (
        "cat_columns", "seq",
        _same("table_name", "column_name", "column_id", "data_type", "data_length", "data_precision", "data_scale", "char_length", "nullable"),
        "column_name", "data_type",
    ),
    "column_comments": ("cat_columns", "seq", _same("table_name", "column_name", "comments"), "column_name", "comments"),
    "constraints": (
        "cat_constraints", "seq", _same("constraint_name", "constraint_type", "table_name", "r_owner", "r_constraint_name"),
        "constraint_name", "constraint_type",
    ),
    "constraint_columns": ("cat_constraint_columns", "seq", _same("constraint_name", "table_name", "column_name", "position"), "column_name", "position"),
    "foreign_keys": (
        "fks", "table_name, constraint_name, position",
        _same("table_name", "constraint_name", "r_owner", "referenced_table", "column_name", "position", "referenced_column"),
        "column_name", "referenced_column",
    ),
    "indexes": ("cat_constraints", "seq", _same("table_name") | {"index_name": "concat('IX_', constraint_name)", "uniqueness": "'UNIQUE'"}, "index_name", "uniqueness"),
    "index_columns": (
        "cat_constraint_columns", "seq", _same("table_name", "column_name") | {"index_name": "constraint_name", "column_position": "position", "descend": "'ASC'"},
        "index_name", "column_position",
    ),
    "triggers": (
        "cat_tables", "seq", _same("table_name") | {"trigger_name": "concat('TRG_', table_name)", "when_clause": "concat('NEW.N > ', seq, chr(10), '„ß\"“')"},
        "trigger_name", "when_clause",
    ),
    "grants": (
        "cat_tables", "seq",
        _same("table_name") | {"table_schema": "CASE WHEN {odd} THEN owner END", "grantee": "concat('R_', table_name)", "privilege": "'SELECT'",
                               "type": "CASE WHEN NOT {odd} THEN 'TABLE' END", "hierarchy": "CASE WHEN {odd} THEN 'NO' END"},
        "grantee", "kind",
    ),
    "synonyms": ("cat_tables", "seq", _same("table_name") | {"synonym_name": "concat('S_', table_name)", "table_owner": "owner"}, "synonym_name", "table_owner"),
}


def _item(told: dict[str, str], sent: dict[str, str]) -> Callable[[Column], Column]:
    """An array's struct from a row that has the expressions ``sent``; the others are constants of the schema."""
    return lambda row: F.struct(*[(row[sent[e]] if e in sent else F.expr(e)).alias(f) for f, e in told.items()])


def _write_exports(spark: SparkSession, d: str) -> str:
    """A JSON object over many lines per schema, without its null fields; a compressed file holds many of them, a record separator between.

    All arrays of a source are gathered in one pass, so a schema is shuffled once per source. Odd schemas name owner and kind of a grant another way and have no array of triggers.
    """
    constraints, held = cat_constraints(spark, d), cat_constraint_columns(spark, d)
    frames = {
        "cat_tables": cat_tables(spark, d), "cat_columns": cat_columns(spark, d), "cat_constraints": constraints,
        "cat_constraint_columns": held, "fks": K.resolve_foreign_keys(K.keyed_columns(constraints, held)),
    }
    odd = "owner rlike '[13579]$'"
    whole = files.union_all([rows.select("owner") for name, rows in frames.items() if name != "fks"]).distinct()
    for source, rows in frames.items():
        arrays = {a: cells for a, (s, _, cells, *_) in _ARRAYS.items() if s == source}
        order = next(o for s, o, *_ in _ARRAYS.values() if s == source)
        # A row travels once, with what its arrays are made of; what the owner alone decides is added where the rows are.
        made = dict.fromkeys(e.format(odd=odd) for cells in arrays.values() for e in cells.values())
        sent = {e: f"e{i}" for i, e in enumerate(made) if set(re.findall(r"\w+", e)) & set(rows.columns) - {"owner"}}
        places = [F.col(c).alias(f"o{i}") for i, c in enumerate(order.split(", "))]
        part = rows.groupBy("owner").agg(F.sort_array(F.collect_list(F.struct(*places, *[F.expr(e).alias(c) for e, c in sent.items()]))).alias("x"))
        held = {}
        for array, cells in arrays.items():
            owner = f"CASE WHEN NOT {odd} THEN owner END" if array == "grants" else "owner"
            told = {"owner": owner} | {f: e.format(odd=odd) for f, e in cells.items()}
            held[array] = F.transform("x", _item(told, sent))
        if "triggers" in held:
            held["triggers"] = F.when(~F.expr(odd), held["triggers"])
        whole = whole.join(shuffled(part.select("owner", *[c.alias(a) for a, c in held.items()])), "owner", "left")
    told = F.struct(F.col("owner").alias("schema"), F.lit("2024-01-01").alias("generated_at"), *_ARRAYS)
    path = scratch_path(spark, "metadata")
    with shuffles_dropped(spark):
        whole.select(F.to_json(told, {"pretty": "true"}).alias("value")).write.option("lineSep", E.SEPARATOR).option("compression", "gzip").text(path)
    return path


def _told_sql(array: str) -> str:
    source, order, cells, name, detail = _ARRAYS[array]
    odd = "regexp_matches(owner, '[13579]$')"
    cells = {f: e.format(odd=odd) for f, e in cells.items()} | {"kind": f"CASE WHEN {odd} THEN 'NO' ELSE 'TABLE' END"}
    return f"""SELECT '{array}' AS part, owner AS schema, CAST(row_number() OVER (PARTITION BY owner ORDER BY {order}) - 1 AS INTEGER) AS pos,
      owner AS owned, table_name, CAST({cells[name]} AS VARCHAR) AS name, CAST({cells[detail]} AS VARCHAR) AS detail
      FROM {source} {f'WHERE NOT {odd}' if array == 'triggers' else ''}"""


@query("src_metadata_json", _cat(" UNION ALL ".join(_told_sql(a) for a in _ARRAYS), FK_SQL))
def src_metadata_json(spark: SparkSession, d: str) -> DataFrame:
    """All twelve arrays of every schema's export, by position, read from files over many lines."""
    exports = E.Exports(spark, _write_exports(spark, d), "*.txt.gz")
    rows = []
    for array, (*_, name, detail) in _ARRAYS.items():
        held = exports.grants() if array == "grants" else exports.array(array)
        owner = F.col("index_owner" if array == "index_columns" else "owner")
        owner = F.coalesce(owner, F.col("schema")) if array == "index_columns" else owner
        rows.append(held.select(
            F.lit(array).alias("part"), "schema", "pos", owner.alias("owned"), "table_name", F.col(name).cast("string").alias("name"),
            F.col(detail).cast("string").alias("detail"),
        ))
    return files.union_all(rows)


@query(
    "cards_from_exports",
    _cat("""SELECT qualified_name, row_count, primary_key, table_description, pos, column_name, type, nullable,
                   description, fk, value_map_ref FROM card""", *CARD_PARTS),
)
def cards_from_exports(spark: SparkSession, d: str) -> DataFrame:
    """Cards of all schemas from their exports alone, comments and references being arrays of their own."""
    exports = E.Exports(spark, _write_exports(spark, d), "*.txt.gz")
    return C.flatten(C.nest(E.assemble_exports(exports, LOOKUPS, exported=EXPORTED)))


@query(
    "src_cards_json",
    _cat("SELECT qualified_name, column_name, type, nullable, description, fk FROM card", *CARD_PARTS),
)
def src_cards_json(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "cards")
    sinks.write_cards(cards(spark, d), path)
    return C.flatten(files.read_cards(spark, path)).select(
        "qualified_name", "column_name", "type", "nullable", "description", "fk"
    )


@query(
    "sink_cards",
    _cat(
        """SELECT table_name, count(*) AS n, count(*) FILTER (WHERE table_name IN ('ORDERS', 'PART')) AS kept
           FROM (SELECT DISTINCT owner, table_name FROM card) GROUP BY 1""",
        *CARD_PARTS,
    ),
)
def sink_cards(spark: SparkSession, d: str) -> DataFrame:
    """Two tables of every schema are there already; they stay, the others are added."""
    path = scratch_path(spark, "cards")
    everything = cards(spark, d)
    name = F.col("table_metadata.name")
    old = everything.filter(name.isin("ORDERS", "PART")).withColumn(
        "special_handling", F.create_map(F.lit("note"), F.lit("kept"))
    )
    sinks.write_cards(old, path)
    sinks.write_cards(everything, path, existing=files.read_cards(spark, path))
    return files.read_cards(spark, path).groupBy(name.alias("table_name")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("special_handling").isNotNull()).alias("kept")
    )


_NOT_SYSTEM = """table_name NOT LIKE 'DR$%' AND table_name NOT LIKE 'BIN$%' AND table_name NOT LIKE 'MLOG$%'
  AND table_name NOT LIKE 'RUPD$%' AND table_name NOT LIKE 'ZZ_%' AND table_name NOT LIKE 'RV$%'"""


#: The view behind each array; a schema's grants come in either form.
_VIEWS = [a for a in _ARRAYS if a != "foreign_keys"]


@query(
    "src_jdbc_dictionary",
    _cat(
        "SELECT part AS view, schema AS owner, table_name, count(*) AS n, min(name) AS first, CAST(max(wide) AS INTEGER) AS n_columns FROM ("
        + " UNION ALL ".join(f"SELECT *, {6 if v == 'grants' else len({'owner', *_ARRAYS[v][2]} - {'table_owner'})} AS wide FROM ({_told_sql(v)})" for v in _VIEWS)
        + f") WHERE {_NOT_SYSTEM} GROUP BY ALL",
        FK_SQL,
    ),
)
def src_jdbc_dictionary(spark: SparkSession, d: str) -> DataFrame:
    """The shaping done to each of the eleven views, on views held as frames instead of a database; grants come in both forms."""
    frames = {
        "cat_tables": cat_tables(spark, d), "cat_columns": cat_columns(spark, d), "cat_constraints": cat_constraints(spark, d),
        "cat_constraint_columns": cat_constraint_columns(spark, d),
    }
    odd, rows = "owner rlike '[13579]$'", []
    for view in _VIEWS:
        source, _, cells, name, _ = _ARRAYS[view]
        forms = {"grants": [(f"NOT {odd}", "owner", ("type", "'TABLE'")), (odd, "table_schema", ("hierarchy", "'NO'"))]}
        for form, owner, more in forms.get(view, [("true", files.OWNER_COLUMN.get(view, "owner"), None)]):
            told = {f: e for f, e in cells.items() if f not in ("type", "hierarchy", "table_schema", owner)}
            told |= {"grantable": "'NO'"} | dict([more]) if more else {}
            named = F.col("owner").alias(owner.upper())
            held = frames[source].filter(form).select(named, *[F.expr(e).alias(f.upper()) for f, e in told.items()])
            shaped = files.shape_view(view, held.filter(f"NOT {odd}") if view == "triggers" else held)
            key = files.owner_column(view, shaped.columns)
            first = F.col(shaped.columns[-1] if name == "kind" else name).cast("string").alias("first")
            rows.append(shaped.select(F.lit(view).alias("view"), F.col(key).alias("owner"), "table_name", first, F.lit(len(shaped.columns)).alias("wide")))
    return files.union_all(rows).groupBy("view", "owner", "table_name").agg(
        F.count(F.lit(1)).alias("n"), F.min("first").alias("first"), F.max("wide").alias("n_columns")
    )


_LINE_ORDER = [
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
    "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]
_LINE_SQL = f"SELECT * FROM lineitem ORDER BY {', '.join(_LINE_ORDER)} LIMIT"


@query("first_n", f"SELECT l_orderkey, l_linenumber, l_partkey FROM ({_LINE_SQL} 50)")
def first_n(spark: SparkSession, d: str) -> DataFrame:
    first = sinks.first_rows(table(spark, d, "lineitem"), _LINE_ORDER, 50)
    return first.select("l_orderkey", "l_linenumber", "l_partkey")


@query(
    "sample_export",
    f"SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM ({_LINE_SQL} 1000)",
)
def sample_export(spark: SparkSession, d: str) -> DataFrame:
    root = scratch_path(spark, "samples")
    lines = table(spark, d, "lineitem")
    sinks.export_samples({"lineitem": (lines, _LINE_ORDER), "broken": (lines, ["no_such_column"])}, root)
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in lines.schema)
    return files.read_csv_table(spark, f"{root}/lineitem", shape).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"
    )


def _run_rows(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    return events.select(
        (F.col("event_id") + 1).alias("run_id"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        F.col("event_type").alias("user_query"),
        F.concat(F.lit("SELECT * FROM t WHERE user_id = "), "user_id").alias("sql"),
        F.lit("sqlite").alias("sql_dialect"),
        F.col("props").alias("sql_rationale"),
        F.to_json(F.array(F.concat(F.lit("S."), "event_type"))).alias("tables_used"),
        F.lit("main").alias("deployment_name"),
    )


@query(
    "sink_run_log",
    """SELECT event_id + 1 AS run_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp, event_type AS user_query,
              'SELECT * FROM t WHERE user_id = ' || user_id AS sql, 'sqlite' AS sql_dialect, props AS sql_rationale,
              '["S.' || event_type || '"]' AS tables_used, 'main' AS deployment_name FROM events
       UNION ALL
       SELECT (SELECT max(event_id) + 1 FROM events) + row_number() OVER (ORDER BY o_orderkey), '1970-01-01T00:00:00',
              o_orderpriority, 'SELECT 1', 'sqlite', '', '[]', 'main' FROM orders""",
)
def sink_run_log(spark: SparkSession, d: str) -> DataFrame:
    """The events are logged first, then the orders as a second batch numbered after them."""
    path = scratch_path(spark, "run-log")
    sinks.append_runs(_run_rows(spark, d), path)
    log = spark.read.parquet(path)
    batch = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    numbered = assign_run_ids(batch, ["o_orderkey"], log).select(
        "run_id", F.lit("1970-01-01T00:00:00").alias("timestamp"), F.col("o_orderpriority").alias("user_query"),
        F.lit("SELECT 1").alias("sql"), F.lit("sqlite").alias("sql_dialect"), F.lit("").alias("sql_rationale"),
        F.lit("[]").alias("tables_used"), F.lit("main").alias("deployment_name"),
    )
    sinks.append_runs(numbered, path)
    return spark.read.parquet(path)


@query(
    "keys_symdiff",
    f"""SELECT 'missing' AS side, f AS field FROM (VALUES {', '.join(f"('{f}')" for f in RUN_FIELDS)}) v(f)
        WHERE f NOT IN (SELECT DISTINCT event_type FROM events UNION SELECT 'run_id')
        UNION ALL SELECT 'extra', event_type FROM (SELECT DISTINCT event_type FROM events)
        WHERE event_type NOT IN ({', '.join(f"'{f}'" for f in RUN_FIELDS)})""",
)
def keys_symdiff(spark: SparkSession, d: str) -> DataFrame:
    """Field names seen in the data against the fields the log expects."""
    given = table(spark, d, "events").select(F.col("event_type").alias("field")).distinct()
    given = given.union(spark.createDataFrame([("run_id",)], "field string")).distinct()
    expected = spark.createDataFrame([(f,) for f in RUN_FIELDS], "field string")
    missing = expected.join(given, "field", "left_anti").select(F.lit("missing").alias("side"), "field")
    return missing.union(given.join(expected, "field", "left_anti").select(F.lit("extra"), "field"))


_DUMP_SQL = """SELECT 'run_' || CASE WHEN event_id < 100000 THEN printf('%05d', event_id) ELSE CAST(event_id AS VARCHAR) END
  || '.json' AS file, event_id AS run_id,
  '{"user_query":"' || event_type || '","sql":"SELECT ' || user_id || '","rationale":null}' AS value FROM events"""


def _states(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        F.col("event_id").alias("run_id"), F.col("event_type").alias("user_query"),
        F.concat(F.lit("SELECT "), "user_id").alias("sql"), F.lit(None).cast("string").alias("rationale"),
    )


@query("sink_state_dump", _DUMP_SQL)
def sink_state_dump(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "dumps")
    sinks.write_dumps(_states(spark, d), path)
    return spark.read.parquet(path).select("file", "run_id", "value")


@query("history_list", _DUMP_SQL + " ORDER BY file")
def history_list(spark: SparkSession, d: str) -> DataFrame:
    """All runs in order of their names, each opened."""
    path = scratch_path(spark, "dumps")
    sinks.write_dumps(_states(spark, d), path)
    return sinks.open_dumps(spark, path)


@query(
    "attach_namespaces",
    """SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""",
)
def attach_namespaces(spark: SparkSession, d: str) -> DataFrame:
    """Two schemas found in a folder and queried where they lie; a schema with a bad name is left out."""
    root = scratch_path(spark, "schemas")
    for schema, name in (("star_facts", "customer"), ("star_lookup", "nation"), ("drop;table", "nation")):
        files.build_namespace(table(spark, d, name), root, schema, name)
    files.attach_namespaces(spark, files.discover_namespaces(spark, root), scratch_path(spark, "declared"))
    df, _ = run_readonly(
        spark,
        """SELECT n.n_name, count(*) AS n FROM star_facts.customer AS c
           JOIN star_lookup.nation AS n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name""",
    )
    return df
