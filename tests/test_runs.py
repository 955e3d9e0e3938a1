"""Read-only gate, run log, sources, sinks and streams."""

import datetime
import json
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from starcard.operators import cards as C
from starcard.operators import runlog as R
from starcard.plans.catalog_queries import restrict_schemas
from starcard.plans.io_queries import history_list
from starcard.plans.readonly import Outcome, check_sql, run_readonly, write_result
from starcard.rules import RUN_FIELDS
from starcard.session import Scratch, build_session, scratch_path, stored
from starcard.sources import files, sinks
from starcard.streaming import runs
from starcard.streaming.runs import read_stream, stream_progress, stream_run_log


@pytest.fixture(scope="module")
def patients(spark):
    return spark.createDataFrame([(1, "ann"), (2, "bob")], "id int, name string")


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT id, name FROM {p} WHERE id = 1", "SELECT * FROM {p}", "SELECT * FROM {p} LIMIT 1;",
        "WITH t AS (SELECT * FROM {p}) SELECT count(*) AS n FROM t", "SELECT 1 AS x -- note",
        "-- why\n/* a\nb */ (SELECT 1 AS x)",
    ],
)
def test_gate_admits(spark, patients, sql):
    df, outcome = run_readonly(spark, sql, p=patients)
    assert outcome.success and outcome.is_valid and df.count() >= 0
    assert outcome.summary() == "No errors - validation passed"


@pytest.mark.parametrize(
    "sql",
    [
        "SELEC * FROM x", "INSERT INTO x VALUES (1)", "UPDATE x SET a = 1", "DELETE FROM x", "DROP TABLE x",
        "CREATE TABLE x (a int)", "SET a = 1", "SELECT 1; SELECT 2", "SELECT 1; DROP TABLE x", "EXPLAIN SELECT 1",
        "SHOW TABLES", "DESCRIBE x", "WITH t AS (SELECT 1) INSERT INTO x SELECT * FROM t", "CACHE TABLE x", "/* SELECT */ SHOW TABLES", "VALUES (1)",
        "-- WITH\nDELETE FROM x", "",
        None, ";",
    ],
)
def test_gate_refuses(spark, sql):
    df, outcome = run_readonly(spark, sql)
    assert df is None and outcome.syntax_errors and outcome.validation_failed and not outcome.success
    assert outcome.error_message.startswith("Validation failed: Syntax errors: ")


@pytest.mark.parametrize("sql", ["SELECT * FROM no_such_table", "SELECT nope FROM (SELECT 1 AS a) AS t"])
def test_gate_schema_errors(spark, sql):
    df, outcome = check_sql(spark, sql)
    assert df is None and not outcome.syntax_errors and outcome.explain_errors
    assert outcome.summary().startswith("EXPLAIN errors: ")


def test_result_metrics(spark, patients):
    df, outcome = run_readonly(spark, "SELECT * FROM {p}", p=patients)
    write_result(df, outcome, scratch_path(spark, "r"))
    assert outcome.row_count == 2 and outcome.execution_time_ms > 0 and outcome.column_names == ["id", "name"]
    df, outcome = run_readonly(spark, "SELECT id, id FROM {p}", p=patients)
    assert not write_result(df, outcome, scratch_path(spark, "r")).success
    df, outcome = run_readonly(spark, "SELECT CAST(name AS INT) AS n FROM {p}", p=patients)
    write_result(df, outcome, scratch_path(spark, "r"))
    assert not outcome.success and outcome.error_message.startswith("SQL execution error: ")


def test_summary_text():
    both = Outcome("x", ["a", "b"], ["c"])
    assert both.summary() == "Syntax errors: a; b\nEXPLAIN errors: c" and not both.is_valid


def test_outcomes_match(spark):
    runs = spark.createDataFrame(
        [(1, 0, [], []), (2, 0, ["a", "b"], []), (3, 1, [], ["c"]), (4, 5, ["a"], ["c"]), (5, 0, None, None)],
        "run_id int, repair_attempts int, syntax_errors array<string>, explain_errors array<string>")
    for r in R.validated(runs.filter("syntax_errors is not null")).collect():
        twin = Outcome("", list(r["syntax_errors"]), list(r["explain_errors"]))
        assert (r["is_valid"], r["summary"]) == (twin.is_valid, twin.summary())
        assert r["all_errors"] == twin.syntax_errors + twin.explain_errors
    steps = {r["run_id"]: r["s"] for r in runs.select("run_id", R.route().alias("s")).collect()}
    assert steps == {1: "sql_executor", 2: "sql_repairer", 3: "validation_failed", 4: "validation_failed", 5: "validation_failed"}
    told = {r["run_id"]: r["error_message"] for r in R.blocked(runs).collect()}
    assert set(told) == {2, 3, 4, 5} and told[2] == "Validation failed: Syntax errors: a; b"
    assert told[5] == "Validation failed: Validation failed (no details available)"


def test_run_ids(spark):
    batch = spark.createDataFrame([("b",), ("a",), ("c",)], "q string")

    def ids(log):
        return {r["q"]: r["run_id"] for r in R.assign_run_ids(batch, ["q"], log).collect()}

    assert ids(None) == {"a": 1, "b": 2, "c": 3}
    assert ids(spark.createDataFrame([], "run_id string")) == {"a": 1, "b": 2, "c": 3}
    assert ids(spark.createDataFrame([("1",), ("3",), (None,)], "run_id string")) == {"a": 4, "b": 5, "c": 6}
    with pytest.raises(RuntimeError, match="not a number"):
        ids(spark.createDataFrame([("x",)], "run_id string"))


def test_append_runs(spark):
    path = scratch_path(spark, "log")
    row = spark.range(1).select(*[F.lit("v").alias(f) for f in reversed(RUN_FIELDS)])
    sinks.append_runs(row, path)
    sinks.append_runs(row, path)
    assert spark.read.parquet(path).count() == 2 and spark.read.parquet(path).columns == RUN_FIELDS
    with pytest.raises(ValueError, match=r"missing \['sql'\], extra \['more'\]"):
        sinks.append_runs(row.drop("sql").withColumn("more", F.lit(1)), path)


def test_dumps(spark):
    states = spark.createDataFrame([(1, "é", None), (123456, "q", "s")], "run_id int, user_query string, sql string")
    path = scratch_path(spark, "dumps")
    sinks.write_dumps(states, path)
    rows = sinks.list_dumps(spark, path).collect()
    assert [r["file"] for r in rows] == ["run_00001.json", "run_123456.json"]
    assert sinks.read_dump(spark, path, 1).first()["value"] == '{"user_query":"é","sql":null}'
    assert sinks.read_dump(spark, path, 123456).first()["file"] == "run_123456.json"


def card(schema, name, **more):
    return {
        "table_metadata": {"qualified_name": f"{schema}.{name}", "schema_name": schema, "name": name},
        "columns": [{"name": "ID", "type": "NUMBER"}], **more}


def test_card_folders(spark, tmp_path):
    assert files.read_card_folders(spark, str(tmp_path / "none")).count() == 0
    for schema, name in (("S1", "A"), ("S1", "B"), ("S2", "C")):
        os.makedirs(tmp_path / schema, exist_ok=True)
        (tmp_path / schema / f"{name.lower()}.json").write_text(json.dumps(card(schema, name, extra=1), indent=2))
    (tmp_path / "S1" / "notes.txt").write_text("ignored")
    base = str(tmp_path)
    assert files.read_card_folders(spark, base).count() == 3
    assert files.read_card_folders(spark, base, ["S1"]).count() == 2
    counts = files.available_schemas(files.read_card_folders(spark, base))
    assert {r["schema_name"]: r["n"] for r in counts.collect()} == {"S1": 2, "S2": 1}
    with pytest.raises(ValueError, match="no folder for schema"):
        files.read_card_folders(spark, base, ["S1", "S9"])
    (tmp_path / "S2" / "bad.json").write_text("{not json")
    with pytest.raises(Exception, match="FAILED_READ_FILE|MALFORMED"):
        files.read_card_folders(spark, base, ["S2"]).collect()
    (tmp_path / "S2" / "bad.json").write_text(json.dumps({"table_metadata": {}}))
    with pytest.raises(PySparkException, match="required field"):
        files.read_card_folders(spark, base, ["S2"]).collect()


def test_write_cards(spark):
    text = [json.dumps(card("S1", n)) for n in "ABC"] + [json.dumps(card("S2", "A"))]
    cards = spark.createDataFrame([(t,) for t in text], "t string").select(F.from_json("t", C.CARD_SCHEMA).alias("c")).select("c.*")
    path = scratch_path(spark, "cards")
    assert sinks.write_cards(cards.filter("table_metadata.name = 'A'"), path) == {"generated": 2, "skipped": 0, "filtered": 0}
    only = F.col("table_metadata.name") == "A"
    assert sinks.write_cards(cards, path, files.read_cards(spark, path), filtered=~only) == {"generated": 0, "skipped": 2, "filtered": 2}
    assert sinks.write_cards(cards, path, files.read_cards(spark, path)) == {"generated": 2, "skipped": 2, "filtered": 0}
    assert files.read_cards(spark, path).count() == 4 and files.read_cards(spark, path, ["S2"]).count() == 1
    with pytest.raises(ValueError):
        files.read_cards(spark, path, ["S9"])
    other = scratch_path(spark, "cards")
    assert sinks.write_cards(cards, other, overwrite=True)["generated"] == 4


def test_schema_filter(spark):
    df = spark.createDataFrame([("a",), ("b",)], "s string")
    assert restrict_schemas(df, "s", None).count() == 2 and restrict_schemas(df, "s", ["a"]).count() == 1
    for wrong in ([], ["a", "x"]):
        with pytest.raises(ValueError):
            restrict_schemas(df, "s", wrong)


def test_dictionary_shape(spark):
    assert files.owner_column("grants", ["OWNER", "TYPE"]) == "owner"
    assert files.owner_column("grants", ["TABLE_SCHEMA"]) == "table_schema"
    assert files.owner_column("grants", ["X"]) is None and files.owner_column("index_columns", []) == "index_owner"
    grants = spark.createDataFrame(
        [("A", "T", "g", "p", "Y", "N"), ("A", "BIN$1", "g", "p", "Y", "N")],
        "TABLE_SCHEMA string, TABLE_NAME string, GRANTEE string, PRIVILEGE string, GRANTABLE string, HIERARCHY string")
    shaped = files.shape_view("grants", grants)
    assert shaped.columns[-1] == "hierarchy" and shaped.count() == 1


def test_namespace_and_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "x", \n b')], "id bigint, t string")
    csv = str(tmp_path / "csv")
    df.write.option("header", True).option("escape", '"').csv(csv)
    read = files.read_csv_table(spark, csv, "id bigint, t string", multi_line=True)
    assert read.first() == df.first()
    root = str(tmp_path / "store")
    files.build_namespace(read, root, "S", "t", reset=True)
    with pytest.raises(PySparkException):
        files.build_namespace(read, root, "S", "t")
    found = files.list_files(spark, csv, "*.csv").select("folder").distinct().collect()
    assert [r["folder"] for r in found] == ["csv"]


def test_metadata_json(spark, tmp_path):
    (tmp_path / "metadata.json").write_text(json.dumps({"schema": "A", "tables": [{"table_name": "T"}, {"table_name": "U"}], "grants": []}, indent=1))
    meta = files.read_metadata(spark, str(tmp_path))
    assert {(r["schema"], r["table_name"]) for r in files.metadata_rows(meta, "tables").collect()} == {("A", "T"), ("A", "U")}


def test_streams(spark, tmp_path):
    rows = [(i, i // 3, i % 5, f"s{i % 4}", float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "id bigint, sec bigint, run bigint, step string, v double")
    df = df.withColumn("ts", F.timestamp_seconds(F.col("sec") + 1_700_000_000))
    folder = str(tmp_path / "in")
    for part in range(3):
        df.filter(F.col("id") % 3 == part).coalesce(1).write.mode("append").parquet(folder)
    live = read_stream(spark, folder, df.schema)
    streamed = stream_progress(live, "run", "ts", "id", "v", "step")
    assert {tuple(r) for r in streamed.collect()} == {
        tuple(r) for r in R.fold_progress(df, "run", "ts", "id", "v", "step").collect()}
    twice = live.withColumn("n", F.explode(F.array(F.lit(1), F.lit(2)))).select(F.col("id").alias("run_id"), "ts", "v")
    log = stream_run_log(twice, scratch_path(spark, "log"), ["run_id", "ts", "v"])
    assert log.count() == 60
    with pytest.raises(ValueError):
        stream_run_log(twice, scratch_path(spark, "log"), ["run_id", "ts"])


def test_session_is_shared(spark):
    assert build_session(app="again").sparkContext is spark.sparkContext


def test_run_log_keeps_late_runs_and_goes_on_in_later_calls(spark, tmp_path):
    kind = "run_id long, ts timestamp, v string"
    folder, log = str(tmp_path / "in"), str(tmp_path / "log")

    def deliver(*rows):
        spark.createDataFrame([(i, datetime.datetime(2024, 1, day), v) for i, day, v in rows], kind).coalesce(1).write.mode("append").parquet(folder)
        return stream_run_log(read_stream(spark, folder, spark.createDataFrame([], kind).schema), log, ["run_id", "ts", "v"])

    assert {r["run_id"] for r in deliver((10, 9, "a"), (11, 9, "b")).collect()} == {10, 11}
    assert {r["run_id"] for r in deliver((12, 5, "four days late"), (10, 9, "a")).collect()} == {10, 11, 12}
    again = deliver((13, 9, "c"))
    assert sorted(r["run_id"] for r in again.collect()) == [10, 11, 12, 13]
    other = read_stream(spark, folder, again.schema)
    fresh = stream_run_log(other, log, ["run_id", "ts", "v"], checkpoint=str(tmp_path / "fresh"))
    assert sorted(r["run_id"] for r in fresh.collect()) == [10, 11, 12, 13]


def test_a_batch_reads_the_ranges_it_has_runs_of(spark, tmp_path, monkeypatch):
    kind, folder, path = "run_id long, v string", str(tmp_path / "in"), str(tmp_path / "log")
    asked = []
    plain = runs._logged
    monkeypatch.setattr(runs, "_logged", lambda *a: asked.append((a[3], plain(*a))) or asked[-1][1])

    def deliver(*ids):
        spark.createDataFrame([(i, "x") for i in ids], kind).coalesce(1).write.mode("append").parquet(folder)
        return sorted(r["run_id"] if r["run_id"] is not None else -1 for r in stream_run_log(read_stream(spark, folder, spark.createDataFrame([], kind).schema), path, ["run_id", "v"]).collect())

    assert deliver(1, 250_000, 900_000) == [1, 250_000, 900_000]
    assert deliver(250_000, 250_001, 250_001, -5, None) == [-5, -1, 1, 250_000, 250_001, 900_000]
    assert asked[-1][0] == [-1, 2]
    assert "run_range#" in asked[-1][1]._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: ")[1][:60]


def test_folders_become_tables_and_namespaces(spark, tmp_path):
    csv = str(tmp_path / "csv")
    spark.createDataFrame([(1, "a,b", 2.5)], "id long, t string, x double").write.option("header", True).csv(f"{csv}/items")
    spark.createDataFrame([("q",)], "c string").write.option("header", True).csv(f"{csv}/unknown")
    kind = "owner string, table_name string, column_name string, column_id int, data_type string, data_length int, data_precision int, data_scale int, char_length int"
    columns = spark.createDataFrame([
        ("S", "ITEMS", "t", 2, "VARCHAR2", 20, None, None, 20), ("S", "ITEMS", "id", 1, "NUMBER", 22, 15, 0, None),
        ("S", "ITEMS", "x", 3, "NUMBER", 22, None, None, None), ("OTHER", "ITEMS", "id", 1, "CLOB", 1, None, None, None)], kind)
    read = files.read_csv_folder(spark, csv, columns, "s")
    assert set(read) == {"items", "unknown"} and read["items"].columns == ["id", "t", "x"]
    assert read["items"].first()["id"] == 1 and read["items"].schema["id"].dataType.typeName() != "string"
    root = str(tmp_path / "ns")
    for schema in ("good_one", "bad name"):
        files.build_namespace(read["items"], root, schema, "items")
    found = files.discover_namespaces(spark, root)
    assert found == {"good_one": {"items": f"{root}/good_one/items"}}
    assert files.discover_namespaces(spark, root, "x*") == {} == files.discover_namespaces(spark, str(tmp_path / "none"))
    assert files.attach_namespaces(spark, {**found, "bad;name": {}}, str(tmp_path / "declared")) == ["good_one"]
    assert spark.sql("SELECT sum(id) AS n FROM good_one.items").first()["n"] == 1


def test_scratch_is_deleted_by_its_owner(spark):
    with Scratch(spark) as own:
        assert stored(spark.range(5), "numbers").count() == 5
    assert len(own.paths) == 1 and not os.path.exists(own.paths[0].removeprefix("file:"))
    assert stored(spark.range(5), "numbers").count() == 5


def test_a_cluster_without_a_shared_folder_is_refused(spark, monkeypatch):
    from starcard import session

    class Context:
        master = "spark://host:7077"
        _jvm, _jsc = spark.sparkContext._jvm, spark.sparkContext._jsc

        def getCheckpointDir(self):
            return None

    class Other:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session._shared_root(Other())


def test_opened_dumps_are_whole_and_sorted(spark, tmp_path):
    states = spark.createDataFrame([(100001, "b"), (2, "a")], "run_id long, user_query string")
    sinks.write_dumps(states, str(tmp_path / "dumps"))
    rows = sinks.open_dumps(spark, str(tmp_path / "dumps")).collect()
    assert [(r["run_id"], r["value"]) for r in rows] == [(2, '{"user_query":"a"}'), (100001, '{"user_query":"b"}')]
    spark.createDataFrame([(1, "x", 5), (2, "y", 6)], "event_id int, event_type string, user_id long").write.parquet(str(tmp_path / "events.parquet"))
    assert history_list(spark, str(tmp_path)).filter("value IS NULL").count() == 0
