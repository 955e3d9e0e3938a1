"""Catalog operators on small dictionaries."""

import json

import pytest
from pyspark.sql import functions as F

from starcard.operators import cards as C
from starcard.operators import catalog as K
from starcard.operators import value_maps as V

COLS = (
    "owner string, seq int, table_name string, column_name string, column_id int, data_type string, "
    "data_length int, data_precision int, data_scale int, char_length int, nullable string, comments string"
)


def columns(spark, rows):
    data = [(o, i, t, c, cid, "NUMBER", 22, 5, 0, 0, "Y", note) for i, (o, t, c, cid, note) in enumerate(rows)]
    return spark.createDataFrame(data, COLS)


def constraints(spark, rows):
    data = [(o, i, *r) for i, (o, *r) in enumerate(rows)]
    return spark.createDataFrame(
        data, "owner string, seq int, constraint_name string, constraint_type string, table_name string, "
        "r_owner string, r_constraint_name string")


def constraint_columns(spark, rows):
    data = [(o, i, *r) for i, (o, *r) in enumerate(rows)]
    return spark.createDataFrame(
        data, "owner string, seq int, constraint_name string, table_name string, column_name string, position int")


@pytest.fixture(scope="module")
def dictionary(spark):
    cols = columns(spark, [
        ("A", "FACT", "ID", 1, "key"), ("A", "FACT", "X", 3, ""), ("A", "FACT", "Y", 2, None),
        ("A", "FACT", "Z", None, None), ("A", "VIEWED", "C", 1, None), ("A", "TMP_T", "C", 1, None),
        ("L", "KIND", "KIND_NAME", 1, None), ("L", "KIND", "KIND_ID", 2, None), ("L", "KIND", "OTHER", 3, None),
    ])
    cons = constraints(spark, [
        ("A", "PK_FACT", "P", "FACT", None, None), ("A", "FK_1", "R", "FACT", "L", "PK_KIND"),
        ("A", "FK_2", "R", "FACT", "L", "UK_KIND"), ("A", "FK_3", "R", "FACT", "L", "PK_KIND"),
        ("L", "PK_KIND", "P", "KIND", None, None), ("L", "UK_KIND", "U", "KIND", None, None),
    ])
    held = constraint_columns(spark, [
        ("A", "PK_FACT", "FACT", "X", 2), ("A", "PK_FACT", "FACT", "ID", 1), ("A", "FK_1", "FACT", "X", 1),
        ("A", "FK_2", "FACT", "X", 1), ("A", "FK_3", "FACT", "Y", 1), ("L", "PK_KIND", "KIND", "KIND_ID", 1),
        ("L", "UK_KIND", "KIND", "OTHER", 1),
    ])
    tables = spark.createDataFrame(
        [("A", 0, "FACT", 7, "facts"), ("A", 1, "FACT", 9, "later"), ("L", 2, "KIND", 3, None)],
        "owner string, seq int, table_name string, num_rows bigint, comments string")
    return tables, cols, cons, held


def test_references_and_keys(dictionary):
    _, _, cons, held = dictionary
    keyed = K.keyed_columns(cons, held)
    fk = {r["column_name"]: r["fk"] for r in K.foreign_key_map(K.resolve_foreign_keys(keyed)).collect()}
    assert fk == {"X": "L.KIND.OTHER", "Y": "L.KIND.KIND_ID"}
    keys = {(r["owner"], r["table_name"]): r["primary_key"] for r in K.primary_keys(keyed).collect()}
    assert keys == {("A", "FACT"): ["ID", "X"], ("L", "KIND"): ["KIND_ID"]}


def test_assembled_card(dictionary, spark):
    known = K.assemble(*dictionary, lookup_schema="L")
    rows = {(r["owner"], r["table_name"]): r for r in known.collect()}
    assert set(rows) == {("A", "FACT"), ("A", "VIEWED"), ("L", "KIND")}
    fact = rows[("A", "FACT")]
    assert [c["name"] for c in fact["cols"]] == ["Z", "ID", "Y", "X"]
    assert (fact["row_count"], fact["description"], fact["primary_key"]) == (7, "later", ["ID", "X"])
    assert rows[("A", "VIEWED")]["row_count"] is None and rows[("A", "VIEWED")]["primary_key"] == []
    refs = {c["name"]: c["ref"] for c in fact["cols"]}
    assert refs["ID"] is None and tuple(refs["X"]) == ("KIND", "OTHER", "KIND_NAME", 3)
    choice = K.one_map_per_lookup(K.reference_rows(known)).collect()
    assert len(choice) == 1 and choice[0]["key_column"] == "KIND_ID"

    lookup = spark.createDataFrame([(1, "a", 1, "p"), (2, "b", 2, "q")], "_seq int, KIND_NAME string, KIND_ID int, OTHER string")
    maps = V.long_maps({"KIND": lookup}, K.one_map_per_lookup(K.reference_rows(known)))
    nested = K.one_map_per_lookup(K.reference_rows(known)).join(C.nested_entries(maps), ["ref_table", "key_column"])
    card = C.nest(known, nested).filter("table_metadata.name = 'FACT'").first()
    assert card["value_maps"]["KIND"]["entries"] == {"1": "a", "2": "b"}
    assert [c["value_map_ref"] for c in card["columns"]] == [None, None, "KIND", "KIND"]
    every = K.assemble(*dictionary, lookup_schema="L", filter_tables=False)
    assert every.filter("table_name = 'TMP_T'").count() == 1


def test_card_renderings(dictionary):
    cards = C.nest(K.assemble(*dictionary, lookup_schema="L"))
    shown = {r["qualified_name"]: (r["keys"], r["shown"]) for r in C.summary(cards).collect()}
    assert shown["A.VIEWED"] == ("—", "C (NUMBER(5,0))")
    assert shown["A.FACT"][0] == "ID, X"
    doc = {r["qualified_name"]: r for r in C.search_documents(cards).collect()}["A.FACT"]
    assert doc["searchable_content"] == (
        "FACT later z id y x Y references L.KIND.KIND_ID X references L.KIND.OTHER ID: key")
    assert doc["column_count"] == 4 and doc["row_count"] == 7
    text = C.selector_json(cards).filter("qualified_name = 'A.FACT'").first()["card_json"]
    body = json.loads(text)
    assert set(body["table_metadata"]) == {"qualified_name", "description", "primary_key", "row_count"}
    assert "value_map_ref" not in body["columns"][0]
    mapped = C.retype(cards, "ORACLE", "sqlite").filter("table_metadata.name = 'FACT'").first()
    assert {c["type"] for c in mapped["columns"]} == {"INTEGER"}
    assert C.retype(cards, "postgresql", "sqlite") is cards and C.retype(cards, "oracle", "postgresql") is cards


@pytest.mark.parametrize(
    "table,names,expected",
    [
        ("SEX", ["ID", "SEX_CODE", "SEX_NAME"], ("SEX_CODE", "SEX_NAME")),
        ("SEX", ["SEX_ID", "ID", "NAME"], ("SEX_ID", "NAME")),
        ("T", ["CODE", "ID", "DESC", "LABEL"], ("ID", "LABEL")),
        ("T", ["A_ID", "B_CODE", "C_CODE", "X_DESC", "Y_NAME"], ("B_CODE", "Y_NAME")),
        ("T", ["FOO", "BAR"], ("FOO", "BAR")),
        ("T", ["BAR", "ID"], ("ID", "BAR")),
        ("T", ["NAME", "BAR"], ("BAR", "NAME")),
        ("T", ["FOO", "BAR", "NAME"], (None, None)),
        ("T", ["ONE"], (None, None)),
    ],
)
def test_lookup_columns(spark, table, names, expected):
    row = K.lookup_columns(columns(spark, [("L", table, n, i, None) for i, n in enumerate(names)])).first()
    assert (row["key_column"], row["value_column"]) == expected


def test_value_maps(spark):
    rows = [(1, "a", " x "), (2, "", "y"), (3, "b", "  "), (4, "a", "z"), (5, None, "q"), (6, "c", None), (7, "d", "w")]
    lookup = spark.createDataFrame(rows, "seq int, k string, v string")
    full = V.value_map(lookup, "T", "k", "v", 500, "seq").collect()
    assert {r["map_key"]: r["map_value"] for r in full} == {"a": "z", "d": "w"}
    assert {(r["n"], r["value_column"]) for r in full} == {(500, None)}
    many = spark.createDataFrame([(i, "same" if i < 5 else f"k{i}", f"v{i}") for i in range(40)], "seq int, k string, v string")
    sampled = V.value_map(many, "T", "k", "v", 501, "seq").collect()
    assert len(sampled) == 16 and {r["map_key"]: r["map_value"] for r in sampled}["same"] == "v4"
    assert {r["value_column"] for r in sampled} == {"v"}
    assert V.value_map(lookup, "T", "k", "v", None, "seq") is None
    assert [r[0] for r in V.resolve_keys(V.full_map(many, "T", "k", "v", seq="seq"), "v7").collect()] == ["k7"]


def test_all_value_maps_in_one_table(spark):
    rows = spark.createDataFrame([(i, f"k{i % 30}", f"v{i}", f"w{i}") for i in range(40)], "_seq int, k string, v string, w string")
    wanted = spark.createDataFrame(
        [("A", "k", "v", 40), ("A", "k", "w", 501), ("B", "k", "v", None), ("B", "w", "k", 3)],
        "ref_table string, key_column string, value_column string, n long")
    got = V.long_maps({"A": rows, "B": rows.limit(3)}, wanted).collect()
    of = lambda t, n: {r["map_key"]: r["map_value"] for r in got if (r["ref_table"], r["n"]) == (t, n)}
    assert of("A", 40) == {f"k{i % 30}": f"v{i}" for i in range(40)} and of("A", 501) == {f"k{i}": f"w{i}" for i in range(20)}
    assert of("B", 3) == {f"w{i}": f"k{i}" for i in range(3)} and len(got) == 53
    with pytest.raises(ValueError, match="B"):
        V.long_maps({"A": rows}, wanted)
    assert {r["ref_table"] for r in V.long_maps({"A": rows}, wanted, partial=True).collect()} == {"A"}
    many = rows.withColumn("v", F.lit("same")).withColumn("k", F.col("_seq").cast("string")).crossJoin(spark.range(20)).withColumn("k", F.concat("k", F.lit("-"), "id"))
    assert V.resolve_keys(V.full_map(many.select("k", "v", "id"), "T", "k", "v", seq="id"), "same").count() == 800


def test_fill_descriptions(spark):
    tables = spark.createDataFrame(
        [("a", "T1", None, [("c1", ""), ("c2", "kept")]), ("z", "T1", "own", [("c1", None)]), ("a", "T2", "", []),
         ("b", "T2", "own", []), ("b", "T3", None, [("c1", None)])],
        "owner string, table_name string, description string, cols array<struct<name:string,description:string>>")
    sheet = spark.createDataFrame(
        [("A", "T1", " one "), (None, "T1", "shared"), (" ", " t2", "old"), (None, "T2", "new"), (None, "T3", "nan")],
        "Owner string, Name string, Comment string").withColumn("row_no", F.monotonically_increasing_id())
    col_sheet = spark.createDataFrame(
        [("t1 ", "C1", "text"), ("T1", "C2", "unused"), ("", "C1", "x")], "Table string, Name string, Comment string",
    ).withColumn("row_no", F.monotonically_increasing_id())
    rows = K.fill_descriptions(tables, *K.description_sheets(sheet, col_sheet)).collect()
    assert {(r["owner"], r["table_name"]): (r["description"], r["filled"]) for r in rows} == {
        ("a", "T1"): ("one", True), ("z", "T1"): ("own", False), ("a", "T2"): ("new", True),
        ("b", "T2"): ("own", False), ("b", "T3"): (None, False)}
    cols = {(r["owner"], r["table_name"]): [tuple(c) for c in r["cols"]] for r in rows}
    assert cols[("a", "T1")] == [("c1", "text", True), ("c2", "kept", False)]
    assert cols[("z", "T1")] == [("c1", "text", True)] and cols[("b", "T3")] == [("c1", None, False)]


def test_growing_sides_are_not_collected_by_the_driver(spark):
    """An exploded array looks like one element to Spark's size check, so what grows is shuffled."""
    held = [{"constraint_name": c, "table_name": t, "column_name": "ID", "position": 1, "seq": i} for i, (c, t) in enumerate([("PK_A", "A"), ("FK_B", "B")])]
    kinds = [
        {"constraint_name": "PK_A", "constraint_type": "P", "table_name": "A", "seq": 0},
        {"constraint_name": "FK_B", "constraint_type": "R", "table_name": "B", "r_constraint_name": "PK_A", "seq": 1},
    ]

    def per_owner(rows, shape):
        owners = spark.range(3).select(F.concat(F.lit("T"), "id").alias("owner"))
        return owners.select("owner", F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{shape}>>")).alias("r")).select("owner", "r.*")

    constraints = per_owner(kinds, "constraint_name: string, constraint_type: string, table_name: string, r_constraint_name: string, seq: int")
    columns = per_owner(held, "constraint_name: string, table_name: string, column_name: string, position: int, seq: int")
    keyed = K.keyed_columns(constraints.withColumn("r_owner", F.col("owner")), columns)
    fks = K.resolve_foreign_keys(keyed)
    tables = constraints.select("owner", "seq", "table_name", F.lit(7).cast("bigint").alias("num_rows"), F.lit("x").alias("comments"))
    heads = K.table_heads(tables, columns)
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (keyed, fks, heads)]
    assert not any("BroadcastHashJoin" in plan for plan in plans)
    assert {(r["owner"], r["table_name"], r["referenced_table"]) for r in fks.collect()} == {(f"T{i}", "B", "A") for i in range(3)}
    assert heads.count() == 6
