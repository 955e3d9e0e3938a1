"""Dictionary exports by hand: odd shapes, order by position, and the card that comes out."""

import json

import pytest

from starcard.operators import cards as C
from starcard.sources import exports as E
from starcard.sources import files


@pytest.fixture
def written(tmp_path):
    def write(name, schema, **arrays):
        (tmp_path / name).write_text(json.dumps({"schema": schema, "generated_at": "x", **arrays}, indent=2, ensure_ascii=False), encoding="utf-8")
        return str(tmp_path)

    return write


CASES = {
    "tables": [{"owner": "S", "table_name": "ORDERS", "num_rows": 12}, {"owner": "S", "table_name": "ORDERS", "num_rows": 99}, {"table_name": "TMP_X", "num_rows": 1}],
    "table_comments": [{"table_name": "ORDERS", "comments": "old"}, {"table_name": "ORDERS", "comments": "what was „ordered“\nby whom"}, {"table_name": "V", "comments": "a view"}],
    "columns": [
        {"table_name": "ORDERS", "column_name": "KIND_ID", "column_id": 2, "data_type": "NUMBER", "data_precision": 5, "data_scale": 0, "nullable": "Y", "virtual_column": "NO"},
        {"table_name": "ORDERS", "column_name": "ID", "column_id": 1, "data_type": "NUMBER", "data_precision": "18", "nullable": "N"},
        {"table_name": "ORDERS", "column_name": "NOTE", "column_id": None, "data_type": "VARCHAR2", "char_length": 0, "data_length": 20, "nullable": "Y"},
        {"table_name": "V", "column_name": "X", "column_id": 1, "data_type": "DATE"},
        {"table_name": "TMP_X", "column_name": "X", "column_id": 1, "data_type": "DATE"},
    ],
    "column_comments": [{"table_name": "ORDERS", "column_name": "ID", "comments": ""}, {"table_name": "ORDERS", "column_name": "KIND_ID", "comments": "kind"}],
    "constraints": [
        {"constraint_name": "U", "constraint_type": "U", "table_name": "ORDERS"}, {"constraint_name": "P1", "constraint_type": "P", "table_name": "ORDERS"},
        {"constraint_name": "P2", "constraint_type": "P", "table_name": "ORDERS"},
    ],
    "constraint_columns": [
        {"constraint_name": "P1", "table_name": "ORDERS", "column_name": "KIND_ID", "position": 2}, {"constraint_name": "P1", "table_name": "ORDERS", "column_name": "ID", "position": 1},
        {"constraint_name": "P2", "table_name": "ORDERS", "column_name": "NOTE", "position": 1},
    ],
    "foreign_keys": [
        {"table_name": "ORDERS", "column_name": "KIND_ID", "constraint_name": "Z", "r_owner": "S", "referenced_table": "OLD", "referenced_column": "ID"},
        {"table_name": "ORDERS", "column_name": "KIND_ID", "constraint_name": "A", "r_owner": "REF", "referenced_table": "KIND", "referenced_column": "KIND_ID"},
    ],
    "grants": [{"owner": "S", "table_name": "ORDERS", "grantee": "G", "privilege": "SELECT", "type": "TABLE"}],
    "triggers": None,
}
LOOKUP = {
    "tables": [{"table_name": "KIND", "num_rows": 3}],
    "columns": [{"table_name": "KIND", "column_name": "KIND_ID", "column_id": 1, "data_type": "NUMBER"}, {"table_name": "KIND", "column_name": "KIND_NAME", "column_id": 2, "data_type": "VARCHAR2", "char_length": 9}],
    "grants": [{"table_schema": "REF", "table_name": "KIND", "grantee": "G", "privilege": "SELECT", "hierarchy": "NO"}],
}


def test_exports_become_cards(spark, written):
    written("s.json", "S", **CASES)
    path = written("ref.json", "REF", **LOOKUP)
    exports = E.Exports(spark, path)
    cards = {r["table_metadata"]["qualified_name"]: r for r in C.nest(E.assemble_exports(exports, "REF")).collect()}
    assert sorted(cards) == ["REF.KIND", "S.ORDERS", "S.V"]
    meta, columns = cards["S.ORDERS"]["table_metadata"], cards["S.ORDERS"]["columns"]
    assert (meta["row_count"], meta["description"], meta["primary_key"]) == (12, "what was „ordered“\nby whom", ["ID", "KIND_ID"])
    assert [(c["name"], c["type"], c["nullable"], c["description"], c["fk"], c["value_map_ref"]) for c in columns] == [
        ("NOTE", "VARCHAR2(20)", True, None, None, None), ("ID", "NUMBER(18)", False, None, None, None),
        ("KIND_ID", "NUMBER(5,0)", True, "kind", "REF.KIND.KIND_ID", "KIND"),
    ]
    view = cards["S.V"]["table_metadata"]
    assert (view["row_count"], view["description"]) == (None, "a view")
    assert cards["REF.KIND"]["table_metadata"]["row_count"] == 3


def test_arrays_that_differ_or_are_missing(spark, written):
    written("s.json", "S", **CASES)
    exports = E.Exports(spark, written("ref.json", "REF", **LOOKUP))
    assert exports.array("triggers").count() == exports.array("synonyms").count() == 0
    assert {tuple(r) for r in exports.grants().select("schema", "owner", "kind").collect()} == {("S", "S", "TABLE"), ("REF", "REF", "NO")}
    got = {r["column_name"]: (r["pos"], r["data_precision"], r["virtual_column"]) for r in exports.array("columns").filter("table_name = 'ORDERS'").collect()}
    assert got == {"KIND_ID": (0, 5, "NO"), "ID": (1, 18, None), "NOTE": (2, None, None)}
    plan = exports.array("tables")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan


def test_faulty_exports_fail(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"tables": []}')
    with pytest.raises(Exception, match="without a schema"):
        E.Exports(spark, str(tmp_path))
    (tmp_path / "a.json").write_text("{")
    with pytest.raises(Exception, match="(?i)malformed"):
        E.Exports(spark, str(tmp_path))


def test_owners_are_dealt_by_size():
    groups = files.owner_groups([("A", 100), ("B", 40), ("C", 30), ("D", 30), ("E", 0)], 2)
    assert groups == [["A", "E"], ["B", "C", "D"]]
    assert files.owner_groups([("A", 1)], 8) == [["A"]] and files.owner_groups([], 8) == []
    assert files.owner_predicates("owner", [["A", "O'B"], ["C"]]) == ["owner IN ('A', 'O''B')", "owner IN ('C')"]


def test_many_objects_in_a_file(spark, tmp_path):
    """A separator between objects or before each; text and lines stay whole, and a file of one object reads as before."""
    told = [{"schema": f"S{i}", "table_comments": [{"table_name": "T", "comments": f"a\nb {i}"}]} for i in range(3)]
    (tmp_path / "some.json").write_text("\x1e".join(json.dumps(t, indent=2) for t in told[:2]))
    (tmp_path / "each.json").write_text("\x1e" + json.dumps(told[2], indent=2) + "\n")
    rows = E.Exports(spark, str(tmp_path)).array("table_comments").select("schema", "pos", "comments").collect()
    assert sorted(tuple(r) for r in rows) == [(f"S{i}", 0, f"a\nb {i}") for i in range(3)]
