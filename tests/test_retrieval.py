"""The retrieval chain on a small catalog, one rule a question; labels of several words."""

import pytest
from pyspark.sql import functions as F

from starcard.operators import expand as X
from starcard.operators import fielded as S
from starcard.operators import retrieval as V
from starcard.operators import vectors as N
from starcard.session import scratch_path

CARDS = [  # doc, schema, table, description, columns, vector
    (0, "A", "ORDERS", "orders of customers", ["ID", "KIND_ID"], [1.0, 0.0]), (1, "A", "CUSTOMER", "who orders", ["ID"], [0.9, 0.1]),
    (2, "A", "GONE", "orders that are gone", ["ID"], [1.0, 0.05]), (3, "A", "NOTE", "remarks", ["ID"], [0.0, 1.0]),
    (4, "B", "ORDERS", "orders elsewhere", ["ID"], [1.0, 0.0]), (5, "REF", "KIND", "kinds", ["KIND_ID"], [0.2, 0.9]),
]
EDGES = [("A.ORDERS", "REF.KIND"), ("A.ORDERS", "A.NOTE"), ("A.ORDERS", "A.LOST"), ("A.ORDERS", "B.ORDERS"), ("A.CUSTOMER", "REF.KIND")]
ASKED = [  # question, text, schemas, vector
    (1, "orders of customers", ["A", "REF"], [1.0, 0.0]), (2, "orders", ["A"], None), (3, "unheard", ["A", "REF"], None), (4, None, ["A"], [1.0, 0.0]),
    (5, "unheard", None, None), (6, "orders", None, None), (7, "unheard", [], None), (8, "KIND_ID", ["A"], None), (9, "", ["A"], None),
]


@pytest.fixture(scope="module")
def catalog(spark):
    rows = [(i, s, t, f"{s}.{t}", d, c, " ".join([t, d]), v) for i, s, t, d, c, v in CARDS]
    df = spark.createDataFrame(rows, "doc_id bigint, schema_name string, table_name string, name string, description string, column_names array<string>, searchable_content string, vector array<double>")
    empty = F.lit("")
    df = df.withColumn("qualified_name", F.col("name")).withColumn("normalized_column_names", empty).withColumn("column_descriptions", empty)
    index = S.add_documents(S.create_index(spark, scratch_path(spark, "i"), V.CARD_FIELDS), df, "schema_name")
    vectors = df.select("doc_id", "vector", F.col("schema_name").alias("schema"))
    cards = df.filter("table_name <> 'GONE'").select("name", F.col("schema_name").alias("schema"))
    return index, vectors, df, cards, spark.createDataFrame(EDGES, "src string, dst string")


def retrieved(spark, catalog, **settings):
    asked = spark.createDataFrame(ASKED, "query_id bigint, text string, schemas array<string>, vector array<double>")
    rows = V.retrieve_cards(*catalog, asked, V.Settings(lookup_schema="REF", **settings)).orderBy("query_id", "pos").collect()
    out = {}
    for r in rows:
        out.setdefault(r["query_id"], []).append((r["name"], r["kind"]))
    return out


def test_every_rule(spark, catalog):
    got = retrieved(spark, catalog, top_k=4, core_count=2, max_total=4)
    # the hit without a card is left out before the core is cut; lookups come first; a neighbour without a card takes a place
    assert got[1] == [("A.ORDERS", "core"), ("A.CUSTOMER", "core"), ("REF.KIND", "lookup")]
    assert [n for n, k in got[2] if k == "core"] == ["A.ORDERS", "A.CUSTOMER"]
    assert all(n.startswith("A.") for n, _ in got[2])  # neighbours of other schemas have no card for this question
    assert got[3] == [(n, "all") for n in ("A.CUSTOMER", "A.NOTE", "A.ORDERS", "REF.KIND")]
    assert got[5] == [("*", "all")]
    assert {n for n, k in got[6] if k == "core"} == {"A.ORDERS", "B.ORDERS"}
    assert got[8][0] == ("A.ORDERS", "core")  # by the whole name of a column
    assert not {4, 7, 9} & set(got)


def test_without_expansion_and_vectors(spark, catalog):
    got = retrieved(spark, catalog, top_k=3, core_count=3, expansion=False, hybrid=False)
    assert {k for rows in got.values() for _, k in rows} == {"core", "all"}
    assert all(len(rows) <= 3 for q, rows in got.items() if q != 3)


def test_neighbours_within_schemas(spark, catalog):
    _, vectors, *_ = catalog
    asked = spark.createDataFrame([(1, [1.0, 0.0], ["A", "B", "A"]), (2, [1.0, 0.0], None), (3, None, ["A"]), (4, [0.0, 1.0], ["X"])], "query_id bigint, vector array<double>, schemas array<string>")
    got = {}
    for r in N.knn_within(asked, vectors, 3).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["doc_id"])
    assert got == {1: [0, 4, 2], 2: [0, 4, 2]}


def test_longest_labels_win(spark):
    values = [("COLOUR", "1", "red"), ("THING", "2", "Red  Widget"), ("OFFER", "3", "red widget-set"), ("PLACE", "4", "set of two"), ("EMPTY", "5", " - "), ("NONE", "6", None)]
    values = spark.createDataFrame(values, "ref_table string, map_key string, map_value string")
    asked = [(1, "a red widget set of two"), (2, "red, red widget!"), (3, "widget"), (4, None), (5, "RED")]
    got = {tuple(r) for r in X.value_mentions(spark.createDataFrame(asked, "query_id bigint, text string"), values).collect()}
    assert got == {(1, "red widget set", 1, 4), (1, "set of two", 3, 6), (2, "red", 0, 1), (2, "red widget", 1, 3), (5, "red", 0, 1)}
    assert X.value_mentions(spark.createDataFrame(asked, "query_id bigint, text string"), values.limit(0)).collect() == []
