"""What queries leave on disk on their way: compressed files, and no shuffles of jobs that have ended."""

import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from starcard.operators.cards import CARD_SCHEMA
from starcard.plans import catalog_queries, io_queries
from starcard.session import Scratch, stored
from starcard.sources import exports as E
from starcard.sources import files, sinks

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@pytest.fixture(scope="module")
def star(spark, tmp_path_factory):
    """Some customers, one of them twice, and the lookups they point at."""
    root = str(tmp_path_factory.mktemp("star"))
    rows = {
        "region": ([(0, "AFRICA")], "r_regionkey int, r_name string"),
        "nation": ([(0, "ALGERIA", 0), (1, "KENYA", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "supplier": ([(1, "S1", 0)], "s_suppkey long, s_name string, s_nationkey int"),
        "customer": ([(i, f"C{i}", i % 2) for i in [*range(40), 7]], "c_custkey long, c_name string, c_nationkey int"),
    }
    for name, (held, kind) in rows.items():
        spark.createDataFrame(held, kind).write.parquet(f"{root}/{name}.parquet")
    return root


def data_files(path: str) -> list[Path]:
    return [p for p in Path(path.removeprefix("file:")).rglob("part-*") if p.is_file()]


def test_stored_cards_are_compressed(spark, tmp_path):
    card = (("S.T", "S", "T", "words " * 200, [], ["ID"], 5), [("ID", "INT", None, False, None, None)], None, None)
    cards = spark.createDataFrame([card], CARD_SCHEMA)
    path = str(tmp_path / "cards")
    sinks.write_cards(cards, path)
    assert data_files(path) and all(p.name.endswith(".json.gz") for p in data_files(path))
    assert files.read_cards(spark, path).collect() == cards.collect()


def test_exports_are_compressed_and_rows_travel_once(spark, star):
    path = io_queries._write_exports(spark, star)
    assert data_files(path) and all(p.name.endswith(".txt.gz") for p in data_files(path))
    exports = E.Exports(spark, path, "*.txt.gz")
    for source, key in (("tables", "triggers"), ("columns", "column_comments"), ("constraints", "indexes"), ("constraint_columns", "index_columns")):
        one, other = (exports.array(a).filter("schema = 'T8'").select("pos", "table_name").orderBy("pos").collect() for a in (source, key))
        assert one == other and len(one) > 0
    first = exports.array("triggers").filter("schema = 'T8' AND pos = 3").first()
    assert (first["owner"], first["trigger_name"], first["when_clause"]) == ("T8", "TRG_SUPPLIER", 'NEW.N > 3\n„ß"“')
    assert exports.array("triggers").filter("schema = 'T7'").isEmpty() and exports.array("tables").filter("schema = 'T7'").count() == 50


def test_cards_are_assembled_from_columnar_files(spark, star):
    with Scratch(spark) as scratch:
        cards = catalog_queries.nested_cards(spark, star)
        labels = {p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in scratch.paths}
        assert {"keyed-columns", "assembled"} <= labels
        assert cards.filter("table_metadata.schema_name = 'T8'").count() > 0


def test_shuffles_of_what_is_stored_go(spark):
    jvm = spark.sparkContext._jvm
    roots = [Path(str(d)) for d in jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]

    def shuffles() -> set[str]:
        return {p.name for r in roots for p in r.rglob("shuffle_*")}

    before, own = shuffles(), spark.conf.get(SHUFFLE_CLEANUP, None)
    kept = stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    for _ in range(100):
        left = shuffles() - before
        if not left:
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(SHUFFLE_CLEANUP, None) == own
    assert kept.count() == 7
