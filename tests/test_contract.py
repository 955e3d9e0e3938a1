"""Every registered query against its SQL on the smallest tables, and what the plans look like."""

import re

import duckdb
import pytest
from conftest import SF_CHECK, SF_SMALL

import __spark_entry__ as contract
from check import rows_of
from starcard.operators import fielded
from starcard.plans import search_queries
from starcard.plans.registry import CHECKS, QUERIES
from starcard.session import scratch_path

ROWS_ONLY: set[str] = set()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in (
        "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
        "conversations"
    ).split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_SMALL}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    text = plan(df)
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in text
    got = [tuple(r) for r in df.collect()]
    assert got or name in {"value_map_sampled"}
    if name in CHECKS:
        cur = duck.execute(CHECKS[name])
        names = [c[0] for c in cur.description]
        assert sorted(names) == sorted(df.columns)
        assert rows_of(df.columns, got) == rows_of(names, cur.fetchall())


def test_registry():
    assert set(QUERIES) - set(CHECKS) == ROWS_ONLY
    assert set(QUERIES) <= set(contract.queries()) and set(CHECKS) <= set(contract.oracle_sql())


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(contract.queries()["q07_value_map_filter"](spark, SF_CHECK))
    assert "PushedFilters: [IsNotNull(c_nationkey)" in text.replace("\n", "") or "EqualTo(c_nationkey" in text
    assert "o_totalprice" not in text and "c_name" not in text


def _second_pass(spark, monkeypatch):
    """The search of bm25_topk on groups so small that a second pass opens further ones."""
    monkeypatch.setattr(fielded, "GROUP_DOCS", 20)
    index = search_queries._built(spark, SF_SMALL, scratch_path(spark, "index"))
    return fielded.search(index, search_queries._texts(spark, SF_SMALL))


def test_topk_is_cut_before_the_shuffle(spark, monkeypatch):
    assert plan(contract.queries()["q34_topk_per_group"](spark, SF_CHECK)).count("WindowGroupLimit") == 2
    text = plan(_second_pass(spark, monkeypatch))
    assert text.count("WindowGroupLimit") >= 4 and text.count("row_number()") <= text.count("WindowGroupLimit") * 2


def test_scoring_needs_no_shuffle_by_pair(spark, monkeypatch):
    text = plan(_second_pass(spark, monkeypatch))
    assert "REPARTITION_BY_COL" in text and not re.search(r"hashpartitioning\([^)]*(doc_id#\d+L, query_id|query_id#\d+L, [^)]*doc_id)", text)
