"""Registered queries against their check SQL on the smallest driver tables, and the plans of the central operators."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from dealweave.catalog import CHECKS, QUERIES
from dealweave.catalog.base import BASE_TABLES
from tools.check_queries import rows_of

FOLDER = "/root/testdata/sf0.001"
SAMPLE = (
    "pages_scan", "mirror_upsert", "snapshot_diff", "raw_data", "in_flag_nullable", "regex_join", "nearest_date_match",
    "alias_cascade", "company_rounds", "snapshot_roles", "startup_universe", "keyword_search", "vector_top_k", "pivot_search",
    "hybrid_search", "grounding_check", "answer_cache", "usage_quota", "weekly_learning", "stream_daily_kpis",
)

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="driver tables not present")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in BASE_TABLES:
        connection.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_check_sql(spark, duck, name):
    df = contract.queries()[name](spark, FOLDER)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = duck.execute(contract.oracle_sql()[name])
    assert got == rows_of([d[0] for d in cursor.description], cursor.fetchall())


def test_entry_and_registry(spark):
    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(QUERIES) <= set(contract.queries()) and set(CHECKS) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name, wanted, unwanted", [
    ("top_k", "TakeOrderedAndProject", "Exchange rangepartitioning"), ("first_per_group", "WindowGroupLimit", "CartesianProduct"),
    ("left_enrich", "BroadcastHashJoin", "CartesianProduct"), ("inequality_self_join", "Aggregate", "NestedLoop"),
    ("keyword_search", "WindowGroupLimit", "CartesianProduct"), ("bounded_result", "TakeOrderedAndProject", "CartesianProduct")])
def test_plans(spark, name, wanted, unwanted):
    plan = contract.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert wanted in plan and unwanted not in plan


def test_deal_documents_read_written_deals(spark):
    """Deals, careers and universe are written before: the documents are not built from line items again."""
    plan = QUERIES["doc_deal"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan
