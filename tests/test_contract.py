"""Spark against DuckDB on the test tables, and the shape of the plans."""

import os

import pytest

import __spark_entry__ as contract
import check
from agora.operators import joins, pinning
from agora.plans import feeds, search, threads
from agora.sources import driverdata
from contract.oracle import ORACLE
from contract.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")

# Of every family one; ``check.py`` compares all of them.
SAMPLE = [
    "search_terms_batch", "home_feed_all", "profile_posts_all", "comment_threads_all",
    "audit_documents", "audit_self_edges", "apply_reposts", "delete_users",
]


@pytest.fixture(scope="module")
def duck():
    return check.duck(SF)


@pytest.mark.parametrize("name", SAMPLE)
def test_equals_sql(spark, duck, name):
    assert check.compare(spark, duck, name, SF) is None


@pytest.mark.parametrize("name", ["home_feed", "comment_thread", "profile_comments_all", "search_comments"])
def test_equals_sql_when_nothing_is_small(spark, duck, name, monkeypatch):
    """The paths big data takes: no broadcasts, hot keys salted, texts moved once."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    monkeypatch.setattr(joins, "HOT_ROWS", 5)
    for module in (pinning, feeds, search):
        monkeypatch.setattr(module, "BROADCAST_ROWS", 0)
    try:
        assert check.compare(spark, duck, name, SF) is None
    finally:
        spark.conf.set(key, before)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE)


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    tables = driverdata.load(spark, SF)
    plans = {
        "popular": plan_of(feeds.popular_feed(tables, 1)),
        "search": plan_of(search.search_posts(tables, "urgent", 1)),
        "terms": plan_of(search.search_terms(tables, ["urgent", "low"], 1)),
        "thread": plan_of(threads.post_thread(tables, 21, 1)),
        "home": plan_of(feeds.home_feed(tables, 1)),
    }
    for name, plan in plans.items():
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, name
    assert "TakeOrderedAndProject" in plans["search"]
    assert "WindowGroupLimit" in plans["terms"]
    assert "PushedFilters: [IsNotNull(type), EqualTo(type,PostLike)" in plan_of(
        tables.likes.filter("type = 'PostLike'")
    )
    scan = next(line for line in plans["search"].splitlines() if "type#" in line and "FileScan" in line)
    assert "created_at" not in scan.split("ReadSchema")[1]


def test_entry(spark):
    assert contract.entry(spark).columns[0] == "id"
