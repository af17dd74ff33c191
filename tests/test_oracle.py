"""Every registered query beside its SQL on the smallest tables, and the plans that must hold at scale."""

import pytest

import __spark_entry__ as entry
from suite.compare import check, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert entry.queries()[name](spark, SF).count() > 0
    else:
        assert check(spark, con, SF, entry.queries()[name], sql) is None


def test_entry(spark):
    assert entry.entry(spark).columns == ["lane", "outcome", "runs", "median_s", "cost_usd", "last"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_dedupe_combines_before_the_shuffle(spark):
    p = plan(entry.queries()["dedupe_records"](spark, SF))
    assert p.count("WindowGroupLimit") == 2 and p.index("WindowGroupLimit") < p.index("Exchange") < p.rindex("WindowGroupLimit")


def test_scan_is_pruned(spark):
    p = plan(entry.queries()["cost"](spark, SF))
    assert "PushedFilters: [IsNotNull(o_orderdate)" in p and "o_orderpriority" not in p.split("ReadSchema")[1]


@pytest.mark.parametrize("name", ["dedupe_records", "cost", "items", "canary_scan", "outcome_matrix", "started_pairs", "unknown_names", "cardinality_limits", "otlp_spans"])
def test_no_cross_join_and_no_python(spark, name):
    p = plan(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p and "Python" not in p
