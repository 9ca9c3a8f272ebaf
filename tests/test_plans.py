"""Plan checks on the driver tables: pushdown, pruning, no Python, no cartesian."""

import pytest

from leadspark.plans import derived, flows
from leadspark.plans.catalog import queries

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _formatted(df) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_sales_filters_reach_scans(spark):
    text = _formatted(flows.unified_sales(spark, SF))
    assert "In(p_brand" in text and "In(p_type" in text
    assert "GreaterThanOrEqual(o_orderdate" in text and "LessThan(o_orderdate" in text
    assert "In(event_type" in text
    # pruned read schema: lineitem read without unused columns
    assert "l_tax" not in text and "l_shipdate" not in text


@pytest.mark.parametrize("name", ["sales_match", "category_pivot", "near_pairs", "star_prospect", "leads_master", "oversample"])
def test_no_python_or_cartesian(spark, name):
    df = queries()[name](spark, SF)
    p = _plan(df)
    for bad in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct"):
        assert bad not in p
    if name != "oversample":  # attaches one global row; all other joins are equi-joins
        assert "BroadcastNestedLoopJoin" not in p


def test_six_lookups_join_where_they_lie(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        p = _plan(flows.star_customer(spark, SF, "left"))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert "Exchange" not in p and p.count("SortMergeJoin") == 3, p


@pytest.mark.parametrize("build,table", [(derived.order_lookups, "orders"), (derived.event_lookups, "events")])
def test_lookups_of_a_table_come_from_one_scan(spark, build, table):
    p = _plan(build(spark, SF))
    assert p.count("FileScan parquet") == 1 and "Join" not in p and "Sort" not in p and f"{table}.parquet" in p


def test_implant_records_repeat_keys(spark):
    for df, key in ((derived.implants_a(spark, SF), "IMPL_KEY"), (derived.implants_b(spark, SF), "IDB_KEY")):
        assert df.groupBy(key).count().where("count > 1").count() > 5


def test_user_lists_have_rows_on_one_side(spark):
    u = flows.implant_users(spark, "/root/testdata/sf0.01")
    assert u.where("IMPLANT_QTY is null").count() > 5 and u.where("IMPLANT_USD is null").count() > 5
