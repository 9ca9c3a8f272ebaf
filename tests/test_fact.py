"""A fact in one folder a year."""
import os
import re
import uuid

from leadspark.operators import fact
from leadspark.plans import flows
from leadspark.plans import params as P
from leadspark.session import scratch_path

SF = "/root/testdata/sf0.001"


def _rows(spark, rows):
    return spark.createDataFrame(rows, "K string, YYYY int, S double").selectExpr("K", "YYYY", "cast(S as decimal(10,2)) S")


def _files(path):
    path = path.removeprefix("file:")
    return {d: sorted(os.listdir(f"{path}/{d}")) for d in sorted(os.listdir(path)) if d.startswith("YYYY=")}


def _got(spark, path, schema, years=None):
    return sorted(((r.K, r.YYYY, float(r.S)) for r in fact.read_years(spark, path, schema, years).collect()), key=repr)


def test_years_are_replaced_one_by_one(spark):
    path = scratch_path(spark, f"test_fact/{uuid.uuid4().hex}")
    first = _rows(spark, [("a", 2001, 1.0), ("b", 2001, 2.0), (None, 2002, 3.0), ("d", 2003, 4.0), ("e", None, 5.0),
                          ("f", 1999, 6.0)])
    assert fact.load_years(first, path, [2001, 2002, 2003]) == {2001: 2, 2002: 1, 2003: 1}
    assert _got(spark, path, first.schema) == [("a", 2001, 1.0), ("b", 2001, 2.0), ("d", 2003, 4.0), (None, 2002, 3.0)]
    before = _files(path)
    again = _rows(spark, [("a", 2002, 9.0), ("x", 2001, 7.0), ("a", 2002, 9.0)])  # repeated rows stay
    assert fact.load_years(again, path, [2002, 2003]) == {2002: 2, 2003: 0}
    after = _files(path)
    assert list(after) == ["YYYY=2001", "YYYY=2002"] and after["YYYY=2001"] == before["YYYY=2001"]
    assert _got(spark, path, first.schema) == [("a", 2001, 1.0), ("a", 2002, 9.0), ("a", 2002, 9.0), ("b", 2001, 2.0)]
    assert _got(spark, path, first.schema, [2002]) == [("a", 2002, 9.0)] * 2
    assert fact.load_years(again, path, []) == {} and _files(path) == after


def test_nothing_loaded_is_an_empty_fact(spark):
    path = scratch_path(spark, f"test_fact/{uuid.uuid4().hex}")
    rows = _rows(spark, [("a", 2001, 1.0)])
    assert fact.load_years(rows.where("K = 'z'"), path, [2001]) == {2001: 0}
    assert _got(spark, path, rows.schema) == []


def test_a_year_is_read_from_its_own_folder(spark):
    path = scratch_path(spark, f"test_fact/{uuid.uuid4().hex}")
    rows = _rows(spark, [("a", y, 1.0) for y in range(2001, 2009)])
    fact.load_years(rows, path, range(2001, 2009))
    one = fact.read_years(spark, path, rows.schema, [2003])
    assert len(one.inputFiles()) == 8 and one.count() == 1
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*YYYY#\d+ = 2003", plan)
    assert "Exchange" not in plan


def test_one_year_of_the_sales_loads_as_with_all_years(spark):
    path = scratch_path(spark, f"test_fact/{uuid.uuid4().hex}")
    own = flows.load_sales(spark, SF, path, [1998])
    all_ = flows.sales_fact(spark, SF)
    one = fact.read_years(spark, path, all_.schema)
    assert own[1998] == one.count() > 0
    assert one.exceptAll(all_.where("YYYY = 1998")).isEmpty() and all_.where("YYYY = 1998").exceptAll(one).isEmpty()
    assert flows.load_sales(spark, SF, path, P.DIRECT_YEARS)[P.DIRECT_YEARS[0]] > 0
