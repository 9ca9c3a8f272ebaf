"""Full outer merge with hot keys, null groups and one-sided rows."""
import random

import pandas as pd
import pytest

from leadspark.operators import enrich
from leadspark.operators.outer import full_merge, hot_keys


def _sides(spark, seed, n, hot_left, hot_right, nulls):
    r = random.Random(seed)

    def side(hot):
        rows = [(f"k{r.randrange(n)}", r.randrange(100)) for _ in range(n)]
        rows += [("hot", i) for i in range(hot)] + [(None, -i) for i in range(nulls)]
        r.shuffle(rows)
        return spark.createDataFrame(rows, "k string, v int")
    return side(hot_left), side(hot_right).selectExpr("k", "v", "v * 2 as w")


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("hot_left,hot_right,nulls", [(60, 1, 0), (2, 60, 40), (60, 0, 40), (0, 60, 3), (12, 11, 30), (0, 0, 0)])
@pytest.mark.parametrize("null_safe", [False, True])
def test_equal_to_a_full_join(spark, hot_left, hot_right, nulls, null_safe):
    left, right = _sides(spark, 1, 60, hot_left, hot_right, nulls)
    plain = enrich.merge(left, right, "k", "k", "full", null_safe=null_safe)
    got = full_merge(left, right, "k", null_safe=null_safe, hot=12, write=False)
    assert got.columns == plain.columns == ["k", "v_x", "v_y", "w"]
    assert _rows(got) == _rows(plain)
    if null_safe:  # as pandas merges
        a, b = left.toPandas(), right.toPandas()
        exp = a.merge(b, on="k", how="outer")
        assert len(exp) == got.count()
        assert exp.v_x.sum() == sum(r.v_x or 0 for r in got.collect())


def test_a_third_of_all_rows_is_divided(spark):
    left = spark.range(3000).selectExpr("if(id % 3 = 0, 'hot', concat('k', id)) as k", "id as v")
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), ("none", 4)], "k string, w int")
    keys = {r._key: (r._left, r._right, r._parts) for r in hot_keys(left, right, "k", 30).collect()}
    assert keys == {"hot": (1000, 2, 10)}
    out = full_merge(left, right, "k", hot=30)
    assert out.count() == 2000 + 2000 + 1
    assert {(r.k, r.v, r.w) for r in out.where("k in ('k1', 'none')").collect()} == {("k1", 1, 3), ("none", None, 4)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and plan.count("FullOuter") == 1


def test_empty_sides(spark):
    left, right = _sides(spark, 2, 10, 0, 0, 1)
    none = left.where("false")
    assert full_merge(none, right, "k").count() == 11 and full_merge(left, right.where("false"), "k").count() == 11
    assert full_merge(none, right.where("false"), "k").columns == ["k", "v_x", "v_y", "w"]
