"""Selection by counting against sorting."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadspark.operators import profile, sampling
from leadspark.operators.selection import select_ranks


def _plans(fn, spark):
    """The text of every plan that is written or returned."""
    from unittest import mock
    from leadspark.operators import selection
    seen, real = [], selection.freeze

    def kept(df, name="frozen"):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, name)
    with mock.patch.object(selection, "freeze", kept):
        out = fn()
    return out, "\n".join([*seen, out._jdf.queryExecution().executedPlan().toString()])


def test_ranks_equal_sorting(spark):
    r = random.Random(1)
    data = {"a": [r.getrandbits(64) - (1 << 63) for _ in range(300)], "b": [7] * 50 + [8] * 3, None: [-5, -5, 0],
            "c": [(1 << 63) - 1, -(1 << 63), 0, 65535, 65536, -1, -65536, -65537]}
    df = spark.createDataFrame([(g, v) for g, vs in data.items() for v in vs], "_g string, _value long")
    wanted = lambda sizes: sizes.select("_g", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("_size"))).alias("_slot", "_rank"))
    got = {(x._g, x._slot): (x._value, x._rank, x._size) for x in select_ranks(df, wanted).collect()}
    exp = {}
    for g, vs in data.items():
        vs = sorted(vs)
        exp |= {(g, i): (v, i - vs.index(v), len(vs)) for i, v in enumerate(vs)}
    assert got == exp
    with pytest.raises(ValueError):
        select_ranks(df, wanted, bits=20)


def test_quantiles_equal_numpy_without_a_sort(spark):
    r = random.Random(2)
    xs = [r.choice([0.0, -1.5, 2.5]) for _ in range(300)] + [r.gauss(0, 1e5) for _ in range(501)]
    df = spark.createDataFrame([(x,) for x in xs] + [(None,), (float("nan"),)], "x double")
    probs = (0.0, 0.25, 0.5, 0.9, 1.0)
    out, plan = _plans(lambda: profile.quantiles(df, "x", probs), spark)
    assert list(out.first()) == pytest.approx([float(np.quantile(xs, p)) for p in probs], rel=1e-15)
    assert "rangepartitioning" not in plan
    assert list(profile.quantiles(df.where("false"), "x").first()) == [None, None]


def test_box_stats_without_a_sort(spark):
    df = spark.range(200).selectExpr("cast(id * id as double) as a", "if(id % 7 = 0, null, -id / 3) as b", "cast(null as double) as c")
    out, plan = _plans(lambda: profile.box_stats(df, ["a", "b", "c"]), spark)
    got = {x.feature: x for x in out.collect()}
    assert set(got) == {"a", "b"} and "rangepartitioning" not in plan
    a = np.arange(200.0) ** 2
    assert (got["a"].q1, got["a"].median, got["a"].q3) == tuple(np.quantile(a, [0.25, 0.5, 0.75]))


def test_oversampling_sorts_and_writes_no_rows(spark):
    df = spark.range(97).selectExpr("concat('k', id) as MDM_CUST_KEY", "case when id % 10 = 0 then 1 when id = 5 then null else 0 end as label",
                                    "repeat('wide', 10) as wide")
    out, plan = _plans(lambda: sampling.oversample(df), spark)
    n = {r.label: r["count"] for r in out.groupBy("label").count().collect()}
    assert n == {0: 86, 1: 86, None: 86}
    per = {(r.label, r.MDM_CUST_KEY): r["count"] for r in out.groupBy("label", "MDM_CUST_KEY").count().collect()}
    assert {v for (y, _), v in per.items() if y == 1} == {8, 9} and len(per) == 97
    assert out.where("COPY = 0").count() == 97
    assert "rangepartitioning" not in plan
    for written in plan.split("\n"):
        assert not ("wide" in written and "Sort " in written)


def test_oversampling_ties_of_one_hash(spark, monkeypatch):
    monkeypatch.setattr(sampling, "md5_int", lambda *c: F.lit(77).cast("long"))
    df = spark.range(23).selectExpr("concat('k', lpad(id, 2, '0')) as MDM_CUST_KEY", "cast(id < 16 as int) as label")
    per = {(r.label, r.MDM_CUST_KEY): r["count"] for r in sampling.oversample(df).groupBy("label", "MDM_CUST_KEY").count().collect()}
    assert sorted(k for (y, k), v in per.items() if y == 0 and v == 3) == ["k16", "k17"]  # 16 = 7 * 2 + 2
    assert {v for (y, _), v in per.items() if y == 1} == {1}
