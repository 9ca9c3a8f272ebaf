"""Property tests (few examples each: every example runs Spark jobs)."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from leadspark.operators import profile, sampling

SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


@SETTINGS
@given(st.lists(st.integers(min_value=-1000, max_value=1000), min_size=1, max_size=60))
def test_quantiles_property(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(3)
    q = profile.quantiles(df, "v", (0.25, 0.5, 0.9), ["a", "b", "c"]).collect()[0]
    exp = np.quantile(np.array(values, dtype=float), [0.25, 0.5, 0.9])   # linear interpolation
    assert [q.a, q.b, q.c] == pytest.approx(list(exp), abs=1e-9)


@SETTINGS
@given(st.lists(st.integers(min_value=1, max_value=12), min_size=2, max_size=4))
def test_oversample_property(spark, sizes):
    rows, k = [], 0
    for label, n in enumerate(sizes):
        rows += [(f"k{k + i}", label) for i in range(n)]
        k += n
    df = spark.createDataFrame(rows, "MDM_CUST_KEY string, label int")
    out = sampling.oversample(df, "label", "MDM_CUST_KEY", 7, chunk=3)
    counts = {r.label: r["count"] for r in out.groupBy("label").count().collect()}
    assert counts == {i: max(sizes) for i in range(len(sizes))}
    # every original row is kept once as copy 0
    assert out.filter("COPY = 0").count() == len(rows)


@SETTINGS
@given(st.integers(min_value=1, max_value=99))
def test_hash_split_property(spark, pct):
    df = spark.range(300).selectExpr("cast(id as string) as k")
    a, b = sampling.hash_split(df, "k", [pct, 100 - pct], 3)
    ka, kb = {r.k for r in a.collect()}, {r.k for r in b.collect()}
    assert not (ka & kb) and len(ka | kb) == 300
