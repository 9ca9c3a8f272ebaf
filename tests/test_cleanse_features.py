import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from leadspark.operators import cleanse, features, profile
from leadspark.operators.ordering import with_global_index, with_running_sum


def test_keep_positive_edges(spark):
    schema = "MDM_CUST_KEY string, SALES double"
    rows = [("a", None), ("b", float("nan")), ("c", -1.0), ("d", 0.0), ("e", 2.0), (None, 5.0), ("", 3.0)]
    out = cleanse.keep_positive(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.MDM_CUST_KEY, r.SALES) for r in out) == [("", 3.0), ("e", 2.0)]


def test_clip_runs_at_fine_grain(spark):
    # one customer, one category, two fine groups +100 and -40 -> 100, not 60
    df = spark.createDataFrame([("k", "X", "X", 100.0), ("k", "X", "X", -40.0)],
                               "MDM_CUST_KEY string, L1_DESC string, L2_DESC string, SALES double")
    pos = features.add_category(cleanse.keep_positive(df))
    wide = features.pivot_sum(pos, "MDM_CUST_KEY", "L1_L2_DESC", "SALES", ["X X"]).collect()
    assert wide[0]["X X"] == 100.0


def test_pivot_declared_values(spark):
    df = spark.createDataFrame([("k", "A", 1.0), ("k", None, 5.0), ("j", "B", 2.0)],
                               "k string, c string, v double")
    wide = features.pivot_sum(df, "k", "c", "v", ["A", "B", "MISSING"])
    assert wide.columns == ["k", "A", "B", "MISSING"]
    got = {r.k: (r.A, r.B, r.MISSING) for r in wide.collect()}
    assert got == {"k": (1.0, None, None), "j": (None, 2.0, None)}
    filled = {r.k: r.MISSING for r in wide.fillna(0).collect()}
    assert filled == {"k": 0.0, "j": 0.0}
    with pytest.raises(ValueError):
        features.pivot_sum(df, "k", "c", "v", ["A", "A"])


def test_floor_cap_label(spark):
    vals = [49999.0, 50000.0, 60000.0, 70000.0, 80000.0, 1e7, None]
    df = spark.createDataFrame([(str(i), v) for i, v in enumerate(vals)], "k string, t double")
    fl = features.floor_to_zero(df, "t", 50000)
    capped = features.iqr_cap(fl, "t", where=F.col("t") >= 50000, k=1.5)
    lab = features.label(capped.fillna(0), "t", 50000)
    got = {r.k: (r.t, r.label) for r in lab.collect()}
    # whisker from [50000, 60000, 70000, 80000, 1e7]: q1 60000, q3 80000, upper 110000
    assert got["0"] == (0.0, 0)
    assert got["1"] == (50000.0, 1)
    assert got["5"] == (0.0, 0)          # outlier capped to 0 and labelled 0
    assert got["6"] == (0.0, 0)          # null -> 0 after fill
    s = pd.Series([50000.0, 60000.0, 70000.0, 80000.0, 1e7])
    up = features.iqr_upper(fl, "t", F.col("t") >= 50000).collect()[0]
    assert up.q1 == s.quantile(0.25) and up.q3 == s.quantile(0.75)
    assert up.upper == s.quantile(0.75) + 1.5 * (s.quantile(0.75) - s.quantile(0.25))


def test_cap_noop_without_rows_above_threshold(spark):
    df = spark.createDataFrame([("a", 10.0), ("b", 20.0)], "k string, t double")
    out = features.iqr_cap(features.floor_to_zero(df, "t", 50000), "t", where=F.col("t") >= 50000)
    assert sorted(r.t for r in out.collect()) == [0.0, 0.0]


def test_drop_outliers_option(spark):
    df = spark.createDataFrame([(str(i), float(v)) for i, v in enumerate([50000, 60000, 70000, 80000, 1e7])],
                               "k string, t double")
    out = features.iqr_cap(df, "t", where=F.col("t") >= 50000, drop_outliers=True)
    assert out.count() == 4


@pytest.mark.parametrize("n", [1, 2, 5, 17, 100])
def test_quantiles_equal_pandas(spark, n):
    import random
    rnd = random.Random(n)
    vals = [rnd.choice([1.0, 2.0, 2.5, 10.0, rnd.random() * 100]) for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in vals], "v double").repartition(3)
    q = profile.quantiles(df, "v", (0.1, 0.25, 0.5, 0.75, 0.9), ["a", "b", "c", "d", "e"]).collect()[0]
    s = pd.Series(vals)
    for name, p in zip("abcde", (0.1, 0.25, 0.5, 0.75, 0.9)):
        assert math.isclose(q[name], s.quantile(p), rel_tol=1e-12, abs_tol=1e-12)


def test_quantiles_empty(spark):
    df = spark.createDataFrame([], "v double")
    q = profile.quantiles(df, "v", (0.25,), ["a"]).collect()
    assert q == [] or q[0].a is None


def test_global_index_and_running_sum(spark):
    df = spark.createDataFrame([(i, float(i % 7)) for i in range(200)], "k long, v double").repartition(5)
    idx = with_global_index(df, [F.col("v"), F.col("k")], "i").collect()
    order = sorted(range(200), key=lambda k: (k % 7, k))
    assert {r.k: r.i for r in idx} == {k: pos for pos, k in enumerate(order)}
    rs = with_running_sum(df, [F.col("k")], "v", "c").collect()
    acc, exp = 0.0, {}
    for k in range(200):
        acc += k % 7
        exp[k] = acc
    assert {r.k: r.c for r in rs} == exp


def test_first_by_and_strict_drop(spark):
    df = spark.createDataFrame([("a", 2, "second"), ("a", 1, "first"), (None, 5, "n1"), (None, 4, "n0")],
                               "k string, o int, v string")
    got = {r.k: r.v for r in cleanse.first_by(df, "k", "o").collect()}
    assert got == {"a": "first", None: "n0"}
    with pytest.raises(KeyError):
        cleanse.drop_strict(df, ["nope"])


def test_clean_names_collision(spark):
    df = spark.createDataFrame([(1, 2)], "`A B` int, `C,D` int")
    assert cleanse.clean_names(df).columns == ["A_B", "C_D"]
    df2 = spark.createDataFrame([(1, 2)], "`A B` int, A_B int")
    with pytest.raises(ValueError):
        cleanse.clean_names(df2)


def test_log_columns(spark):
    df = spark.createDataFrame([(math.e,), (0.0,), (-1.0,)], "x double")
    out = [r.x for r in features.log_columns(df, ["x"], cast="double").collect()]
    assert out[0] == pytest.approx(1.0) and out[1] is None and out[2] is None


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10]], "x double")
    h = {r.bin: r.n for r in profile.histogram(df, "x", 5).collect()}
    assert sum(h.values()) == 11 and h[4] == 3          # last bin closed
    same = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    assert [(r.bin, r.n) for r in profile.histogram(same, "x", 20).collect()] == [(0, 2)]


def test_feature_table_sentinel_and_labels(spark):
    from decimal import Decimal
    rows = [("Master-Unmatched", "T", "T", Decimal("90000")), ("a", "T", "T", Decimal("60000")),
            ("a", "X", "X", Decimal("5")), ("b", "T", "T", Decimal("40000")), ("c", "X", "X", Decimal("-3")),
            ("d", "T", "T", Decimal("70000")), (None, "T", "T", Decimal("80000"))]
    df = spark.createDataFrame(rows, "MDM_CUST_KEY string, L1_DESC string, L2_DESC string, SALES decimal(38,4)")
    ft = features.feature_table(df, key="MDM_CUST_KEY", pivot_values=["T T", "X X"], target="T T",
                                threshold=50000, sentinel="Master-Unmatched")
    got = {r.MDM_CUST_KEY: (r["X X"], r.TARGET_SALES, r.label) for r in ft.collect()}
    assert got == {"a": (5.0, 60000.0, 1), "b": (0.0, 0.0, 0), "d": (0.0, 70000.0, 1)}


def test_attach_row_requires_one_row(spark):
    from leadspark.operators.attach import attach_row
    df = spark.range(5)
    one = df.agg(F.max("id").alias("m"))
    assert [r.m for r in attach_row(df, one).collect()] == [4] * 5
    with pytest.raises(ValueError):
        attach_row(df, df.groupBy("id").count())


def test_feature_list_rejects_duplicates():
    from leadspark.operators import ml
    names = ["A A", "B B", "C C", "B B"]
    with pytest.raises(ValueError):
        features.check_feature_list(names)
    with pytest.raises(ValueError):
        ml.assembler(names)
    assert features.check_feature_list(["A A", "B B"]) == ["A A", "B B"]
