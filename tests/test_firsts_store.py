"""Images of doubles and times, fused keep-first lookups, co-located lookups, split full merge."""
import datetime as dt
import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from leadspark.functions import images
from leadspark.operators import cleanse
from leadspark.operators.firsts import First, firsts
from leadspark.operators.store import JOIN_KEY, LookupStore
from leadspark.plans import derived


def _bits(x):
    if math.isnan(x):
        return images.NAN
    b = struct.unpack("<q", struct.pack("<d", abs(x)))[0]
    return -b if x < 0 else b


def test_double_images_are_the_bits(spark):
    r = random.Random(1)
    xs = [0.0, -0.0, 1.0, -1.0, 0.1, math.inf, -math.inf, math.nan, 5e-324, -5e-324, 2.2250738585072014e-308,
          2.225073858507201e-308, 1.7976931348623157e308]
    xs += [s * 2.0 ** e * f for e in range(-1074, 1024, 3) for s in (1, -1) for f in (1.0, 1 + 2 ** -52, 2 - 2 ** -52)
           if math.isfinite(2.0 ** e * f)]
    xs += [math.nextafter(2.0 ** e, 0) for e in range(-1022, 1024, 5)]
    xs += [struct.unpack("<d", r.randbytes(8))[0] for _ in range(2000)] + [r.uniform(-1e6, 1e6) for _ in range(500)]
    df = spark.createDataFrame([(x,) for x in xs] + [(None,)], "x double")
    got = df.select("x", images.double_image(F.col("x")).alias("i")).select(
        "x", "i", images.image_double(F.col("i")).alias("y")).collect()
    for x, i, y in got:
        if x is None:
            assert i is None and y is None
        elif math.isnan(x):
            assert i == images.NAN and math.isnan(y)
        else:
            assert i == _bits(x), (x, i, _bits(x))
            assert x == y, (x, y)


def test_time_images(spark):
    ts = [dt.datetime(1969, 12, 31, 23, 59, 59, 999999), dt.datetime(2024, 3, 31, 2, 30, 0, 1), dt.datetime(1, 1, 1)]
    df = spark.createDataFrame([(t,) for t in ts], "t timestamp_ntz")
    i = images.time_image(F.col("t"))
    for t, n, back in df.select("t", i.alias("i")).select("t", "i", images.image_time(F.col("i"))).collect():
        assert back == t and n == (t - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)


ROWS = "k string, o long, kind string, x double, t timestamp_ntz, n int"


def _rows(n, seed):
    r = random.Random(seed)
    orders = r.sample(range(-10 * n, 10 * n), n)
    return [(r.choice(["a", "b", None, "hot", "hot"]), o, r.choice(["u", "v", None]),
             r.choice([None, -0.5, 1e300, 3.25, -math.inf]), r.choice([None, dt.datetime(2020, 1, 2, 3, 4, 5, 6)]),
             r.choice([None, 1, -7])) for o in orders]


def test_firsts_equal_keep_first(spark):
    rows = _rows(400, 2)
    df = spark.createDataFrame(rows, ROWS)
    looks = [First("o", {"kind1": "kind", "x1": "x", "t1": "t", "n1": "n"}, None, {"kind1": ["u", "v"]}, "o1"),
             First("o", {"x2": "x"}, F.col("kind") == "u"), First("o", order_as="o3", where=F.col("kind") == "nowhere")]
    got = {r.k: tuple(r)[1:] for r in firsts(df, "k", looks, {"rows": F.count(F.lit(1))}).collect()}
    exp = {}
    for k in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == k), key=lambda r: r[1])
        u = [r for r in own if r[2] == "u"]
        exp[k] = (own[0][2], own[0][3], own[0][4], own[0][5], own[0][1], u[0][3] if u else None, None, len(own))
    assert got == exp
    kept = {r.k: r.x for r in cleanse.first_by(df, "k", "o", unique=True).collect()}
    assert kept == {k: v[1] for k, v in got.items()}


def test_firsts_is_one_hash_aggregation(spark):
    df = spark.createDataFrame(_rows(10, 1), ROWS)
    out = firsts(df, "k", [First("o", {"x1": "x", "n1": "n"}), First("o", {"x2": "x"}, F.col("kind") == "u")])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    for bad in ("Join", "Sort ", "SortAggregate", "Window", "ObjectHash"):
        assert bad not in plan, plan


def test_firsts_refuse_what_has_no_width(spark):
    df = spark.createDataFrame(_rows(3, 1), ROWS)
    with pytest.raises(ValueError):
        firsts(df, "k", [First("o", {"kind1": "kind"})])
    with pytest.raises(Exception, match="not a declared value"):
        firsts(spark.createDataFrame([("a", 1, "zz", 1.0, None, 1)], ROWS), "k",
               [First("o", {"kind1": "kind"}, texts={"kind1": ["u"]})]).collect()


def test_store_joins_without_exchange(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    store = LookupStore(spark, 4)
    fact = store.write("fact", spark.createDataFrame([("a", 1), ("b", 2), (None, 3), ("", 4)], "k string, x int"), "k")
    for i in range(3):
        rows = [("a", f"a{i}"), (None, f"n{i}"), ("c", f"c{i}")]
        store.write(f"d{i}", spark.createDataFrame(rows, f"k{i} string, v{i} string"), f"k{i}")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        out = fact
        for i in range(3):
            out = store.join(out, f"d{i}", cols=[f"v{i}"])
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("SortMergeJoin") == 3, plan
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    got = {r.x: (r.k, r.v0, r.v1, r.v2) for r in out.drop(JOIN_KEY).collect()}
    assert got == {1: ("a", "a0", "a1", "a2"), 2: ("b", None, None, None), 3: (None, "n0", "n1", "n2"),
                   4: ("", None, None, None)}
    assert store.join(fact, "d0", "inner").count() == 2
    with pytest.raises(ValueError):
        store.join(fact.withColumn("v0", F.lit(1)), "d0")


def test_event_lookups_total_all_events_beside_the_first(spark, tmp_path):
    rows = [(1, 7, "purchase", 2.5, 3), (2, 7, "purchase", 4.0, 2), (3, 7, "signup", 1.0, 9), (4, 7, "signup", 2.0, 1),
            (5, 8, "view", 1.0, 1), (6, None, "signup", 3.0, 4)]
    rows = [(e, u, t, v, dt.datetime(2024, 1, day)) for e, u, t, v, day in rows]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, ts timestamp_ntz") \
        .write.parquet(f"{tmp_path}/events.parquet")
    got = {r["EVENT_KEY"]: r for r in derived.event_lookups(spark, str(tmp_path)).collect()}
    totals = {k: (r["IMPL_TOTAL_PURCHASE"], r["IMPL_TOTAL_SIGNUP"], r["IDB_SIGNUPS"], r["IDB_EARLIEST_SIGNUP"]) for k, r in got.items()}
    assert totals == {"7": (650.0, 300.0, 2, "2024-01-01 00:00:00"), "8": (None, None, None, None),
                      None: (None, 300.0, 1, "2024-01-04 00:00:00")}
    first = got["7"]
    assert (first["IMPL_PURCHASE"], first["IDB_VALUE"], first["IDB_FIRST_SIGNUP"]) == (250.0, 1.0, "2024-01-09 00:00:00")


def test_star_lists_show_totals():
    from leadspark.plans import catalog
    for name in ("star_aged", "star_prospect"):
        sql = catalog.oracle_sql()[name]
        assert "sum(cast(value" in sql and "count(*) as IDB_SIGNUPS" in sql and "min(ts)" in sql
