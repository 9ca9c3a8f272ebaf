import math
import random

from leadspark.operators import geo


def _hav(lat1, lon1, lat2, lon2, r=6371.0):
    p1, p2 = math.radians(lat1), math.radians(lat2)
    dp, dl = math.radians(lat2 - lat1), math.radians(lon2 - lon1)
    a = math.sin(dp / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(dl / 2) ** 2
    return 2 * math.atan2(math.sqrt(a), math.sqrt(1 - a)) * r * 1000


def _brute(pts, metres=5.0):
    out = set()
    for k1, a1, o1 in pts:
        for k2, a2, o2 in pts:
            if k1 != k2 and _hav(a1, o1, a2, o2) < metres:
                out.add((k1, k2))
    return out


def _fixture():
    m = 1 / 111195.0   # about one metre of latitude in degrees
    pts = [
        ("same1", 10.0, 20.0), ("same2", 10.0, 20.0),
        ("d22", 10.0 + 2.2 * m, 20.0), ("d497", 10.0 + 4.97 * m, 20.0), ("d55", 10.0 - 5.5 * m, 20.0),
        ("np1", 90.0, 0.0), ("np2", 90.0 - 3 * m, 123.0), ("sp1", -90.0, 10.0), ("sp2", -90.0 + 1 * m, -170.0),
        ("am1", 0.0, 179.99999), ("am2", 0.0, -179.99999), ("am3", 0.0, 180.0),
    ]
    rnd = random.Random(7)
    for i in range(300):
        base = rnd.choice([(45.0, 7.0), (-33.9, 151.2), (0.0, 180.0)])
        pts.append((f"r{i}", base[0] + rnd.uniform(-6, 6) * m, base[1] + rnd.uniform(-6, 6) * m))
    return pts


def test_near_pairs_equals_brute_force(spark):
    pts = _fixture()
    df = spark.createDataFrame(pts, "MDM_CUST_KEY string, LATITUDE double, LONGITUDE double")
    got = {(r.MDM_CUST_KEY_1, r.MDM_CUST_KEY_2) for r in geo.near_pairs(df).collect()}
    assert got == _brute(pts)
    assert ("same1", "same2") in got and ("same2", "same1") in got
    assert ("am1", "am2") in got and ("np1", "np2") in got


def test_near_pairs_salted_hot_cells(spark):
    pts = _fixture()
    df = spark.createDataFrame(pts, "MDM_CUST_KEY string, LATITUDE double, LONGITUDE double")
    got = {(r.MDM_CUST_KEY_1, r.MDM_CUST_KEY_2) for r in geo.near_pairs(df, block_rows=3).collect()}
    assert got == _brute(pts)


def test_sites_null_coordinates_first(spark):
    rows = [("k", None, 1.0), ("k", 5.0, 6.0), ("j", None, None)]
    df = spark.createDataFrame(rows, "MDM_CUST_KEY string, LATITUDE double, LONGITUDE double")
    got = [tuple(r) for r in geo.sites(df).collect()]
    assert got == [("k", 5.0, 6.0)]


def test_plan_has_no_cartesian_or_python(spark):
    df = spark.createDataFrame(_fixture(), "MDM_CUST_KEY string, LATITUDE double, LONGITUDE double")
    plan = geo.near_pairs(df)._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in plan
    # the only nested-loop join allowed is none at all: the grid join is an equi-join
    assert "BroadcastNestedLoopJoin" not in plan


def test_near_pairs_random_boxes_equal_brute_force(spark):
    rnd = random.Random(23)
    m = 1 / 111195.0
    pts = []
    for b in range(6):
        lat0, lon0 = rnd.uniform(-89, 89), rnd.uniform(-180, 180)
        for i in range(120):
            pts.append((f"b{b}p{i}", lat0 + rnd.uniform(-12, 12) * m, lon0 + rnd.uniform(-12, 12) * m))
    df = spark.createDataFrame(pts, "MDM_CUST_KEY string, LATITUDE double, LONGITUDE double").repartition(5)
    got = {(r.MDM_CUST_KEY_1, r.MDM_CUST_KEY_2) for r in geo.near_pairs(df).collect()}
    assert got == _brute(pts)


def test_near_pairs_dense_site_salted(spark):
    m = 1 / 111195.0
    pts = [(f"d{i}", 12.0, 34.0) for i in range(60)] + [(f"n{i}", 12.0 + i * 0.7 * m, 34.0) for i in range(1, 12)]
    df = spark.createDataFrame(pts, "MDM_CUST_KEY string, LATITUDE double, LONGITUDE double")
    out = geo.near_pairs(df, block_rows=10)
    got = [(r.MDM_CUST_KEY_1, r.MDM_CUST_KEY_2) for r in out.collect()]
    assert len(got) == len(set(got))            # no pair twice across blocks
    keys = geo.candidates(df, block_rows=10).select("_cx", "_cy", "_cz", "_ia", "_ib").distinct().count()
    assert keys > 36                            # the dense cell's work lies in many join keys
    assert set(got) == _brute(pts)
