from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from leadspark.operators import enrich, unify
from leadspark.plans import params as P
from leadspark.plans.params import SalesProfile
from leadspark.sources import tables

DEALER = ("COMPANY string, SHIP_TO_MDM_CUST_KEY string, SHIP_TO_MDM_ADDR_LATITUDE double, "
          "SHIP_TO_MDM_ADDR_LONGITUDE double, SHIP_TO_ZIP string, L0_DESC_NEW string, L1_DESC_NEW string, L2_DESC_NEW string, "
          "CAL_445_YYYY int, EXT_IVC_COST_USD decimal(18,2), ITEM_COMMISSION_CAT string, PRODUCT_NUMBER int, "
          "SDS_CUST_CLASS1 string")
DIRECT = ("MDM_CUST_KEY string, ADDR_ZIP string, P_CAT_L1_DESC string, P_CAT_L2_DESC string, CAL_445_YYYY int, "
          "GROSS_SALES_USD decimal(18,2), CUST_CLASS_L1 string")
PROFILE = SalesProfile(name="t", opco_map={"K": ["k1", "k2"], "D": ["d1"]}, dealer_years=[2020],
                       l0_values=["T"], l1_values=["A", "B"], l2_from_l1=False, excluded_l2=["SPARE PARTS"],
                       commission_classes=["C1"], product_numbers=[7], customer_class="STD",
                       direct_years=[2020], direct_tag="N", direct_l1="DIR", direct_l2_values=["x"], direct_class="CUST")


def _d(company, key, l2, cat, prod, cls, amt, l1="A", year=2020, l0="T"):
    return (company, key, 1.0, 2.0, "01234", l0, l1, l2, year, Decimal(str(amt)), cat, prod, cls)


def test_dealer_filters_and_precedence(spark):
    rows = [
        _d("k1", "c1", "w a", "C1", 1, "OTHER", 10),   # class ok -> kept
        _d("k2", "c2", "w b", "NO", 7, "OTHER", 20),   # product ok, class wrong -> dropped
        _d("d1", "c3", "w c", "NO", 7, "STD", 30),     # product ok and class ok -> kept
        _d("k1", "c4", None, "C1", 1, "STD", 40),      # null L2 dropped by NOT IN
        _d("k1", "c5", "SPARE PARTS", "C1", 1, "STD", 50),  # spare part dropped
        _d("k1", "c1", "SPARE x", "C1", 1, "STD", 5),  # the whole value counts, not its first word
        _d("k1", "c9", "w", "C1", 1, "STD", 90, l0="Z"),
        _d("zz", "c6", "w", "C1", 1, "STD", 60),       # company not listed
        _d("k1", "c7", "w", "C1", 1, "STD", 70, year=2019),
        _d("k1", "c8", "w", "C1", 1, "STD", 80, l1="Z"),
    ]
    out = unify.dealer_channel(spark.createDataFrame(rows, DEALER), PROFILE).collect()
    got = {(r.OPCO, r.MDM_CUST_KEY, float(r.SALES)) for r in out}
    assert got == {("K", "c1", 10.0), ("K", "c1", 5.0), ("D", "c3", 30.0)}


def test_fiscal_year_foreign_level_and_whole_value(spark):
    """A spare-part line, a valid line of an edge week dated in another calendar year, a line of a foreign L0."""
    rows = [_d("k1", "a", "SPARE PARTS", "C1", 1, "STD", 1), _d("k1", "b", "w", "C1", 1, "STD", 2),
            _d("k1", "c", "w", "C1", 1, "STD", 3, l0="OTHER")]
    df = spark.createDataFrame(rows, DEALER).withColumn("ORDER_DATE", F.lit("2019-12-31").cast("timestamp"))
    assert [r.MDM_CUST_KEY for r in unify.dealer_channel(df, PROFILE).collect()] == ["b"]


def test_direct_class(spark):
    rows = [("u1", "00001", "DIR", "x", 2020, Decimal("5.00"), c) for c in ("CUST", "OTHER", None)]
    direct = spark.createDataFrame(rows, DIRECT)
    assert unify.direct_lines(direct, PROFILE).count() == 1


def test_every_predicate_removes_rows(spark):
    """Each filter of both profiles drops some line of the driver tables that all others keep."""
    d = "/root/testdata/sf0.01"
    full = {"dealer_years": list(range(1980, 2040)), "l0_values": [f"L0_{i}" for i in range(9)],
            "l1_values": [*P.L1_VALUES, "ECONOMY"], "excluded_l2": None,
            "product_numbers": list(range(9)), "commission_classes": [*P.COMMISSION_CLASSES, "4-NOT SPECIFIED", "5-LOW"],
            "opco_map": {"X": [f"Brand#{i}" for i in range(60)]}}
    dealer = tables.dealer_view(spark, d)
    least = unify.dealer_lines(dealer, P.FEATURES).count()
    for name, value in full.items():
        wider = SalesProfile(**{**P.FEATURES.__dict__, name: value})
        assert unify.dealer_lines(dealer, wider).count() > least, name
    direct = tables.direct_view(spark, d, P.DIRECT_L1, P.UNMATCHED_KEY)
    n = unify.direct_lines(direct, P.FEATURES).count()
    assert 0 < n < direct.filter(F.col("P_CAT_L2_DESC").isin(P.DIRECT_L2_FEATURES)).count()
    assert n != unify.direct_lines(direct, P.MATCH).count()


def test_feature_profile_grain(spark):
    prof = SalesProfile(**{**PROFILE.__dict__, "l2_from_l1": True, "name": "f"})
    rows = [_d("k1", "c1", "w a", "C1", 1, "S", 10), _d("k1", "c1", "w b", "C1", 1, "S", -4)]
    out = unify.dealer_channel(spark.createDataFrame(rows, DEALER), prof).collect()
    assert sorted(float(r.SALES) for r in out) == [-4.0, 10.0]     # two fine groups
    assert {r.L2_DESC for r in out} == {"A"}                         # L2 shows L1


def test_master_fanout(spark):
    direct = spark.createDataFrame(
        [("u1", "00001", "DIR", "x", 2020, Decimal("5.00"), "CUST")], DIRECT)
    master = spark.createDataFrame([("u1", 1.0, 2.0), ("u1", 1.0, 2.0)],
                                   "MDM_CUST_KEY string, ADDR_LATITUDE double, ADDR_LONGITUDE double")
    out = unify.direct_channel(direct, master, PROFILE).collect()
    assert [float(r.SALES) for r in out] == [10.0]


def test_merge_outer_and_suffixes(spark):
    a = spark.createDataFrame([("1", "la"), ("2", "lb")], "k string, name string")
    b = spark.createDataFrame([("2", "rb"), ("3", "rc")], "k string, name string")
    m = enrich.merge(a, b, "k", "k", "full")
    assert m.columns == ["k", "name_x", "name_y"]
    assert sorted(tuple(r) for r in m.collect()) == [("1", "la", None), ("2", "lb", "rb"), ("3", None, "rc")]


def test_lookup_null_safe_and_keep_first(spark):
    fact = spark.createDataFrame([("a",), (None,), ("zz",)], "k string")
    dim = spark.createDataFrame([("a", 2, "late"), ("a", 1, "early"), (None, 1, "nullrow")],
                                "dk string, o int, v string")
    plain = enrich.lookup(fact, dim, "k", "dk", dedupe_order="o", drop=["o"])
    assert plain.columns == ["k", "v"]
    assert {r.k: r.v for r in plain.collect()} == {"a": "early", None: None, "zz": None}
    ns = enrich.lookup(fact, dim, "k", "dk", dedupe_order="o", drop=["o"], null_safe=True)
    assert {r.k: r.v for r in ns.collect()} == {"a": "early", None: "nullrow", "zz": None}
    with pytest.raises(KeyError):
        enrich.lookup(fact, dim, "k", "dk", drop=["missing"])


def test_zip3_fanout_and_leading_zero(spark):
    fact = spark.createDataFrame([("c1", "01234"), ("c2", "99999")], "k string, zip string")
    terr = spark.createDataFrame([("012", "T1"), ("012", "T2")], "z3 string, terr string")
    f = fact.withColumn("ZIP3", enrich.zip3("zip"))
    out = enrich.lookup(f, terr, "ZIP3", "z3")
    got = sorted((r.k, r.ZIP3, r.terr) for r in out.collect())
    assert got == [("c1", "012", "T1"), ("c1", "012", "T2"), ("c2", "999", None)]


def test_chain_on_one_key_shuffles_the_fact_once(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        fact = spark.range(50).selectExpr("cast(id as string) as k", "id as x")
        for null_safe in (False, True):
            out = fact
            for i in range(3):
                dim = spark.range(20).selectExpr(f"cast(id as string) as d{i}", f"id as v{i}")
                out = enrich.lookup(out, dim, "k", f"d{i}", null_safe=null_safe)
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") == 4, plan  # the fact, and each lookup
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_star_chain(spark):
    fact = spark.createDataFrame([("a", "01234")], "k string, zip string")
    d1 = spark.createDataFrame([("a", 1)], "k1 string, v1 int")
    d2 = spark.createDataFrame([("012", "T")], "z string, t string")
    out = enrich.star(fact, [
        enrich.Lookup(d1, "k", "k1", "inner", drop=["k1"]),
        enrich.Lookup(d2, "ZIP3", "z", drop=["z"], derive={"ZIP3": enrich.zip3("zip")}),
    ])
    assert out.columns == ["k", "zip", "v1", "ZIP3", "t"]
    assert [tuple(r) for r in out.collect()] == [("a", "01234", 1, "012", "T")]


def test_prefilter_keeps_results(spark):
    fact = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    dim = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("c", 1, "z"), (None, 1, "n")],
                                "dk string, o int, v string")
    for ns in (False, True):
        a = enrich.lookup(fact, dim, "k", "dk", dedupe_order="o", drop=["o"], null_safe=ns)
        b = enrich.lookup(fact, dim, "k", "dk", dedupe_order="o", drop=["o"], null_safe=ns, prefilter=True)
        assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


def test_master_fanout_distinct_sites(spark):
    direct = spark.createDataFrame(
        [("u1", "00001", "DIR", "x", 2020, Decimal("5.00"), "CUST"),
         ("u1", "00001", "DIR", "x", 2020, Decimal("1.00"), "CUST")], DIRECT)
    master = spark.createDataFrame([("u1", 1.0, 2.0), ("u1", 3.0, 4.0)],
                                   "MDM_CUST_KEY string, ADDR_LATITUDE double, ADDR_LONGITUDE double")
    out = unify.direct_channel(direct, master, PROFILE).collect()
    assert sorted((r.LATITUDE, float(r.SALES)) for r in out) == [(1.0, 6.0), (3.0, 6.0)]
