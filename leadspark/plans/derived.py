"""Lookup tables of the enrichment step, derived from the driver tables.

install base   <- dealer lines: first/last order date per customer for two part types
contracts      <- open orders per customer (several per key; keep-first by order key)
tech calls     <- error events per user (keep-first by event id)
territory      <- nations with a ZIP; several nations share a ZIP3 (fan-out on purpose)
external ids   <- orders per customer (keep-first by the saved row number)
implants A / B <- events of a user / signups of a user (several per key; keep-first by event id)
user lists     <- users with a large purchase and with a large signup, with contact data (full outer merge)

``order_lookups`` and ``event_lookups`` reduce the keep-first lookups of one source
together; the single tables stand for lookups that arrive as files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadspark.operators.firsts import First, firsts
from leadspark.plans import params as P
from leadspark.sources import tables

_TS = "yyyy-MM-dd HH:mm:ss"


def _money(c: str):
    return F.col(c).cast("decimal(18,2)") * 100


def install_base(spark: SparkSession, d: str, customer_keys: DataFrame | None = None) -> DataFrame:
    """First/last order date per customer for the tracked part types; optionally
    only for the customers in ``customer_keys`` (column ``_fk``)."""
    dl = tables.dealer_view(spark, d, customer_keys).filter(
        F.col("L1_DESC_NEW").isin(P.INSTALL_TYPES) & F.col("PRODUCT_NUMBER").isin(P.INSTALL_LINES))
    aggs = []
    for t in P.INSTALL_TYPES:
        dt = F.when(F.col("L1_DESC_NEW") == t, F.col("ORDER_DATE"))
        aggs.append(F.max(dt).cast("date").cast("string").alias(f"{t}_maxdate"))
        aggs.append(F.min(dt).cast("date").cast("string").alias(f"{t}_min"))
    aggs.append(F.count(F.lit(1)).alias("INSTALL_LINES"))
    return dl.groupBy(F.col("SHIP_TO_MDM_CUST_KEY").alias("ship_to_mdm_cust_key")).agg(*aggs)


def install_drop() -> list:
    return ["ship_to_mdm_cust_key"] + [f"{t}_{s}" for t in P.INSTALL_TYPES for s in ("maxdate", "min")]


def contracts(spark: SparkSession, d: str) -> DataFrame:
    o = tables.load(spark, d, "orders").filter(F.col("o_orderstatus") == P.CONTRACT_STATUS)
    return o.select(F.col("o_custkey").cast("string").alias("BILL_MDM_KEY"),
                    F.col("o_orderkey").cast("string").alias("SLA_SKU"),
                    F.col("o_orderpriority").alias("SLA_PRIORITY"),
                    F.col("o_totalprice").alias("SLA_VALUE"),
                    F.col("o_orderkey").alias("SLA_ORDER"))


def tech_calls(spark: SparkSession, d: str) -> DataFrame:
    e = tables.load(spark, d, "events").filter(F.col("event_type") == P.TECH_EVENT_TYPE)
    return e.select(F.col("user_id").cast("string").alias("MDM_ID"),
                    F.date_format("ts", _TS).alias("TECH_CALL_TS"),
                    F.col("value").alias("TECH_CALL_VALUE"),
                    F.col("event_id").alias("TECH_EVENT"))


def territory(spark: SparkSession, d: str) -> DataFrame:
    n = tables.load(spark, d, "nation")
    z = F.lpad((F.col("n_nationkey") * 37).cast("string"), 5, "0")
    return n.select(F.substring(z, 1, 3).alias("TERR_ZIP3"), F.col("n_name").alias("TERR_NATION"),
                    F.col("n_regionkey").alias("TERR_REGION"),
                    F.concat(F.lit("REP "), F.col("n_nationkey").cast("string")).alias("TERR_REP"))


def external_ids(spark: SparkSession, d: str) -> DataFrame:
    o = tables.load(spark, d, "orders")
    return o.select(F.col("o_custkey").cast("string").alias("mdm_site_key"),
                    F.concat(F.lit("EXT-"), F.col("o_orderkey").cast("string")).alias("EXT_ID"),
                    F.col("o_orderkey").alias("EXT_ROW"))


def implants_a(spark: SparkSession, d: str) -> DataFrame:
    """First implant records: one row per event, its money under the event's type; many per key."""
    e = tables.load(spark, d, "events")
    money = F.round(_money("value").cast("double"), 2)
    cols = [F.when(F.col("event_type") == t, money).alias(f"IMPL_{t.upper()}") for t in P.EVENT_TYPES]
    return e.select(F.col("user_id").cast("string").alias("IMPL_KEY"), F.col("event_id").alias("IMPL_ROW"), *cols)


def implants_b(spark: SparkSession, d: str) -> DataFrame:
    """Second implant records: one row per signup; many per key."""
    e = tables.load(spark, d, "events").filter(F.col("event_type") == "signup")
    return e.select(F.col("user_id").cast("string").alias("IDB_KEY"), F.col("event_id").alias("IDB_ROW"),
                    F.col("value").alias("IDB_VALUE"), F.date_format("ts", _TS).alias("IDB_FIRST_SIGNUP"))


def order_lookups(spark: SparkSession, d: str) -> DataFrame:
    """Keep-first contract and external id of each customer: ``contracts`` and ``external_ids`` from one scan."""
    o = tables.load(spark, d, "orders")
    both = firsts(o, "o_custkey", [
        First("o_orderkey", {"SLA_PRIORITY": "o_orderpriority", "SLA_VALUE": "o_totalprice"},
              F.col("o_orderstatus") == P.CONTRACT_STATUS, {"SLA_PRIORITY": P.ORDER_PRIORITIES}),
        First("o_orderkey", order_as="EXT_ROW")])
    return both.select(F.col("o_custkey").cast("string").alias("ORDER_KEY"), "SLA_PRIORITY", "SLA_VALUE",
                       F.concat(F.lit("EXT-"), F.col("EXT_ROW").cast("string")).alias("EXT_ID"))


def event_lookups(spark: SparkSession, d: str) -> DataFrame:
    """Keep-first tech call and implant records of each user: ``tech_calls``, ``implants_a`` and ``implants_b``
    from one scan; and of all its events the money by type, the number of signups and the earliest one."""
    e = tables.load(spark, d, "events")
    money = F.round(_money("value").cast("double"), 2)
    kinds = [t for t in P.EVENT_TYPES if t in P.IMPLANT_KINDS]
    e = e.select("*", *[F.when(F.col("event_type") == t, money).alias(f"_{t}") for t in kinds])
    is_a = lambda t: F.col("event_type") == t
    of = lambda t: F.when(is_a(t), _money("value"))
    totals = {f"_sum_{t}": F.sum(of(t)) for t in kinds} | {
        "IDB_SIGNUPS": F.count(F.when(is_a("signup"), F.lit(1))), "_earliest": F.min(F.when(is_a("signup"), F.col("ts")))}
    out = firsts(e, "user_id", [
        First("event_id", {"_call": "ts", "TECH_CALL_VALUE": "value"}, is_a(P.TECH_EVENT_TYPE)),
        First("event_id", {f"IMPL_{t.upper()}": f"_{t}" for t in kinds}),
        First("event_id", {"IDB_VALUE": "value", "_signup": "ts"}, is_a("signup"))], totals)
    return out.select(F.col("user_id").cast("string").alias("EVENT_KEY"),
                      F.date_format("_call", _TS).alias("TECH_CALL_TS"), "TECH_CALL_VALUE",
                      *[f"IMPL_{t.upper()}" for t in kinds], "IDB_VALUE",
                      F.date_format("_signup", _TS).alias("IDB_FIRST_SIGNUP"),
                      *[F.round(F.col(f"_sum_{t}").cast("double"), 2).alias(f"IMPL_TOTAL_{t.upper()}") for t in kinds],
                      F.when(F.col("IDB_SIGNUPS") > 0, F.col("IDB_SIGNUPS")).alias("IDB_SIGNUPS"),
                      F.date_format("_earliest", _TS).alias("IDB_EARLIEST_SIGNUP"))


def _user_list(spark: SparkSession, d: str, event_type: str, agg) -> DataFrame:
    """Users with an event of a type and of the least value that a list asks for."""
    e = tables.load(spark, d, "events").filter(
        (F.col("event_type") == event_type) & (F.col("value") >= P.IMPLANT_LEAST))
    u = e.groupBy(F.col("user_id").cast("string").alias("USER_KEY")).agg(agg)
    m = tables.customer_master(spark, d).select(
        F.col("MDM_CUST_KEY").alias("_mk"), F.col("ACCT_OFFICE_NAME").alias("CUSTOMER_NAME"),
        "CONT_FULLPHONE", F.col("ADDR_STREETADDR").alias("STREET"), F.col("ADDR_CITY").alias("CITY"),
        F.col("ADDR_STATE").alias("STATE"), F.col("ADDR_ZIP").alias("ZIP"), "CONT_EMAIL")
    return u.join(m, u.USER_KEY == m._mk, "left").drop("_mk")


def purchase_users(spark: SparkSession, d: str) -> DataFrame:
    return _user_list(spark, d, "purchase", F.count(F.lit(1)).alias("IMPLANT_QTY"))


def signup_users(spark: SparkSession, d: str) -> DataFrame:
    return _user_list(spark, d, "signup", F.round(F.sum(_money("value")).cast("double"), 2).alias("IMPLANT_USD"))


USER_LIST_COLS = ["CUSTOMER_NAME", "CONT_FULLPHONE", "STREET", "CITY", "STATE", "ZIP", "CONT_EMAIL"]
