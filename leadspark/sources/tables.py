"""Table scans and the source views the lead pipeline reads.

``load`` reads one parquet table of a data folder.  The ``*_view`` builders
present the driver's TPC-H-like tables in the shape of the sales sources
the pipeline expects (see README, "Driver-table mapping").  They are plain
lazy DataFrames: Catalyst pushes the pipeline's filters and projections
through them down to the parquet scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def load(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{data_dir.rstrip('/')}/{name}.parquet")


# -- derived customer attributes --------------------------------------------
# Coordinates are built from integers and divided once, so every engine gets
# the same double.  Four consecutive keys share a site within a few metres, and
# the first forty keys one dense site; sites are spread over the globe by
# multipliers coprime to moduli far above the number of sites, so pairs grow
# with the customers.  Every eleventh key has no latitude.

def _site(key: Column) -> Column:
    return F.when(key <= 40, F.lit(0)).otherwise(F.floor(key / F.lit(4)))


def _lat(key: Column, shift: Column | None = None) -> Column:
    e5 = (_site(key) * 104729) % 16000000 - 8000000 + (key % 4) * 2
    if shift is not None:
        e5 = e5 + shift
    return F.when(key % 11 == 0, F.lit(None).cast("double")).otherwise(e5.cast("double") / F.lit(100000.0))


def _lon(key: Column) -> Column:
    e5 = (_site(key) * 15485863) % 36000000 - 18000000 + key % 4
    return e5.cast("double") / F.lit(100000.0)


def _in_years(date: Column, years) -> Column:
    """Dates within the calendar years of a list, as a range that reaches the scan.

    Only for the views below, whose fiscal year *is* the calendar year.
    """
    if not years:
        return F.lit(False)
    start = F.lit(f"{min(years):04d}-01-01 00:00:00").cast("timestamp_ntz")
    stop = F.lit(f"{max(years) + 1:04d}-01-01 00:00:00").cast("timestamp_ntz")
    return (date >= start) & (date < stop)


def _zip(nationkey: Column) -> Column:
    return F.lpad((nationkey * 37).cast("string"), 5, "0")


def _money(value: Column) -> Column:
    return value.cast("decimal(18,2)")


def customer_master(spark: SparkSession, data_dir: str) -> DataFrame:
    """Customer master: site and contact data; every fiftieth key has two rows (a second city)."""
    c = load(spark, data_dir, "customer")
    k = F.col("c_custkey")
    cities = F.when(k % 50 == 0, F.array(F.lit("CITY "), F.lit("TOWN "))).otherwise(F.array(F.lit("CITY ")))
    return c.withColumn("_city", F.explode(cities)).select(
        k.cast("string").alias("MDM_CUST_KEY"),
        _lat(k).alias("ADDR_LATITUDE"),
        _lon(k).alias("ADDR_LONGITUDE"),
        _zip(F.col("c_nationkey")).alias("ADDR_ZIP"),
        F.col("c_mktsegment").alias("SDS_CUST_CLASS1"),
        F.col("c_name").alias("ACCT_OFFICE_NAME"),
        F.concat(k.cast("string"), F.lit(" MAIN ST")).alias("ADDR_STREETADDR"),
        F.concat(F.col("_city"), F.col("c_nationkey").cast("string")).alias("ADDR_CITY"),
        F.concat(F.lit("ST"), F.col("c_nationkey").cast("string")).alias("ADDR_STATE"),
        F.lpad(k.cast("string"), 10, "5").alias("CONT_FULLPHONE"),
        F.concat(F.lit("c"), k.cast("string"), F.lit("@example.com")).alias("CONT_EMAIL"),
    )


def dealer_view(spark: SparkSession, data_dir: str, customer_keys: DataFrame | None = None,
                years=None) -> DataFrame:
    """Dealer sales lines: lineitem x orders x part x customer.

    company = brand, L0 = part size modulo 4, L1 = part type, real L2 = part
    name (spare parts: names that begin with "small"), commission class = order priority, product number = line number, customer class = market
    segment.  Returns are booked negative at full price.
    ``customer_keys`` (one string column ``_fk``) restricts the orders to
    those customers before any join: for a short key list the orders shrink
    to a broadcastable size and the line items are joined without a shuffle.
    ``years`` restricts the orders to those fiscal (here: calendar) years.
    One order in sixteen ships to a second site of its customer.
    """
    li = load(spark, data_dir, "lineitem")
    o = load(spark, data_dir, "orders")
    if customer_keys is not None:
        o = o.join(customer_keys, o.o_custkey.cast("string") == customer_keys["_fk"], "left_semi")
    if years is not None:
        o = o.filter(_in_years(F.col("o_orderdate"), years))
    p = load(spark, data_dir, "part")
    c = load(spark, data_dir, "customer")
    k = F.col("o_custkey")
    # part first: the pipeline's brand/type filters keep about a third of the
    # parts, so the line items shrink before the larger orders join
    j = (li.join(p, li.l_partkey == p.p_partkey)
           .join(o, li.l_orderkey == o.o_orderkey)
           .join(c, o.o_custkey == c.c_custkey))
    price = _money(F.col("l_extendedprice"))
    money = F.when(F.col("l_returnflag") == "R", -price).otherwise(
        price * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)")))
    return j.select(
        F.col("p_brand").alias("COMPANY"),
        k.cast("string").alias("SHIP_TO_MDM_CUST_KEY"),
        _lat(k, F.when(F.col("o_orderkey") % 16 == 0, 50000).otherwise(0)).alias("SHIP_TO_MDM_ADDR_LATITUDE"),
        _lon(k).alias("SHIP_TO_MDM_ADDR_LONGITUDE"),
        _zip(F.col("c_nationkey")).alias("SHIP_TO_ZIP"),
        F.concat(F.lit("L0_"), (F.col("p_size") % 4).cast("string")).alias("L0_DESC_NEW"),
        F.col("p_type").alias("L1_DESC_NEW"),
        F.when(F.substring_index("p_name", " ", 1) == "small", "SPARE PARTS").otherwise(F.col("p_name"))
        .alias("L2_DESC_NEW"),
        F.year("o_orderdate").cast("int").alias("CAL_445_YYYY"),
        F.col("o_orderdate").alias("ORDER_DATE"),
        money.alias("EXT_IVC_COST_USD"),
        F.col("o_orderpriority").alias("ITEM_COMMISSION_CAT"),
        F.col("l_linenumber").alias("PRODUCT_NUMBER"),
        F.col("c_mktsegment").alias("SDS_CUST_CLASS1"),
    )


def direct_view(spark: SparkSession, data_dir: str, l1: str, unmatched: str, years=None) -> DataFrame:
    """Direct sales lines: events of a customer, L1 constant, L2 = event type.

    A few events have no key, an empty one, or the one of unmatched customers;
    every seventh user is of the internal class.
    """
    e = load(spark, data_dir, "events")
    if years is not None:
        e = e.filter(_in_years(F.col("ts"), years))
    k = F.col("user_id")
    odd = F.col("event_id") % 101
    key = (F.when(odd == 0, F.lit(None).cast("string")).when(odd == 1, "").when(odd == 2, unmatched)
           .otherwise(k.cast("string")))
    return e.select(
        key.alias("MDM_CUST_KEY"),
        _zip(k % 25).alias("ADDR_ZIP"),
        F.lit(l1).alias("P_CAT_L1_DESC"),
        F.col("event_type").alias("P_CAT_L2_DESC"),
        F.year("ts").cast("int").alias("CAL_445_YYYY"),
        F.col("ts").alias("ORDER_DATE"),
        (_money(F.col("value")) * 100).alias("GROSS_SALES_USD"),
        F.when(k % 7 == 0, "INTERNAL").otherwise("CUSTOMER").alias("CUST_CLASS_L1"),
    )
