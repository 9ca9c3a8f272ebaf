"""Channel unification: dealer + direct sales -> one sales fact.

Both channels are filtered, rolled up and summed at the grain
(operating company, customer, site, ZIP, L1, L2, year) and appended by
name.  The sums run as partial + final hash aggregates, so a customer that
holds a large share of the lines is collapsed map-side before the shuffle.

``profile`` holds the domain values (see ``SalesProfile``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadspark.functions.exprs import rollup

UNIFIED = ["OPCO", "MDM_CUST_KEY", "LATITUDE", "LONGITUDE", "ZIP",
           "L1_DESC", "L2_DESC", "YYYY", "SALES"]


def dealer_lines(dealer: DataFrame, profile) -> DataFrame:
    """The dealer lines that enter the unified fact (filters only).

    ``CAL_445_YYYY`` is a fiscal year: its edge weeks may lie in another
    calendar year, so nothing is derived from a line's date.
    """
    d = dealer
    members = [m for ms in profile.opco_map.values() for m in ms]
    cond = (F.col("CAL_445_YYYY").isin(profile.dealer_years) & F.col("COMPANY").isin(members)
            & F.col("L0_DESC_NEW").isin(profile.l0_values) & F.col("L1_DESC_NEW").isin(profile.l1_values))
    if profile.excluded_l2:
        # NOT IN on the whole value: a null L2 drops the row as in SQL
        cond = cond & ~F.col("L2_DESC_NEW").isin(profile.excluded_l2)
    # AND binds tighter than OR: class filter only for the listed products
    cond = cond & (F.col("ITEM_COMMISSION_CAT").isin(profile.commission_classes)
                   | (F.col("PRODUCT_NUMBER").isin(profile.product_numbers)
                      & (F.col("SDS_CUST_CLASS1") == profile.customer_class)))
    return d.filter(cond)


def dealer_channel(dealer: DataFrame, profile) -> DataFrame:
    """Filter + roll-up + sum of the dealer lines (one row per fine group)."""
    d = dealer_lines(dealer, profile)
    opco = rollup("COMPANY", profile.opco_map)
    g = d.groupBy(
        opco.alias("OPCO"),
        F.col("SHIP_TO_MDM_CUST_KEY").alias("MDM_CUST_KEY"),
        F.col("SHIP_TO_MDM_ADDR_LATITUDE").alias("LATITUDE"),
        F.col("SHIP_TO_MDM_ADDR_LONGITUDE").alias("LONGITUDE"),
        F.col("SHIP_TO_ZIP").alias("ZIP"),
        F.col("L1_DESC_NEW").alias("L1_DESC"),
        F.col("L2_DESC_NEW").alias("_L2_REAL"),
        F.col("CAL_445_YYYY").alias("YYYY"),
    ).agg(F.sum("EXT_IVC_COST_USD").alias("SALES"))
    l2 = F.col("L1_DESC") if profile.l2_from_l1 else F.col("_L2_REAL")
    return g.select("OPCO", "MDM_CUST_KEY", "LATITUDE", "LONGITUDE", "ZIP", "L1_DESC",
                    l2.alias("L2_DESC"), "YYYY", "SALES")


def direct_lines(direct: DataFrame, profile) -> DataFrame:
    """The direct-sales lines that enter the unified fact (filters only)."""
    cond = F.col("CAL_445_YYYY").isin(profile.direct_years) & F.col("P_CAT_L2_DESC").isin(profile.direct_l2_values)
    return direct.filter(cond & (F.col("CUST_CLASS_L1") == profile.direct_class))


def direct_channel(direct: DataFrame, master: DataFrame, profile) -> DataFrame:
    """Direct lines, left-joined to the customer master for the site.

    A master with duplicate keys multiplies the matching lines (SQL
    semantics of the left join, kept on purpose).
    """
    n = direct_lines(direct, profile)
    # sum the lines per (customer, zip, category, year) before the join: a
    # customer holding a large share of the lines reaches the join as a few
    # rows.  Summing again after the join keeps the SQL result, including the
    # multiplication by duplicate master keys.
    pre = n.groupBy("MDM_CUST_KEY", "ADDR_ZIP", "P_CAT_L1_DESC", "P_CAT_L2_DESC", "CAL_445_YYYY") \
           .agg(F.sum("GROSS_SALES_USD").alias("_s"))
    m = master.select(F.col("MDM_CUST_KEY").alias("_MKEY"), "ADDR_LATITUDE", "ADDR_LONGITUDE")
    j = pre.join(m, pre.MDM_CUST_KEY == m._MKEY, "left")
    j = tag_source(j, profile.direct_tag, "OPCO")
    return j.groupBy(
        F.col("OPCO"),
        F.col("MDM_CUST_KEY"),
        F.col("ADDR_LATITUDE").alias("LATITUDE"),
        F.col("ADDR_LONGITUDE").alias("LONGITUDE"),
        F.col("ADDR_ZIP").alias("ZIP"),
        F.col("P_CAT_L1_DESC").alias("L1_DESC"),
        F.col("P_CAT_L2_DESC").alias("L2_DESC"),
        F.col("CAL_445_YYYY").alias("YYYY"),
    ).agg(F.sum("_s").alias("SALES"))


def sales(dealer: DataFrame, direct: DataFrame, master: DataFrame, profile) -> DataFrame:
    """UNION ALL of both channels in the unified layout (SALES stays decimal)."""
    a = dealer_channel(dealer, profile)
    b = direct_channel(direct, master, profile)
    t = "decimal(38,4)"
    a = a.withColumn("SALES", F.col("SALES").cast(t))
    b = b.withColumn("SALES", F.col("SALES").cast(t))
    return a.select(*UNIFIED).unionByName(b.select(*UNIFIED))


def tag_source(df: DataFrame, tag: str, out: str = "OPCO") -> DataFrame:
    """Constant source tag column (a grouping by a literal is a no-op)."""
    return df.withColumn(out, F.lit(tag))


def site_lines(dealer: DataFrame, direct: DataFrame, master: DataFrame, profile) -> DataFrame:
    """(MDM_CUST_KEY, LATITUDE, LONGITUDE) of every line that enters the unified
    fact, without summing: the keys and sites of the unified fact are the same,
    so a per-customer dedupe can run on these directly (one shuffle less than
    summing at the fine grain first)."""
    a = dealer_lines(dealer, profile).select(
        F.col("SHIP_TO_MDM_CUST_KEY").alias("MDM_CUST_KEY"),
        F.col("SHIP_TO_MDM_ADDR_LATITUDE").alias("LATITUDE"),
        F.col("SHIP_TO_MDM_ADDR_LONGITUDE").alias("LONGITUDE"))
    keys = direct_lines(direct, profile).select("MDM_CUST_KEY").distinct()
    m = master.select(F.col("MDM_CUST_KEY").alias("_MKEY"), F.col("ADDR_LATITUDE").alias("LATITUDE"),
                      F.col("ADDR_LONGITUDE").alias("LONGITUDE"))
    b = keys.join(m, keys.MDM_CUST_KEY == m._MKEY, "left").select("MDM_CUST_KEY", "LATITUDE", "LONGITUDE")
    return a.unionByName(b)
