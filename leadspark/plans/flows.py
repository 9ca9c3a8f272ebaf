"""The lead pipeline bound to a data folder of driver tables.

Every function takes ``(spark, data_dir)`` and returns a lazy DataFrame
built from the operators; ``catalog`` registers them as queries.
"""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadspark.operators import cleanse, fact, features, unify
from leadspark.plans import params as P
from leadspark.sources import tables


def master(spark: SparkSession, d: str) -> DataFrame:
    return tables.customer_master(spark, d)


def unified_sales(spark: SparkSession, d: str, profile: P.SalesProfile = P.FEATURES) -> DataFrame:
    return unify.sales(dealer_view(spark, d, profile), direct_view(spark, d, profile), master(spark, d), profile)


def load_sales(spark: SparkSession, d: str, path: str, years, profile: P.SalesProfile = P.FEATURES) -> dict[int, int]:
    """Load ``years`` of the unified sales into the fact at ``path``; the sources are read for these years only."""
    own = replace(profile, dealer_years=[y for y in profile.dealer_years if y in years],
                  direct_years=[y for y in profile.direct_years if y in years])
    return fact.load_years(unified_sales(spark, d, own), path, years)


def sales_fact(spark: SparkSession, d: str, years=None, profile: P.SalesProfile = P.FEATURES) -> DataFrame:
    """The unified sales, or some years of them, from a fact written once per session and state of the data folder."""
    from leadspark.session import memo, scratch_path

    def build():
        path = scratch_path(spark, f"sales_fact/{uuid.uuid4().hex}")
        load_sales(spark, d, path, sorted({*profile.dealer_years, *profile.direct_years}), profile)
        return path
    path = memo(spark, d, f"sales fact {profile}", build)
    return fact.read_years(spark, path, unified_sales(spark, d, profile).schema, years)


def dealer_view(spark: SparkSession, d: str, profile: P.SalesProfile = P.FEATURES) -> DataFrame:
    return tables.dealer_view(spark, d, years=profile.dealer_years)


def direct_view(spark: SparkSession, d: str, profile: P.SalesProfile = P.FEATURES) -> DataFrame:
    return tables.direct_view(spark, d, P.DIRECT_L1, P.UNMATCHED_KEY, profile.direct_years)


def positive_sales(spark: SparkSession, d: str) -> DataFrame:
    return cleanse.keep_positive(unified_sales(spark, d, P.FEATURES), "SALES", P.KEY)


def category_pivot(spark: SparkSession, d: str) -> DataFrame:
    pos = features.add_category(positive_sales(spark, d))
    return features.pivot_sum(pos, P.KEY, "L1_L2_DESC", "SALES", P.PIVOT_VALUES)


def feature_table(spark: SparkSession, d: str, drop_outliers: bool = False, fresh: bool = False) -> DataFrame:
    """The labelled feature table, written once per session and state of the data folder.

    Every later step (split, balance, models, scores, lists, profiles) reads
    the written table instead of re-running the sales joins; ``fresh``
    rebuilds it.
    """
    from leadspark.session import freeze, memo

    def build():
        ft = features.feature_table(
            unified_sales(spark, d, P.FEATURES), key=P.KEY, pivot_values=P.PIVOT_VALUES,
            target=P.TARGET_CATEGORY, threshold=P.TARGET_THRESHOLD, sentinel=P.UNMATCHED_KEY,
            k=P.WHISKER_K, target_out=P.TARGET_OUT, label_col=P.LABEL, drop_outliers=drop_outliers)
        return freeze(ft, "features")
    return memo(spark, d, f"features {drop_outliers}", build, fresh)


def feature_columns() -> list:
    """Model inputs: every pivot column except the target."""
    return features.check_feature_list([v for v in P.PIVOT_VALUES if v != P.TARGET_CATEGORY])


def top_prospects(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: customers without the target purchase, biggest buyers first."""
    ft = feature_table(spark, d)
    total = None
    for c in feature_columns():
        v = F.col(f"`{c}`")
        total = v if total is None else total + v
    return (ft.filter(F.col(P.LABEL) == 0)
              .withColumn("TOTAL_SALES", F.round(total, 4))
              .orderBy(F.desc("TOTAL_SALES"), F.asc(P.KEY)))


# -- scoring and enrichment ------------------------------------------------------

def scored_rule(spark: SparkSession, d: str) -> DataFrame:
    """Feature table with a rule-based ``lead_gen_prob`` (stand-in for a model)."""
    from leadspark.operators import score
    return score.rule_probability(feature_table(spark, d), P.RULE_SCORE_COLUMN, P.RULE_SCORE_SCALE)


def lead_table(spark: SparkSession, d: str, scored: DataFrame | None = None,
               threshold: float = P.LEAD_THRESHOLD_ALL) -> DataFrame:
    """Leads (label 0, probability above threshold) with cleaned column names."""
    from leadspark.operators import score
    s = scored if scored is not None else scored_rule(spark, d)
    return cleanse.clean_names(score.leads(s, threshold))


def lead_master(spark: SparkSession, d: str, leads: DataFrame | None = None) -> DataFrame:
    """Leads left-joined to the customer master (one key column), in no order."""
    from leadspark.operators import enrich
    lt = leads if leads is not None else lead_table(spark, d)
    # the master is reduced to the leads' keys first (map-side when the lead list is short)
    return enrich.lookup(lt, master(spark, d), P.KEY, P.KEY, "left", prefilter=True)


def lead_fact(spark: SparkSession, d: str, leads: DataFrame | None = None) -> DataFrame:
    """Leads with the customer master, lowest probability first."""
    j = lead_master(spark, d, leads)
    # the key breaks ties, so equal probabilities spread over range partitions
    return j.orderBy(F.asc_nulls_first("lead_gen_prob"), F.asc(P.KEY))


def fact_selection(spark: SparkSession, d: str, min_prob: float | None = None) -> DataFrame:
    """Leads of one customer class, reduced to the columns of the sales list;
    ``min_prob`` optionally keeps only leads with a higher probability."""
    f = lead_master(spark, d).filter(F.col("SDS_CUST_CLASS1") == P.FACT_CLASS)
    if min_prob is not None:
        f = f.filter(F.col("lead_gen_prob") > min_prob)
    cols = [P.KEY] + P.CONTACT_COLS + ["ADDR_LATITUDE", "ADDR_LONGITUDE", "lead_gen_prob"] + P.FACT_FEATURES
    return f.select(*cols)


def lookup_store(spark: SparkSession, d: str):
    """The lead list and its six lookups of one customer key, as co-located tables.

    Written once per session and state of the data folder, for all lists:
    ``leads``, ``install`` (only the leads' orders are read), ``orders`` (contract
    and external id) and ``events`` (tech call and both implant records).
    """
    from leadspark.operators.enrich import key_set
    from leadspark.operators.store import LookupStore
    from leadspark.plans import derived as D
    from leadspark.session import memo

    def build():
        store = LookupStore(spark, int(spark.conf.get("spark.sql.shuffle.partitions")))
        leads = store.write("leads", fact_selection(spark, d), P.KEY)
        store.write("install", D.install_base(spark, d, key_set(leads, P.KEY)), "ship_to_mdm_cust_key")
        store.write("orders", D.order_lookups(spark, d), "ORDER_KEY")
        store.write("events", D.event_lookups(spark, d), "EVENT_KEY")
        return store
    return memo(spark, d, "lookup store", build)


STAR_ORDERS = ["SLA_PRIORITY", "SLA_VALUE", "EXT_ID"]
STAR_EVENTS = ["TECH_CALL_TS", "TECH_CALL_VALUE", *[f"IMPL_{t.upper()}" for t in P.IMPLANT_KINDS],
               "IDB_VALUE", "IDB_FIRST_SIGNUP"]
#: columns of all events of a customer, and their names in a list with totals; the kept records' names there
STAR_TOTALS = {**{f"IMPL_TOTAL_{t.upper()}": f"IMPL_{t.upper()}" for t in P.IMPLANT_KINDS},
               "IDB_SIGNUPS": "IDB_SIGNUPS", "IDB_EARLIEST_SIGNUP": "IDB_FIRST_SIGNUP"}
STAR_KEPT = {**{f"IMPL_{t.upper()}": f"IMPL_KEPT_{t.upper()}" for t in P.IMPLANT_KINDS}, "IDB_FIRST_SIGNUP": "IDB_KEPT_SIGNUP"}


def star_customer(spark: SparkSession, d: str, first_how: str, min_prob: float | None = None,
                  max_year: int | None = None, totals: bool = False) -> DataFrame:
    """The lead list with its six lookups of the customer key: joins of co-located tables, no shuffle.

    ``totals`` adds the implant money by type and the signups over all events of a customer,
    beside the records kept first.
    """
    from leadspark.operators.store import JOIN_KEY
    store = lookup_store(spark, d)
    fact = store.table("leads")
    if min_prob is not None:
        fact = fact.filter(F.col("lead_gen_prob") > min_prob)
    inst = store.table("install")
    if max_year is not None:
        last = F.greatest(*[F.year(F.col(f"{t}_maxdate").cast("date")) for t in P.INSTALL_TYPES])
        inst = inst.filter(last <= max_year)
    fact = fact.join(inst.select(JOIN_KEY, "INSTALL_LINES"), JOIN_KEY, first_how)
    fact = store.join(fact, "orders", cols=STAR_ORDERS)
    if not totals:
        return store.join(fact, "events", cols=STAR_EVENTS).drop(JOIN_KEY)
    fact = store.join(fact, "events", cols=[*STAR_EVENTS, *STAR_TOTALS]).drop(JOIN_KEY)
    return fact.withColumnsRenamed(STAR_KEPT).withColumnsRenamed(STAR_TOTALS)


def star_list(spark: SparkSession, d: str, first_how: str, min_prob: float | None = None,
              max_year: int | None = None, totals: bool = False) -> DataFrame:
    """Flat lead list: fact + seven lookups; ``first_how`` is the install-base join, ``max_year`` keeps
    install-base customers whose latest purchase of the tracked types is in that year or earlier;
    ``totals`` as in ``star_customer``."""
    from leadspark.operators.enrich import lookup, zip3
    from leadspark.plans import derived as D
    fact = star_customer(spark, d, first_how, min_prob, max_year, totals).withColumn("ZIP3", zip3("ADDR_ZIP"))
    return lookup(fact, D.territory(spark, d), "ZIP3", "TERR_ZIP3", drop=["TERR_REGION"], null_safe=True)


def implant_users(spark: SparkSession, d: str) -> DataFrame:
    """Full outer merge of the purchase and signup user lists (``_x``/``_y`` suffixes)."""
    from leadspark.operators.outer import full_merge
    from leadspark.plans import derived as D
    return full_merge(D.purchase_users(spark, d), D.signup_users(spark, d), "USER_KEY")


def implant_list(spark: SparkSession, d: str) -> DataFrame:
    """The merged user lists with the install base of their customers' orders only."""
    from leadspark.operators.enrich import key_set, lookup
    from leadspark.session import freeze
    from leadspark.plans import derived as D
    u = implant_users(spark, d)
    u = freeze(u, "implant_users")
    cols = (["USER_KEY"] + [c + "_x" for c in D.USER_LIST_COLS] + [c + "_y" for c in D.USER_LIST_COLS]
            + ["IMPLANT_QTY", "IMPLANT_USD"])
    return lookup(u.select(*cols), D.install_base(spark, d, key_set(u, "USER_KEY")), "USER_KEY", "ship_to_mdm_cust_key", "left",
                  drop_right_key=False, null_safe=True)
