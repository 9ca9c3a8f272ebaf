"""Further registered queries (geo, enrichment, sampling, evaluation, ML)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadspark.operators import enrich, evaluate, geo, profile, sampling, score
from leadspark.plans import derived as D
from leadspark.plans import flows
from leadspark.plans import oracle as O
from leadspark.plans import params as P
from leadspark.plans.catalog import query
from leadspark.session import freeze

# -- near-duplicate sites ------------------------------------------------------

_SITES = """sites as (
  select MDM_CUST_KEY, LATITUDE, LONGITUDE from (
    select MDM_CUST_KEY, LATITUDE, LONGITUDE,
           row_number() over (partition by MDM_CUST_KEY order by LATITUDE, LONGITUDE) as rn
    from sales where MDM_CUST_KEY is not null and LATITUDE is not null and LONGITUDE is not null)
  where rn = 1)"""

_HAV = ("atan2(sqrt(pow(sin(radians(b.LATITUDE - a.LATITUDE) / 2.0), 2) + cos(radians(a.LATITUDE)) * "
        "cos(radians(b.LATITUDE)) * pow(sin(radians(b.LONGITUDE - a.LONGITUDE) / 2.0), 2)), "
        "sqrt(1.0 - (pow(sin(radians(b.LATITUDE - a.LATITUDE) / 2.0), 2) + cos(radians(a.LATITUDE)) * "
        "cos(radians(b.LATITUDE)) * pow(sin(radians(b.LONGITUDE - a.LONGITUDE) / 2.0), 2)))) "
        f"* 2.0 * {P.EARTH_RADIUS_KM} * 1000.0")


def match_sites(spark: SparkSession, d: str) -> DataFrame:
    """One site per customer of the matching profile (deduped from the lines)."""
    from leadspark.operators import unify
    lines = unify.site_lines(flows.dealer_view(spark, d, P.MATCH), flows.direct_view(spark, d, P.MATCH),
                             flows.master(spark, d), P.MATCH)
    return geo.sites(lines)


@query("first_site", O.with_(O.sales_ctes(P.MATCH), _SITES) + "select * from sites")
def q_first_site(spark: SparkSession, d: str) -> DataFrame:
    return match_sites(spark, d)


@query("near_pairs", O.with_(O.sales_ctes(P.MATCH), _SITES) + f"""
select a.MDM_CUST_KEY as MDM_CUST_KEY_1, a.LATITUDE as LATITUDE_1, a.LONGITUDE as LONGITUDE_1,
       b.MDM_CUST_KEY as MDM_CUST_KEY_2, b.LATITUDE as LATITUDE_2, b.LONGITUDE as LONGITUDE_2,
       round({_HAV}, 4) as DISTANCE
from sites a, sites b
where a.MDM_CUST_KEY != b.MDM_CUST_KEY and {_HAV} < {P.NEAR_METRES}""")
def q_near_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = geo.near_pairs(match_sites(spark, d), metres=P.NEAR_METRES, radius_km=P.EARTH_RADIUS_KM)
    return pairs.withColumn("DISTANCE", F.round("DISTANCE", 4))


@query("rounded_cells", O.with_(O.sales_ctes(P.MATCH), _SITES) + """
select round(LATITUDE, 0) + 0.0 as LAT_ROUND, round(LONGITUDE, 0) + 0.0 as LON_ROUND, count(*) as N_SITES
from sites group by 1, 2""")
def q_rounded_cells(spark: SparkSession, d: str) -> DataFrame:
    return geo.rounded_cells(match_sites(spark, d))


# -- scoring (rule score) and enrichment ---------------------------------------


_LEADS = O.with_(O.lead_ctes())


def _dbl(df: DataFrame, cols) -> DataFrame:
    """Integer columns that outer joins can leave null are returned as double
    (one null representation in every client)."""
    for c in cols:
        df = df.withColumn(c, F.col(c).cast("double"))
    return df


def _dbl_sql(inner: str, cols) -> str:
    rep = ", ".join(f"cast({c} as double) as {c}" for c in cols)
    return f"select * replace ({rep}) from ({inner})"
_DIMS = O.with_(O.lead_ctes(), O.dim_ctes())


@query("leads", _LEADS + "select * from leads")
def q_leads(spark: SparkSession, d: str) -> DataFrame:
    return flows.lead_table(spark, d)


@query("clean_names", _LEADS + "select * from leads")
def q_clean_names(spark: SparkSession, d: str) -> DataFrame:
    from leadspark.operators import cleanse
    return cleanse.clean_names(score.leads(flows.scored_rule(spark, d), P.LEAD_THRESHOLD_ALL))


@query("leads_master", _LEADS + "select * from fact order by lead_gen_prob asc nulls first")
def q_leads_master(spark: SparkSession, d: str) -> DataFrame:
    return flows.lead_fact(spark, d)


@query("install_inner", _DIMS + """select f.*, i.* from fact_sel f
  join install i on f.MDM_CUST_KEY is not distinct from i.ship_to_mdm_cust_key""")
def q_install_inner(spark: SparkSession, d: str) -> DataFrame:
    return _with_install(spark, d, "inner")


def _with_install(spark: SparkSession, d: str, how: str) -> DataFrame:
    """Lead list and install base, which covers only the leads' orders, lie together by customer."""
    from leadspark.operators.store import JOIN_KEY
    store = flows.lookup_store(spark, d)
    return store.join(store.table("leads"), "install", how).drop(JOIN_KEY)


@query("install_left", _DIMS + _dbl_sql("""select f.*, i.* from fact_sel f
  left join install i on f.MDM_CUST_KEY is not distinct from i.ship_to_mdm_cust_key""", ["INSTALL_LINES"]))
def q_install_left(spark: SparkSession, d: str) -> DataFrame:
    return _dbl(_with_install(spark, d, "left"), ["INSTALL_LINES"])


@query("lookup_first", _DIMS + _dbl_sql("""select f.MDM_CUST_KEY, f.lead_gen_prob, c.SLA_PRIORITY, c.SLA_VALUE,
  c.SLA_ORDER from fact f left join contracts1 c on f.MDM_CUST_KEY = c.BILL_MDM_KEY""", ["SLA_ORDER"]))
def q_lookup_first(spark: SparkSession, d: str) -> DataFrame:
    f = flows.lead_fact(spark, d).select(P.KEY, "lead_gen_prob")
    return _dbl(enrich.lookup(f, D.contracts(spark, d), P.KEY, "BILL_MDM_KEY", "left", prefilter=True,
                              drop=["BILL_MDM_KEY", "SLA_SKU"], dedupe_order="SLA_ORDER",
                              unique_order=True), ["SLA_ORDER"])


@query("zip3_territory", _DIMS + """select f.MDM_CUST_KEY, f.ADDR_ZIP, f.ZIP3, t.TERR_NATION, t.TERR_REP
  from (select MDM_CUST_KEY, ADDR_ZIP, substr(ADDR_ZIP, 1, 3) as ZIP3 from fact) f
  left join territory t on f.ZIP3 = t.TERR_ZIP3""")
def q_zip3_territory(spark: SparkSession, d: str) -> DataFrame:
    f = flows.lead_fact(spark, d).select(P.KEY, "ADDR_ZIP").withColumn("ZIP3", enrich.zip3("ADDR_ZIP"))
    return enrich.lookup(f, D.territory(spark, d), "ZIP3", "TERR_ZIP3", "left", drop=["TERR_ZIP3", "TERR_REGION"])


@query("null_safe_lookup", _DIMS + """select f.MDM_CUST_KEY, f.LAT_BAND, b.BAND_CUSTOMERS
  from (select MDM_CUST_KEY, round(ADDR_LATITUDE, 0) + 0.0 as LAT_BAND from fact) f
  left join (select round(ADDR_LATITUDE, 0) + 0.0 as BAND_KEY, count(*) as BAND_CUSTOMERS from master group by 1) b
  on f.LAT_BAND is not distinct from b.BAND_KEY""")
def q_null_safe_lookup(spark: SparkSession, d: str) -> DataFrame:
    band = F.round("ADDR_LATITUDE", 0) + F.lit(0.0)  # no negative zero
    f = flows.lead_fact(spark, d).select(P.KEY, band.alias("LAT_BAND"))
    bands = (flows.master(spark, d).groupBy(band.alias("BAND_KEY"))
             .agg(F.count(F.lit(1)).alias("BAND_CUSTOMERS")))
    return enrich.lookup(f, bands, "LAT_BAND", "BAND_KEY", "left", null_safe=True)


_STAR_INTS = ["INSTALL_LINES", "IDB_SIGNUPS"]


@query("star_aged", _DIMS.rstrip() + ",\n" + O.star_totals_sql("inner") + "\n" + _dbl_sql("select * from s9", _STAR_INTS))
def q_star_aged(spark: SparkSession, d: str) -> DataFrame:
    return _dbl(flows.star_list(spark, d, "inner", totals=True), _STAR_INTS)


@query("star_prospect", _DIMS.rstrip() + ",\n" + O.star_totals_sql("left") + "\n" + _dbl_sql("select * from s9", _STAR_INTS))
def q_star_prospect(spark: SparkSession, d: str) -> DataFrame:
    return _dbl(flows.star_list(spark, d, "left", totals=True), _STAR_INTS)


@query("implant_full_merge", O.with_(O.MASTER, O.USERS) + _dbl_sql("select * from users", ["IMPLANT_QTY"]))
def q_implant_full_merge(spark: SparkSession, d: str) -> DataFrame:
    return _dbl(flows.implant_users(spark, d), ["IMPLANT_QTY"])


@query("implant_list", O.with_(O.MASTER, O.DEALER, O.dim_ctes(), O.USERS) + _dbl_sql("""
select u.USER_KEY, u.CUSTOMER_NAME_x, u.CONT_FULLPHONE_x, u.STREET_x, u.CITY_x, u.STATE_x, u.ZIP_x, u.CONT_EMAIL_x,
       u.CUSTOMER_NAME_y, u.CONT_FULLPHONE_y, u.STREET_y, u.CITY_y, u.STATE_y, u.ZIP_y, u.CONT_EMAIL_y,
       u.IMPLANT_QTY, u.IMPLANT_USD, i.*
from users u left join install i on u.USER_KEY is not distinct from i.ship_to_mdm_cust_key""",
    ["IMPLANT_QTY", "INSTALL_LINES"]))
def q_implant_list(spark: SparkSession, d: str) -> DataFrame:
    return _dbl(flows.implant_list(spark, d), ["IMPLANT_QTY", "INSTALL_LINES"])


# -- split, oversampling, profiles, metrics ----------------------------------------


_SPLIT = O.with_(O.split_ctes())
_OVER = O.with_(O.split_ctes(), O.oversample_ctes())


def split_table(spark: SparkSession, d: str) -> DataFrame:
    return sampling.assign_split(flows.scored_rule(spark, d), P.KEY, P.SPLIT_WEIGHTS, P.SEED)


def train_oversampled(spark: SparkSession, d: str) -> DataFrame:
    tr = split_table(spark, d).filter(F.col("split") == "train").drop("split", "lead_gen_prob")
    return sampling.oversample(tr, P.LABEL, P.KEY, P.SEED)


def test_part(spark: SparkSession, d: str) -> DataFrame:
    return split_table(spark, d).filter(F.col("split") == "test").drop("split")


@query("hash_split", _SPLIT + "select * from split")
def q_hash_split(spark: SparkSession, d: str) -> DataFrame:
    return split_table(spark, d)


@query("oversample", _OVER + "select * from over")
def q_oversample(spark: SparkSession, d: str) -> DataFrame:
    return train_oversampled(spark, d)


@query("class_counts", _OVER + f"""
select 'all' as stage, {P.LABEL}, count(*) as n from split group by {P.LABEL}
union all select split, {P.LABEL}, count(*) from split group by split, {P.LABEL}
union all select 'oversampled', {P.LABEL}, count(*) from over group by {P.LABEL}""")
def q_class_counts(spark: SparkSession, d: str) -> DataFrame:
    stages = F.explode(F.array(F.lit("all"), F.col("split")))
    n = F.count(F.lit(1)).alias("n")
    parts = split_table(spark, d).select(stages.alias("stage"), P.LABEL).groupBy("stage", P.LABEL).agg(n)
    over = profile.class_counts(train_oversampled(spark, d), P.LABEL)
    return parts.unionByName(over.select(F.lit("oversampled").alias("stage"), P.LABEL, "n"))


@query("target_histogram", O.with_(O.feature_ctes()).rstrip() + f""",
mm as (select min({P.TARGET_OUT}) as mn, max({P.TARGET_OUT}) as mx from ft),
hb as (select cast(least(coalesce(floor(({P.TARGET_OUT} - mn) / nullif(mx - mn, 0) * 20), 0), 19) as integer) as bin
       from ft, mm)
select bin, mn + bin * ((mx - mn) / 20.0) as lo, mn + (bin + 1) * ((mx - mn) / 20.0) as hi, count(*) as n
from hb, mm group by bin, mn, mx""")
def q_target_histogram(spark: SparkSession, d: str) -> DataFrame:
    return profile.histogram(flows.feature_table(spark, d), P.TARGET_OUT, 20)


# every feature of the lead table, under its cleaned name
LEAD_FEATURES = [O._clean(c) for c in flows.feature_columns()]


def _box_sql() -> str:
    parts = []
    for c in LEAD_FEATURES:
        parts.append(f"""select '{c}' as feature, round(q1, 6) as q1, round(median, 6) as median, round(q3, 6) as q3,
  min(case when v >= q1 - 1.5 * (q3 - q1) and v <= q3 + 1.5 * (q3 - q1) then v end) as lower_whisker,
  max(case when v >= q1 - 1.5 * (q3 - q1) and v <= q3 + 1.5 * (q3 - q1) then v end) as upper_whisker,
  cast(sum(case when v >= q1 - 1.5 * (q3 - q1) and v <= q3 + 1.5 * (q3 - q1) then 0 else 1 end) as bigint) as n_outliers
from (select cast({c} as double) as v from leads where {c} is not null) x,
     (select quantile_cont(cast({c} as double), 0.25) as q1, quantile_cont(cast({c} as double), 0.5) as median,
             quantile_cont(cast({c} as double), 0.75) as q3 from leads) q
group by q1, median, q3""")
    return _LEADS + "\nunion all\n".join(parts)


@query("box_stats", _box_sql())
def q_box_stats(spark: SparkSession, d: str) -> DataFrame:
    b = profile.box_stats(flows.lead_table(spark, d), LEAD_FEATURES)
    return b.withColumns({c: F.round(c, 6) for c in ("q1", "median", "q3")})


def _summary_sql() -> str:
    parts = []
    for c in LEAD_FEATURES:
        v = f"cast({c} as double)"
        parts.append(f"""select '{c}' as feature, count({v}) as count,
  cast(sum(case when {v} is null then 1 else 0 end) as bigint) as nulls, round(avg({v}), 6) as mean,
  round(stddev_samp({v}), 6) as stddev, min({v}) as min, max({v}) as max,
  cast(sum(case when {v} = 0 then 1 else 0 end) as bigint) as zeros from leads""")
    return _LEADS + "\nunion all\n".join(parts)


@query("column_summary", _summary_sql())
def q_column_summary(spark: SparkSession, d: str) -> DataFrame:
    s = profile.summarize(flows.lead_table(spark, d), LEAD_FEATURES)
    return s.withColumn("mean", F.round("mean", 6)).withColumn("stddev", F.round("stddev", 6))


@query("lead_count", _SPLIT + f"""select count(*) as n_leads from split
  where split = 'test' and {P.LABEL} = 0 and lead_gen_prob > {P.LEAD_THRESHOLD_TEST}""")
def q_lead_count(spark: SparkSession, d: str) -> DataFrame:
    return score.leads(test_part(spark, d), P.LEAD_THRESHOLD_TEST).agg(F.count(F.lit(1)).alias("n_leads"))


@query("buyers", _SPLIT + f"select * exclude (split) from split where split = 'test' and {P.LABEL} = 1")
def q_buyers(spark: SparkSession, d: str) -> DataFrame:
    return score.buyers(test_part(spark, d), P.LABEL)


def _rule_pred(t: float):
    return F.when(F.col("lead_gen_prob") > t, 1.0).otherwise(0.0)


@query("metrics", _SPLIT + "select * from " + O.metric_sql("case when lead_gen_prob > 0.5 then 1.0 else 0.0 end"))
def q_metrics(spark: SparkSession, d: str) -> DataFrame:
    t = test_part(spark, d).withColumn("prediction", _rule_pred(0.5))
    return evaluate.metrics(t, P.LABEL, "prediction")


@query("auc", _SPLIT.rstrip() + f""",
g as (select lead_gen_prob as s, sum(case when {P.LABEL} = 1 then 1 else 0 end) as pos,
               sum(case when {P.LABEL} = 1 then 0 else 1 end) as neg
        from split where split = 'test' and lead_gen_prob is not null group by lead_gen_prob),
c as (select *, coalesce(sum(neg) over (order by s rows between unbounded preceding and 1 preceding), 0) as below
      from g)
select round(case when sum(pos) > 0 and sum(neg) > 0
                  then sum(pos * (below + 0.5 * neg)) / (cast(sum(pos) as double) * sum(neg)) end, 12) as auc,
       cast(sum(pos) as bigint) as n_pos, cast(sum(neg) as bigint) as n_neg from c""")
def q_auc(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.auc(test_part(spark, d), P.LABEL, "lead_gen_prob")


@query("auc_pr", _SPLIT.rstrip() + f""",
g as (select lead_gen_prob as s, sum(case when {P.LABEL} = 1 then 1 else 0 end) as pos,
             sum(case when {P.LABEL} = 1 then 0 else 1 end) as neg
      from split where split = 'test' and lead_gen_prob is not null group by lead_gen_prob),
c as (select sum(pos) over (order by s desc rows between unbounded preceding and current row) as tp,
             sum(neg) over (order by s desc rows between unbounded preceding and current row) as fp,
             row_number() over (order by s desc) - 1 as i from g),
tot as (select sum(pos) as PP from g),
pts as (select i, tp / nullif(PP, 0) as r, tp / (tp + fp) as p from c, tot),
seg as (select a.r, a.p, coalesce(b.r, 0.0) as r0, coalesce(b.p, f.p) as p0
        from pts a left join pts b on b.i = a.i - 1, (select p from pts where i = 0) f)
select round(case when (select PP from tot) > 0 then sum((r - r0) * (p + p0) / 2.0) end, 12) as auc_pr from seg""")
def q_auc_pr(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.auc_pr(test_part(spark, d), P.LABEL, "lead_gen_prob")


_RUN_THRESHOLDS = [0.25, 0.5, 0.75]


def runs(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of the rule at each threshold, in one aggregation over the test set."""
    th = F.array(*[F.struct(F.lit(i).alias("run"), F.lit(t).alias("threshold")) for i, t in enumerate(_RUN_THRESHOLDS)])
    t = test_part(spark, d).select(P.LABEL, "lead_gen_prob", F.explode(th).alias("_t"))
    t = t.withColumn("prediction", F.when(F.col("lead_gen_prob") > F.col("_t.threshold"), 1.0).otherwise(0.0))
    m = evaluate.metrics(t.withColumn("run", F.col("_t.run")), P.LABEL, "prediction", by="run")
    return m.withColumn("threshold", F.element_at(F.array(*map(F.lit, _RUN_THRESHOLDS)), F.col("run") + 1))


def _runs_sql() -> str:
    parts = [f"select {i} as run, {th} as threshold, * from "
             + O.metric_sql(f"case when lead_gen_prob > {th} then 1.0 else 0.0 end")
             for i, th in enumerate(_RUN_THRESHOLDS)]
    return _SPLIT + "select * from (" + " union all ".join(parts) + ") order by f1 desc, run limit 1"


@query("best_run", _runs_sql())
def q_best_run(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.best_run(runs(spark, d), "f1", "run")
