"""Registered queries: name -> (spark, data_dir) -> DataFrame, plus the DuckDB
oracle text for those that have one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadspark.functions.exprs import col_of
from leadspark.operators import cleanse, features, profile
from leadspark.plans import flows
from leadspark.plans import oracle as O
from leadspark.plans import params as P

_QUERIES: dict = {}
_ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLE[name] = sql
        return fn
    return deco


def _register_all() -> None:
    # imported for their registrations
    from leadspark.plans import catalog_ml, catalog_more  # noqa: F401


def queries() -> dict:
    _register_all()
    return dict(_QUERIES)


def oracle_sql() -> dict:
    _register_all()
    return dict(_ORACLE)


def _sales_out(df: DataFrame) -> DataFrame:
    return df.withColumn("SALES", F.round(F.col("SALES").cast("double"), 4))


# -- sources, projections, filters, aggregation ------------------------------

@query("sales_match", O.with_(O.sales_ctes(P.MATCH)) + f"select {O.SALES_COLS} from sales")
def q_sales_match(spark: SparkSession, d: str) -> DataFrame:
    return _sales_out(flows.unified_sales(spark, d, P.MATCH))


@query("sales_features", O.with_(O.sales_ctes(P.FEATURES)) + f"select {O.SALES_COLS} from sales")
def q_sales_features(spark: SparkSession, d: str) -> DataFrame:
    return _sales_out(flows.unified_sales(spark, d, P.FEATURES))


@query("sales_of_years", O.with_(O.sales_ctes(P.FEATURES))
       + f"select {O.SALES_COLS} from sales where YYYY in ({', '.join(map(str, P.REPORT_YEARS))})")
def q_sales_of_years(spark: SparkSession, d: str) -> DataFrame:
    """Some years' sales, from the folders of these years alone."""
    return _sales_out(flows.sales_fact(spark, d, P.REPORT_YEARS))


@query("sales_master_join",
       O.with_(O.MASTER, O.DIRECT, O.channel_b(P.FEATURES)) + f"select {O.SALES_COLS} from ch_b")
def q_sales_master_join(spark: SparkSession, d: str) -> DataFrame:
    from leadspark.operators import unify
    from leadspark.sources import tables
    return _sales_out(unify.direct_channel(flows.direct_view(spark, d), tables.customer_master(spark, d),
                                           P.FEATURES))


@query("keep_positive", O.with_(O.sales_ctes(P.FEATURES))
       + f"select {O.SALES_COLS} from sales where MDM_CUST_KEY is not null and SALES > 0")
def q_keep_positive(spark: SparkSession, d: str) -> DataFrame:
    return _sales_out(flows.positive_sales(spark, d))


@query("empty_key_audit", O.with_(O.sales_ctes(P.FEATURES))
       + f"select {O.SALES_COLS} from sales where MDM_CUST_KEY = ''")
def q_empty_key_audit(spark: SparkSession, d: str) -> DataFrame:
    return _sales_out(cleanse.empty_key_audit(flows.unified_sales(spark, d, P.FEATURES)))


def _pivot_sql() -> str:
    piv = ", ".join(
        f"round(cast(sum(SALES) filter (where cat = {O._q(v)}) as double), 4) as {O._ident(v)}"
        for v in P.PIVOT_VALUES)
    return (O.with_(O.sales_ctes(P.FEATURES))
            + f"select MDM_CUST_KEY, {piv} from (select MDM_CUST_KEY, L1_DESC || ' ' || L2_DESC as cat, SALES "
              "from sales where MDM_CUST_KEY is not null and SALES > 0) group by MDM_CUST_KEY")


@query("category_pivot", _pivot_sql())
def q_category_pivot(spark: SparkSession, d: str) -> DataFrame:
    wide = flows.category_pivot(spark, d)
    for v in P.PIVOT_VALUES:
        wide = wide.withColumn(v, F.round(col_of(v).cast("double"), 4))
    return wide


@query("feature_table", O.with_(O.feature_ctes()) + "select * from ft")
def q_feature_table(spark: SparkSession, d: str) -> DataFrame:
    # the feature build itself: always run, and the result is what later steps read
    return flows.feature_table(spark, d, fresh=True)


def _iqr_spark(spark: SparkSession, d: str) -> DataFrame:
    wide = flows.category_pivot(spark, d)
    t = P.TARGET_CATEGORY
    wide = wide.withColumn(t, F.round(col_of(t).cast("double"), 4))
    wide = features.floor_to_zero(wide, t, P.TARGET_THRESHOLD, out="_tfloor")
    wide = cleanse.exclude_key(wide, P.KEY, P.UNMATCHED_KEY)
    return features.iqr_upper(wide, "_tfloor", F.col("_tfloor") >= P.TARGET_THRESHOLD, P.WHISKER_K)


@query("iqr_cap", O.with_(O.feature_ctes()) + "select q1, q3, upper from wh")
def q_iqr_cap(spark: SparkSession, d: str) -> DataFrame:
    return _iqr_spark(spark, d)


def _log_sql() -> str:
    cols = ", ".join(f"round(case when {O._ident(c)} > 0 then ln({O._ident(c)}) end, 6) as {O._ident(c)}"
                     for c in flows.feature_columns())
    return O.with_(O.feature_ctes()) + f"select MDM_CUST_KEY, {cols} from ft"


@query("log_features", _log_sql())
def q_log_features(spark: SparkSession, d: str) -> DataFrame:
    cols = flows.feature_columns()
    ft = features.log_columns(flows.feature_table(spark, d), cols, cast="double")
    return ft.select(P.KEY, *[F.round(col_of(c), 6).alias(c) for c in cols])


def _total_sql() -> str:
    tot = " + ".join(O._ident(c) for c in flows.feature_columns())
    return f"round({tot}, 4)"


@query("top_prospects", O.with_(O.feature_ctes())
       + f"select *, {_total_sql()} as TOTAL_SALES from ft where {P.LABEL} = 0")
def q_top_prospects(spark: SparkSession, d: str) -> DataFrame:
    return flows.top_prospects(spark, d)


@query("preview", O.with_(O.feature_ctes())
       + f"select *, {_total_sql()} as TOTAL_SALES from ft where {P.LABEL} = 0 "
         f"order by TOTAL_SALES desc, MDM_CUST_KEY limit 10")
def q_preview(spark: SparkSession, d: str) -> DataFrame:
    return profile.preview(flows.top_prospects(spark, d), 10,
                           [F.desc("TOTAL_SALES"), F.asc(P.KEY)])
