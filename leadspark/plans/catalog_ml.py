"""Registered model queries (rows-only checks: no SQL twin for a fitted model)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadspark.functions.exprs import col_of
from leadspark.operators import enrich, evaluate, importance, ml, score
from leadspark.plans import derived as D
from leadspark.plans import flows, models
from leadspark.plans import oracle as O
from leadspark.plans import params as P
from leadspark.plans.catalog import query
from leadspark.session import freeze, scratch_path
from leadspark.sources import files
from leadspark.operators.attach import attach_row


FAMILIES = [  # name, fitted model, column of the class, column of the score
    ("gbt", models.gbt_model, "prediction", "lead_gen_prob"), ("mlp", models.mlp_model, "prediction", "lead_gen_prob"),
    ("tree", models.tree_model, "pred01", "prediction"), ("forest", models.forest_model, "pred01", "prediction"),
]
_TEST = O.with_(O.split_ctes())
_LEADS = O.with_(O.lead_ctes())


def _test_scores(model, spark: SparkSession, d: str, prob: bool = True) -> DataFrame:
    _, test, _ = models.data(spark, d)
    p = score.predict(model, test)
    if prob:
        p = score.with_probability(p)
    return p


@query("gbt_scores")
def q_gbt_scores(spark: SparkSession, d: str) -> DataFrame:
    """Boosted trees chosen by 3-fold grid search, all customers scored, leads kept."""
    return models.gbt_leads(spark, d)


@query("mlp_scores")
def q_mlp_scores(spark: SparkSession, d: str) -> DataFrame:
    p = _test_scores(models.mlp_model(spark, d), spark, d)
    return p.select(P.KEY, P.LABEL, "prediction", "lead_gen_prob")


@query("tree_scores")
def q_tree_scores(spark: SparkSession, d: str) -> DataFrame:
    p = _test_scores(models.tree_model(spark, d), spark, d, prob=False)
    return p.select(P.KEY, P.LABEL, "prediction", "pred01")


@query("forest_scores")
def q_forest_scores(spark: SparkSession, d: str) -> DataFrame:
    p = _test_scores(models.forest_model(spark, d), spark, d, prob=False)
    return p.select(P.KEY, P.LABEL, "prediction", "pred01")


@query("tree_importance")
def q_tree_importance(spark: SparkSession, d: str) -> DataFrame:
    return importance.trees(spark, models.tree_model(spark, d), flows.feature_columns()) \
        .orderBy(F.desc("importance"), F.asc("idx"))


def _gbt_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Splits of the boosted trees, written once for the queries that read them."""
    def build():
        return freeze(importance.nodes(spark, models.gbt_model(spark, d), models.data(spark, d)[0]), "gbt_nodes")
    return models._memo(spark, d, "gbt_nodes", build)


@query("tree_nodes")
def q_tree_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Every split of the boosted trees with its feature, gain and training rows."""
    return _gbt_nodes(spark, d).join(F.broadcast(importance.names_frame(spark, flows.feature_columns())), "idx")


@query("gain_importance")
def q_gain_importance(spark: SparkSession, d: str) -> DataFrame:
    return importance.gain(_gbt_nodes(spark, d), flows.feature_columns())


@query("split_count_importance")
def q_split_count_importance(spark: SparkSession, d: str) -> DataFrame:
    return importance.weight(_gbt_nodes(spark, d), flows.feature_columns())


@query("permutation_importance")
def q_permutation_importance(spark: SparkSession, d: str) -> DataFrame:
    _, test, _ = models.data(spark, d)

    def metric(pred, by):
        a = evaluate.auc(score.with_probability(pred), P.LABEL, "lead_gen_prob", by=by)
        return a.select(by, F.col("auc").alias("m"))
    return importance.permutation(spark, models.mlp_model(spark, d), test, flows.feature_columns(), P.KEY,
                                  metric, P.SEED)


@query("top_features")
def q_top_features(spark: SparkSession, d: str) -> DataFrame:
    """Top features of the boosted trees by number of splits (ties: input order)."""
    imp = importance.weight(_gbt_nodes(spark, d), flows.feature_columns())
    return importance.top(imp, P.TOP_FEATURES)


@query("model_description")
def q_model_description(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for name, m in (("gbt", models.gbt_model(spark, d)), ("mlp", models.mlp_model(spark, d)),
                    ("tree", models.tree_model(spark, d)), ("forest", models.forest_model(spark, d))):
        part = ml.describe(spark, m if name != "tree" and name != "forest" else _last_model(m))
        part = part.select(F.lit(name).alias("model_name"), "key", "value")
        out = part if out is None else out.unionByName(part)
    return out


def _last_model(pm):
    return next(s for s in reversed(pm.stages) if hasattr(s, "featureImportances"))


@query("run_log")
def q_run_log(spark: SparkSession, d: str) -> DataFrame:
    path = models.model_path(spark, "runlog")
    params = {"label": P.LABEL, "features": ",".join(flows.feature_columns())}
    log = None
    for i, (name, build, pcol, scol) in enumerate(FAMILIES):
        model = build(spark, d)
        pred = _test_scores(model, spark, d, prob=scol == "lead_gen_prob")
        m = attach_row(evaluate.metrics(pred, P.LABEL, pcol), evaluate.auc(pred, P.LABEL, scol).select("auc"))
        log = ml.log_run(spark, path, f"run{i}", name, params, m, ml.save(model, models.model_path(spark, name)))
    return log


def _logged(spark: SparkSession, d: str) -> DataFrame:
    return models._memo(spark, d, "run_log", lambda: q_run_log(spark, d))


@query("run_log_params", f"""select 'run' || i as run_id, name as run_name, p as name, v as value from
  (values (0, 'gbt'), (1, 'mlp'), (2, 'tree'), (3, 'forest')) r(i, name),
  (values ('label', '{P.LABEL}'), ('features', '{",".join(flows.feature_columns())}')) q(p, v)""")
def q_run_log_params(spark: SparkSession, d: str) -> DataFrame:
    return _logged(spark, d).filter(F.col("kind") == "param").select("run_id", "run_name", "name", "value")


@query("best_logged_run", _TEST + f"select MDM_CUST_KEY, {P.LABEL}, true as scored from split where split = 'test'")
def q_best_logged_run(spark: SparkSession, d: str) -> DataFrame:
    """The model of the logged run with the best AUC, loaded by its run id, scores the test set."""
    log = _logged(spark, d)
    best = evaluate.best_run(log.filter((F.col("kind") == "metric") & (F.col("name") == "auc"))
                             .withColumn("value", F.col("value").cast("double")), "value", "run_id").first()
    model = ml.load(log.filter(F.col("run_id") == best["run_id"]).first()["model_path"])
    _, test, _ = models.data(spark, d)
    return model.transform(test).select(P.KEY, P.LABEL, F.col("prediction").isNotNull().alias("scored"))


@query("score_ranges", _TEST + f"""select m.model, MDM_CUST_KEY, {P.LABEL}, true as in_range from split,
  (values ('gbt'), ('mlp'), ('tree'), ('forest')) m(model) where split = 'test'""")
def q_score_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Test set scored by each model family: is every score a probability?"""
    out = None
    for name, build, _, scol in FAMILIES:
        p = _test_scores(build(spark, d), spark, d, prob=scol == "lead_gen_prob")
        p = p.select(F.lit(name).alias("model"), P.KEY, P.LABEL,
                     ((F.col(scol) >= -1e-9) & (F.col(scol) <= 1 + 1e-9)).alias("in_range"))
        out = p if out is None else out.unionByName(p)
    return out


_PERMUTED = flows.feature_columns()[0]


@query("permuted_feature", _TEST + f"""select a.MDM_CUST_KEY, b.v as permuted from
  (select MDM_CUST_KEY, row_number() over (order by MDM_CUST_KEY) as i from split where split = 'test') a
  join (select {O._ident(_PERMUTED)} as v, row_number() over (order by
        {O.md5_int(f"MDM_CUST_KEY || ':' || '{P.SEED}' || ':' || '{_PERMUTED}'")}, MDM_CUST_KEY) as i
        from split where split = 'test') b using (i)""")
def q_permuted_feature(spark: SparkSession, d: str) -> DataFrame:
    """One feature of the test set moved between customers by the seeded permutation."""
    _, test, _ = models.data(spark, d)
    return importance.permute_column(test, _PERMUTED, P.KEY, P.SEED).select(
        P.KEY, F.col(f"`{_PERMUTED}`").alias("permuted"))


@query("model_roundtrip", _TEST + "select MDM_CUST_KEY, true as same from split where split = 'test'")
def q_model_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    m = models.gbt_model(spark, d)
    path = ml.save(m, models.model_path(spark, "gbt"))
    back = ml.load(path)
    _, test, _ = models.data(spark, d)
    a = score.with_probability(m.transform(test)).select(P.KEY, F.col("lead_gen_prob").alias("p_saved"))
    b = score.with_probability(back.transform(test)).select(P.KEY, F.col("lead_gen_prob").alias("p_loaded"))
    return a.join(b, P.KEY).select(P.KEY, (F.col("p_saved") == F.col("p_loaded")).alias("same"))


@query("table_roundtrip", _LEADS + "select * from leads")
def q_table_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, f"tables/leads-{models.uuid.uuid4().hex[:8]}")
    files.save_table(flows.lead_table(spark, d), path)
    return spark.read.parquet(path)


@query("catalog_table", _LEADS + "select * from leads")
def q_catalog_table(spark: SparkSession, d: str) -> DataFrame:
    """The lead table saved as a catalog table, overwritten, and read back by name."""
    name = f"leads_{models.uuid.uuid4().hex}"
    lt = flows.lead_table(spark, d)
    files.save_table(lt.limit(1), name, as_table=True)
    files.save_table(lt, name, as_table=True)
    return spark.table(name)


def _csv_back(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(spark, f"csv/{name}-{models.uuid.uuid4().hex[:8]}")
    files.export_csv(df, path)
    return files.read_lookup_csv(spark, path, T.StructType([T.StructField(f.name, f.dataType) for f in df.schema]))


@query("territory_from_csv", O.with_(O.lead_ctes(), O.dim_ctes()) + """
  select f.MDM_CUST_KEY, f.ADDR_ZIP, f.ZIP3, t.TERR_NATION, t.TERR_REP
  from (select MDM_CUST_KEY, ADDR_ZIP, substr(ADDR_ZIP, 1, 3) as ZIP3 from fact) f
  left join territory t on f.ZIP3 = t.TERR_ZIP3""")
def q_territory_from_csv(spark: SparkSession, d: str) -> DataFrame:
    """The territory lookup read from a CSV file with a stated schema, so ZIP prefixes keep their zeros."""
    f = flows.lead_fact(spark, d).select(P.KEY, "ADDR_ZIP").withColumn("ZIP3", enrich.zip3("ADDR_ZIP"))
    return enrich.lookup(f, _csv_back(spark, D.territory(spark, d), "territory"), "ZIP3", "TERR_ZIP3", "left",
                         drop=["TERR_ZIP3", "TERR_REGION"])


def _from_file(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """A lookup as it arrives: a CSV file read with a stated schema, malformed records set aside."""
    path = scratch_path(spark, f"csv/{name}-{models.uuid.uuid4().hex[:8]}")
    files.export_csv(df, path)
    return files.read_lookup(spark, path, df.schema, scratch_path(spark, "quarantine"), multiline=False, most_bad=0.01).rows


@query("star_from_files", O.with_(O.lead_ctes(), O.dim_ctes(), O.star_sql("left"))
       + "select * replace (cast(INSTALL_LINES as double) as INSTALL_LINES) from s7")
def q_star_from_files(spark: SparkSession, d: str) -> DataFrame:
    """The prospect list with all seven lookups read from CSV files, each deduplicated in file order and joined in turn."""
    Lookup, key = enrich.Lookup, P.KEY

    def file(name: str, df: DataFrame) -> DataFrame:
        return _from_file(spark, df, name)
    kept = [f"IMPL_{t.upper()}" for t in P.EVENT_TYPES if t not in P.IMPLANT_KINDS]
    looks = [
        Lookup(file("install", D.install_base(spark, d)), key, "ship_to_mdm_cust_key", drop=D.install_drop(), null_safe=True),
        Lookup(file("contracts", D.contracts(spark, d)), key, "BILL_MDM_KEY", drop=["BILL_MDM_KEY", "SLA_SKU", "SLA_ORDER"],
               dedupe_order="SLA_ORDER", unique_order=True, null_safe=True),
        Lookup(file("tech_calls", D.tech_calls(spark, d)), key, "MDM_ID", drop=["MDM_ID", "TECH_EVENT"],
               dedupe_order="TECH_EVENT", unique_order=True, null_safe=True),
        Lookup(file("external_ids", D.external_ids(spark, d)), key, "mdm_site_key", drop=["EXT_ROW", "mdm_site_key"],
               dedupe_order="EXT_ROW", unique_order=True, null_safe=True),
        Lookup(file("implants_a", D.implants_a(spark, d)), key, "IMPL_KEY", drop=["IMPL_KEY", "IMPL_ROW", *kept],
               dedupe_order="IMPL_ROW", unique_order=True, null_safe=True),
        Lookup(file("implants_b", D.implants_b(spark, d)), key, "IDB_KEY", drop=["IDB_KEY", "IDB_ROW"],
               dedupe_order="IDB_ROW", unique_order=True, null_safe=True),
        Lookup(file("territory", D.territory(spark, d)), "ZIP3", "TERR_ZIP3", drop=["TERR_ZIP3", "TERR_REGION"],
               null_safe=True, derive={"ZIP3": enrich.zip3("ADDR_ZIP")}),
    ]
    out = enrich.star(flows.fact_selection(spark, d), looks)
    return out.withColumn("INSTALL_LINES", F.col("INSTALL_LINES").cast("double"))


_AGED = [P.KEY, *P.CONTACT_COLS, "ADDR_LATITUDE", "ADDR_LONGITUDE", "lead_gen_prob", *P.FACT_FEATURES, "INSTALL_LINES",
         *flows.STAR_ORDERS, *flows.STAR_EVENTS, "ZIP3", "TERR_NATION", "TERR_REP"]
_IMPLANT = ["USER_KEY", *[c + s for s in ("_x", "_y") for c in D.USER_LIST_COLS], "IMPLANT_QTY", "IMPLANT_USD",
            "ship_to_mdm_cust_key", *[f"{t}_{s}" for t in P.INSTALL_TYPES for s in ("maxdate", "min")], "INSTALL_LINES"]
_EXPORTS = {"aged": _AGED, "prospect": _AGED, "implant": _IMPLANT}
_NUMBERS = {"ADDR_LATITUDE", "ADDR_LONGITUDE", "lead_gen_prob", *P.FACT_FEATURES, "INSTALL_LINES", "SLA_VALUE",
            "TECH_CALL_VALUE", *[f"IMPL_{t.upper()}" for t in P.IMPLANT_KINDS], "IDB_VALUE", "IMPLANT_QTY", "IMPLANT_USD"}


def _fields_sql(name: str, table: str) -> str:
    """Each field of a list as a row, and the empty contents of a column of empty strings."""
    key = _EXPORTS[name][0]
    rows = [f"select '{name}' as list, {key} as customer, '{c}' as field, "
            + (f"cast(null as varchar) as text, cast({c} as double) as number" if c in _NUMBERS
               else f"cast({c} as varchar) as text, cast(null as double) as number") + f" from {table}"
            for c in _EXPORTS[name]]
    return " union all ".join([*rows, f"select '{name}', {key}, '_empty', '', null from {table}"])


@query("list_exports", O.with_(O.lead_ctes(), O.dim_ctes(), O.star_sql("inner"), O.star_sql("left", "t"), O.USERS) + """,
  implant as (select u.*, i.* from users u left join install i on u.USER_KEY is not distinct from i.ship_to_mdm_cust_key)
  """ + " union all ".join(_fields_sql(n, t) for n, t in (("aged", "s7"), ("prospect", "t7"), ("implant", "implant"))))
def q_list_exports(spark: SparkSession, d: str) -> DataFrame:
    """The three flat lists exported as CSV and read back: every field of every row."""
    out = None
    for name, df in (("aged", flows.star_list(spark, d, "inner")), ("prospect", flows.star_list(spark, d, "left")),
                     ("implant", flows.implant_list(spark, d))):
        back = _csv_back(spark, df.withColumn("_empty", F.lit("")), name)
        fields = [F.struct(F.lit(c).alias("field"),
                           (F.lit(None) if c in _NUMBERS else col_of(c)).cast("string").alias("text"),
                           (col_of(c) if c in _NUMBERS else F.lit(None)).cast("double").alias("number"))
                  for c in [*_EXPORTS[name], "_empty"]]
        rows = back.select(F.lit(name).alias("list"), col_of(_EXPORTS[name][0]).alias("customer"),
                           F.inline(F.array(*fields)))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("csv_roundtrip", _LEADS + "select * from leads")
def q_csv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    lt = flows.lead_table(spark, d)
    path = scratch_path(spark, f"csv/leads-{models.uuid.uuid4().hex[:8]}")
    files.export_csv(lt, path)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in lt.schema.fields])
    return files.read_lookup_csv(spark, path, schema)


@query("lead_top_features")
def q_lead_top_features(spark: SparkSession, d: str) -> DataFrame:
    """Test-set leads above the high threshold, projected on the top features
    (long format: key, feature, value; the top-k list is a broadcast of k rows)."""
    _, test, _ = models.data(spark, d)
    leads = score.leads(score.with_probability(models.gbt_model(spark, d).transform(test)),
                        P.LEAD_THRESHOLD_TEST)
    cols = flows.feature_columns()
    stack = ", ".join(f"'{c}', `{c}`" for c in cols)
    long = leads.selectExpr(P.KEY, "lead_gen_prob", f"stack({len(cols)}, {stack}) as (feature, value)")
    top = importance.top(importance.weight(_gbt_nodes(spark, d), cols), P.TOP_FEATURES)
    return long.join(F.broadcast(top.select("feature", F.col("idx").alias("rank_idx"))), "feature")
