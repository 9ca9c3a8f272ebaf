"""Model flows on the feature table: split, balance, grid search, scoring.

Fitted models are kept per state of the data folder inside one session (see
``session.memo``), so the queries that look at the same boosted-tree search
(scores, importances, description, round trip) fit it once.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadspark.operators import ml, sampling, score
from leadspark.plans import flows
from leadspark.plans import params as P
from leadspark.session import memo as _memo
from leadspark.session import scratch_path


def data(spark: SparkSession, d: str):
    """(balanced train with fold ids, test, all customers), each written once."""
    def build():
        ft = sampling.assign_split(flows.feature_table(spark, d), P.KEY, P.SPLIT_WEIGHTS, P.SEED)
        ft = ml.freeze(ft)
        train = sampling.oversample(ft.filter(F.col("split") == "train").drop("split"), P.LABEL, P.KEY, P.SEED)
        train = ml.freeze(ml.with_fold(train, P.KEY, P.FOLDS, P.SEED))
        test = ft.filter(F.col("split") == "test").drop("split")
        return train, test, ft.drop("split")
    return _memo(spark, d, "data", build)


def gbt_model(spark: SparkSession, d: str):
    def build():
        train, _, _ = data(spark, d)
        g = ml.gbt(P.LABEL)
        pipe = ml.pipeline(*ml.zero_as_missing(train, flows.feature_columns(), P.LABEL), g)
        grid = ml.grid([(g.maxDepth, P.GBT_GRID["maxDepth"]), (g.maxIter, P.GBT_GRID["maxIter"])])
        return ml.grid_search(pipe, grid, "f1", P.LABEL, folds=P.FOLDS, seed=P.SEED).fit(train).bestModel
    return _memo(spark, d, "gbt", build)


def mlp_model(spark: SparkSession, d: str):
    def build():
        train, _, _ = data(spark, d)
        cols = flows.feature_columns()
        return ml.pipeline(ml.assembler(cols), ml.mlp(len(cols), 10, P.LABEL)).fit(train)
    return _memo(spark, d, "mlp", build)


def tree_model(spark: SparkSession, d: str):
    def build():
        train, _, _ = data(spark, d)
        return ml.pipeline(ml.assembler(flows.feature_columns()), ml.tree(P.LABEL),
                           ml.threshold_stage()).fit(train)
    return _memo(spark, d, "tree", build)


def forest_model(spark: SparkSession, d: str):
    def build():
        train, _, _ = data(spark, d)
        rf = ml.forest(P.LABEL)
        pipe = ml.pipeline(ml.assembler(flows.feature_columns()), rf, ml.threshold_stage())
        grid = ml.grid([(rf.maxDepth, P.FOREST_GRID["maxDepth"]), (rf.numTrees, P.FOREST_GRID["numTrees"])])
        return ml.grid_search(pipe, grid, "f1", P.LABEL, prediction="pred01", folds=P.FOLDS,
                              seed=P.SEED).fit(train).bestModel
    return _memo(spark, d, "forest", build)


def scored(model, df: DataFrame) -> DataFrame:
    return score.with_probability(score.predict(model, df))


def gbt_leads(spark: SparkSession, d: str, threshold: float = P.LEAD_THRESHOLD_ALL) -> DataFrame:
    """Score every customer with the chosen model and keep the leads."""
    _, _, allc = data(spark, d)
    s = scored(gbt_model(spark, d), allc).drop("features", "rawPrediction", "probability")
    return flows.lead_table(spark, d, scored=s, threshold=threshold)


def model_path(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, f"models/{name}-{uuid.uuid4().hex[:8]}")
