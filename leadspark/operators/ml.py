"""Model building on Spark ML: assembler, pipelines, the four model families,
cross-validated grid search, save/load, description and a run log.

Training data is written once to the checkpoint folder before a grid
search, so the 13 fits of a 2x2 grid with 3 folds read it instead of
re-running the feature plan, and a lost executor does not restart the
lineage from the raw tables.
"""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, MultilayerPerceptronClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.util import inheritable_thread_target

from leadspark.functions.exprs import col_of, md5_int
from leadspark.operators.features import check_feature_list
from leadspark.session import freeze as _freeze


def assembler(cols, out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=check_feature_list(cols), outputCol=out)


def zero_as_missing(train: DataFrame, cols, label: str = "label", out: str = "features") -> list:
    """Pipeline stages that assemble ``cols`` with zeros as missing values: each feature gives them a learned side.

    Where a zero says "nothing known" (no purchase in a category), it should not
    lie at the low end by its size.  Per feature, a zero is replaced by a value
    beyond all others, below or above them: on the side whose rows have labels
    more like those of the zeros, so a tree's split can send them there, or set
    them apart.  Sides and values come from one aggregation of ``train``; with no
    zeros, or no difference, they go below.  The stages are built-in ones that
    hold the fitted values, so the pipeline is saved and loaded as any other.
    """
    cols = check_feature_list(cols)
    y = col_of(label).cast("double")
    aggs = []
    for i, c in enumerate(cols):
        v = col_of(c).cast("double")
        there = F.when((v != 0) & ~F.isnan(v), v)
        aggs += [F.min(there).alias(f"lo{i}"), F.max(there).alias(f"hi{i}"), F.covar_pop(there, y).alias(f"slope{i}"),
                 F.avg(F.when(there.isNotNull(), y)).alias(f"there{i}"), F.avg(F.when(v == 0, y)).alias(f"zero{i}")]
    row = train.agg(*aggs).first()  # five numbers a feature
    fills = []
    for i, c in enumerate(cols):
        lo, hi, slope, there, zero = (row[f"{x}{i}"] for x in ("lo", "hi", "slope", "there", "zero"))
        above = zero is not None and there is not None and (zero - there) * (slope or 0.0) > 0
        value = 0.0 if lo is None else hi + 1 + abs(hi) if above else lo - 1 - abs(lo)
        name = c.replace("`", "``")
        fills.append(f"CASE WHEN `{name}` = 0 THEN CAST('{value!r}' AS DOUBLE) ELSE CAST(`{name}` AS DOUBLE) END AS `_in_{name}`")
    inputs = [f"_in_{c}" for c in cols]
    dropped = ", ".join(f"`{c.replace('`', '``')}`" for c in inputs)
    return [SQLTransformer(statement=f"SELECT *, {', '.join(fills)} FROM __THIS__"), assembler(inputs, out),
            SQLTransformer(statement=f"SELECT * EXCEPT ({dropped}) FROM __THIS__")]


def gbt(label: str = "label", features: str = "features", seed: int = 42, **kw) -> GBTClassifier:
    return GBTClassifier(labelCol=label, featuresCol=features, seed=seed, **kw)


def mlp(n_features: int, hidden: int = 10, label: str = "label", features: str = "features",
        seed: int = 42, **kw) -> MultilayerPerceptronClassifier:
    return MultilayerPerceptronClassifier(labelCol=label, featuresCol=features, seed=seed,
                                          layers=[n_features, hidden, 2], **kw)


def tree(label: str = "label", features: str = "features", max_bins: int = 40, seed: int = 42,
         **kw) -> DecisionTreeRegressor:
    return DecisionTreeRegressor(labelCol=label, featuresCol=features, maxBins=max_bins, seed=seed, **kw)


def forest(label: str = "label", features: str = "features", max_bins: int = 40, seed: int = 42,
           **kw) -> RandomForestRegressor:
    return RandomForestRegressor(labelCol=label, featuresCol=features, maxBins=max_bins, seed=seed, **kw)


def threshold_stage(score: str = "prediction", out: str = "pred01", cut: float = 0.5) -> SQLTransformer:
    """Turns a regressor's score into a 0/1 class, so accuracy/F1 are meaningful."""
    return SQLTransformer(statement=f"SELECT *, double({score} > {cut}) AS {out} FROM __THIS__")


def pipeline(*stages) -> Pipeline:
    return Pipeline(stages=list(stages))


def with_fold(df: DataFrame, key: str, folds: int = 3, seed: int = 42, out: str = "fold") -> DataFrame:
    """Fold id from the key: every copy of one customer lands in the same fold."""
    return df.withColumn(out, (md5_int(col_of(key), F.lit(str(seed)), F.lit("fold")) % folds).cast("int"))


def freeze(df: DataFrame) -> DataFrame:
    """Written table in the checkpoint folder: cuts lineage before iterative work."""
    return _freeze(df)


class FoldSearch(CrossValidator):
    """Spark's ``CrossValidator`` over a fold column, with the fits of all folds in one pool.

    A fold's longest fit is a chain of many short jobs, which leaves cores idle; fold after
    fold they add up.  The same fits with the same metrics; ``parallelism`` run at a time.
    """

    def _fit(self, dataset: DataFrame) -> CrossValidatorModel:
        est, maps, ev = self.getEstimator(), self.getEstimatorParamMaps(), self.getEvaluator()
        folds = [(train.persist(), rest.persist()) for train, rest in self._kFold(dataset)]

        def one(at):
            (train, rest), params = folds[at[0]], maps[at[1]]
            return ev.evaluate(est.copy().fit(train, params).transform(rest, params))
        try:
            with ThreadPool(self.getParallelism()) as pool:
                todo = [(i, j) for i in range(len(folds)) for j in range(len(maps))]
                found = pool.map(inheritable_thread_target(dataset.sparkSession)(one), todo, chunksize=1)
        finally:
            for train, rest in folds:
                train.unpersist()
                rest.unpersist()
        averages, deviations = self._gen_avg_and_std_metrics(
            [found[i:i + len(maps)] for i in range(0, len(found), len(maps))])
        best = int((np.argmax if ev.isLargerBetter() else np.argmin)(averages))
        return self._copyValues(CrossValidatorModel(est.fit(dataset, maps[best]), averages, [], deviations))


def grid_search(pipe: Pipeline, grid, metric: str = "f1", label: str = "label", prediction: str = "prediction",
                folds: int = 3, seed: int = 42, fold_col: str = "fold", parallelism: int = 6) -> CrossValidator:
    """k-fold grid search over rows whose fold is in ``fold_col`` (``with_fold``: copies of a customer share one).

    ``parallelism`` fits run at a time, of whatever fold; each holds its own copy of the
    tree input, so the number bounds executor memory.
    """
    ev = MulticlassClassificationEvaluator(labelCol=label, predictionCol=prediction, metricName=metric)
    return FoldSearch(estimator=pipe, estimatorParamMaps=grid, evaluator=ev, numFolds=folds, seed=seed,
                      foldCol=fold_col, parallelism=parallelism)


def grid(pairs) -> list:
    b = ParamGridBuilder()
    for param, values in pairs:
        b = b.addGrid(param, list(values))
    return b.build()


def save(model, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def describe(spark: SparkSession, model) -> DataFrame:
    """Key/value description of a fitted model (or the last stage of a pipeline)."""
    m = model.stages[-1] if isinstance(model, PipelineModel) else model
    rows = [("model", type(m).__name__)]
    for p, v in sorted(m.extractParamMap().items(), key=lambda kv: kv[0].name):
        rows.append((p.name, str(v)))
    if hasattr(m, "trees"):
        rows.append(("numTrees", str(len(m.trees))))
    if hasattr(m, "getLayers"):
        rows.append(("numLayers", str(len(m.getLayers()))))
    if hasattr(m, "depth"):
        rows.append(("depth", str(m.depth)))
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])
    return spark.createDataFrame(rows, schema)


RUN_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()), T.StructField("run_name", T.StringType()),
    T.StructField("kind", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("value", T.StringType()), T.StructField("model_path", T.StringType()),
])


def log_run(spark: SparkSession, path: str, run_id: str, run_name: str, params: dict, metrics: DataFrame,
            model_path: str | None = None) -> DataFrame:
    """Append a run (params + one row per metric) to a parquet run log; return the log."""
    prow = spark.createDataFrame([(run_id, run_name, "param", k, str(v), model_path) for k, v in params.items()],
                                 RUN_SCHEMA)
    mcols = [c for c in metrics.columns]
    stack = ", ".join(f"'{c}', cast(`{c}` as string)" for c in mcols)
    mrow = metrics.selectExpr(f"stack({len(mcols)}, {stack}) as (name, value)").select(
        F.lit(run_id).alias("run_id"), F.lit(run_name).alias("run_name"), F.lit("metric").alias("kind"),
        "name", "value", F.lit(model_path).cast("string").alias("model_path"))
    prow.unionByName(mrow).write.mode("append").parquet(path)
    return spark.read.parquet(path)
