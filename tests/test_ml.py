import os
import tempfile

import pytest
from pyspark.sql import functions as F

from leadspark.operators import evaluate, importance, ml, score


@pytest.fixture(scope="module")
def planted(spark):
    # label depends on x only; n is noise
    rows = []
    import random
    rnd = random.Random(11)
    for i in range(400):
        x, n = rnd.uniform(0, 10), rnd.uniform(0, 10)
        rows.append((f"k{i}", x, n, 1 if x > 6 else 0))
    return spark.createDataFrame(rows, "MDM_CUST_KEY string, x double, n double, label int")


def test_gbt_pipeline_scores_and_roundtrip(spark, planted):
    pipe = ml.pipeline(ml.assembler(["x", "n"]), ml.gbt(maxIter=10, maxDepth=3))
    model = pipe.fit(planted)
    pred = score.with_probability(model.transform(planted))
    auc = evaluate.auc(pred, "label", "lead_gen_prob").collect()[0].auc
    assert auc > 0.95
    path = os.path.join(tempfile.mkdtemp(prefix="leadspark-model-"), "m")
    back = ml.load(ml.save(model, path))
    again = score.with_probability(back.transform(planted)).select("MDM_CUST_KEY", F.col("lead_gen_prob").alias("q"))
    j = pred.select("MDM_CUST_KEY", "lead_gen_prob").join(again, "MDM_CUST_KEY")
    assert j.filter(F.col("lead_gen_prob") != F.col("q")).count() == 0
    # gain importance: the planted feature dominates; a loaded model has the same splits
    splits = importance.nodes(spark, model, planted)
    g = {r.feature: r.importance for r in importance.gain(splits, ["x", "n"]).collect()}
    assert g["x"] > g["n"]
    top = [r.feature for r in importance.top(importance.gain(splits, ["x", "n"]), 1).collect()]
    assert top == ["x"]
    rows = splits.collect()
    assert sorted(rows) == sorted(importance.nodes(spark, back, planted).collect())
    assert [r.n_rows for r in sorted(rows) if r.node == 0] == [400] * len({r.tree for r in rows})


def test_node_table_of_a_hand_computed_tree(spark):
    rows = [(x, 7.0, y) for x, y in ((0.0, 0.0), (1.0, 2.0), (2.0, 8.0))] * 2
    df = spark.createDataFrame(rows, "x double, c double, label double")
    model = ml.pipeline(ml.assembler(["x", "c"]), ml.tree(maxDepth=2)).fit(df)
    got = sorted(importance.nodes(spark, model, df).collect())
    # variance 104/9; split at 1 leaves 4 rows of variance 1; these split into pure leaves
    assert [(r.tree, r.node, r.idx, r.n_rows) for r in got] == [(0, 0, 0, 6), (0, 1, 0, 4)]
    assert [r.gain for r in got] == pytest.approx([98 / 9, 1.0])
    imp = {r.feature: (r.importance, r.splits) for r in importance.gain(
        importance.nodes(spark, model, df), ["x", "c"]).collect()}
    assert imp["x"] == (pytest.approx((98 / 9 * 6 + 4) / 2), 2) and imp["c"] == (0.0, 0)
    flat = ml.pipeline(ml.assembler(["x", "c"]), ml.tree(maxDepth=2)).fit(df.withColumn("label", F.lit(1.0)))
    assert importance.nodes(spark, flat, df).count() == 0


def test_cross_validation_with_key_folds(spark, planted):
    train = ml.with_fold(planted, "MDM_CUST_KEY", 3, 42)
    assert {r.fold for r in train.select("fold").distinct().collect()} <= {0, 1, 2}
    g = ml.gbt(maxIter=5)
    pipe = ml.pipeline(ml.assembler(["x", "n"]), g)
    cvm = ml.grid_search(pipe, ml.grid([(g.maxDepth, [2, 3])]), "f1", parallelism=2).fit(train)
    assert len(cvm.avgMetrics) == 2 and max(cvm.avgMetrics) > 0.9


def test_permutation_importance_planted(spark, planted):
    pipe = ml.pipeline(ml.assembler(["x", "n"]), ml.mlp(2, 5, maxIter=200))
    model = pipe.fit(planted)

    def metric(pred, by):
        a = evaluate.auc(score.with_probability(pred), "label", "lead_gen_prob", by=by)
        return a.select(by, F.col("auc").alias("m"))
    imp = {r.feature: r.importance for r in
           importance.permutation(spark, model, planted, ["x", "n"], "MDM_CUST_KEY", metric).collect()}
    assert imp["x"] > 0.2 and abs(imp["n"]) < 0.1


def test_permute_column_is_a_permutation(spark, planted):
    p = importance.permute_column(planted, "x", "MDM_CUST_KEY", 5)
    assert sorted(r.x for r in p.collect()) == sorted(r.x for r in planted.collect())
    moved = p.join(planted.select("MDM_CUST_KEY", F.col("x").alias("x0")), "MDM_CUST_KEY")
    assert moved.filter(F.col("x") != F.col("x0")).count() > 350


def test_regressors_threshold_and_describe(spark, planted):
    m = ml.pipeline(ml.assembler(["x", "n"]), ml.tree(), ml.threshold_stage()).fit(planted)
    pred = m.transform(planted)
    assert set(r.pred01 for r in pred.select("pred01").distinct().collect()) <= {0.0, 1.0}
    acc = evaluate.metrics(pred, "label", "pred01").collect()[0].accuracy
    assert acc > 0.95
    d = {r.key: r.value for r in ml.describe(spark, m.stages[1]).collect()}
    assert d["model"] == "DecisionTreeRegressionModel" and d["maxBins"] == "40"
    t = importance.trees(spark, m.stages[1], ["x", "n"]).collect()
    assert {r.feature for r in t} == {"x", "n"}


def test_run_log_appends(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="leadspark-runs-"), "log")
    m = spark.createDataFrame([(0.9, 0.8)], "auc double, f1 double")
    ml.log_run(spark, path, "r1", "a", {"label": "label"}, m)
    log = ml.log_run(spark, path, "r2", "b", {"label": "label"}, m)
    assert log.count() == 6
    assert {r.name for r in log.filter("kind = 'metric'").collect()} == {"auc", "f1"}


def _sparse(spark, zeros_are):
    """Positives have x above 5; of the zeros, all or none are positive."""
    import random
    rnd, rows = random.Random(4), []
    for i in range(300):
        x = 0.0 if i % 3 == 0 else rnd.uniform(1, 10)
        rows.append((f"k{i}", x, rnd.uniform(0, 1), zeros_are if x == 0 else int(x > 5)))
    return spark.createDataFrame(rows, "MDM_CUST_KEY string, `x y` double, n double, label int")


@pytest.mark.parametrize("zeros_are", [0, 1])
def test_zeros_go_to_the_learned_side(spark, zeros_are):
    df = _sparse(spark, zeros_are)
    one_split = ml.pipeline(*ml.zero_as_missing(df, ["x y", "n"]), ml.gbt(maxIter=1, maxDepth=1))
    model = one_split.fit(df)
    pred = model.transform(df)
    assert pred.columns == [*df.columns, "features", "rawPrediction", "probability", "prediction"]
    assert pred.filter("prediction != label").count() <= 300 / 32  # one split is right but for the rows of its bin
    side = pred.filter("`x y` = 0").select("features").first()[0][0]
    assert side > 10 if zeros_are else side < 1
    plain = ml.pipeline(ml.assembler(["x y", "n"]), ml.gbt(maxIter=1, maxDepth=1)).fit(df).transform(df)
    if zeros_are:
        assert plain.filter("prediction != label").count() >= 60
    back = ml.load(ml.save(model, os.path.join(tempfile.mkdtemp(prefix="leadspark-model-"), "m")))
    assert back.transform(df).select("prediction").collect() == pred.select("prediction").collect()


def test_zeros_where_nothing_is_known(spark):
    df = spark.createDataFrame([(0.0, 1.0, 0), (0.0, -2.0, 1)], "a double, b double, label int")
    stages = ml.zero_as_missing(df, ["a", "b"])
    new = spark.createDataFrame([(0.0, 0.0, 0), (3.0, 1.0, 1)], "a double, b double, label int")
    out = ml.pipeline(*stages).fit(df).transform(new).select("features").collect()
    assert [list(r[0]) for r in out] == [[0.0, -5.0], [3.0, 1.0]]


def test_fits_of_all_folds_run_at_once_and_choose_as_cross_validator_does(spark):
    import threading
    from pyspark.ml import Estimator, Transformer
    from pyspark.ml.tuning import CrossValidator
    rows = spark.createDataFrame([(f"k{i}", float(i % 7), float(i * 31 % 5), int(i % 7 > i % 3)) for i in range(90)],
                                 "k string, x double, y double, label int")
    train = ml.freeze(ml.with_fold(rows, "k", 3))
    both, seen = threading.Barrier(3), []

    class One(Transformer):
        def _transform(self, df):
            return df.withColumn("prediction", F.lit(1.0))

    class Waits(Estimator):
        def copy(self, extra=None):
            return self

        def _fit(self, df):
            seen.append(df)
            if len(seen) <= 3:  # a fit of each fold; the fourth is that of all rows
                both.wait(60)
            return One()
    ml.grid_search(Waits(), [{}]).fit(train)
    assert len(seen) == 4

    def search():
        t = ml.tree("label", max_bins=40)
        pipe = ml.pipeline(ml.assembler(["x", "y"]), t, ml.threshold_stage())
        return ml.grid_search(pipe, ml.grid([(t.maxDepth, [1, 2, 4])]), "f1", "label", prediction="pred01")
    mine = search().fit(train)
    theirs = CrossValidator._fit(search(), train)
    assert mine.avgMetrics == theirs.avgMetrics and mine.stdMetrics == theirs.stdMetrics
    assert mine.bestModel.stages[1].toDebugString.split("\n")[1:] == theirs.bestModel.stages[1].toDebugString.split("\n")[1:]
