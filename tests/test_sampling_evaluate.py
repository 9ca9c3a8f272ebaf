import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from leadspark.operators import evaluate, sampling


@pytest.mark.parametrize("sizes", [(7, 3), (5, 5), (9, 1), (6, 3, 1)])
def test_oversample_exact_balance(spark, sizes):
    rows, k = [], 0
    for label, n in enumerate(sizes):
        for _ in range(n):
            rows.append((f"key{k}", label, float(k)))
            k += 1
    df = spark.createDataFrame(rows, "MDM_CUST_KEY string, label int, x double").repartition(3)
    out = sampling.oversample(df, "label", "MDM_CUST_KEY", 42)
    counts = {r.label: r["count"] for r in out.groupBy("label").count().collect()}
    assert counts == {i: max(sizes) for i in range(len(sizes))}
    originals = out.filter(F.col("COPY") == 0).select("MDM_CUST_KEY", "label", "x")
    assert sorted(map(tuple, originals.collect())) == sorted(rows)
    per_row = [r["count"] for r in out.groupBy("MDM_CUST_KEY", "label").count().collect()]
    for label, n in enumerate(sizes):
        q = max(sizes) // n
        assert set(c for c in per_row) <= {q0 for n0 in sizes for q0 in (max(sizes) // n0, max(sizes) // n0 + 1)}


def test_hash_split_partition_independent(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("k"))
    a = [set(r.k for r in p.collect()) for p in sampling.hash_split(df.repartition(4), "k", [0.8, 0.2], 42)]
    b = [set(r.k for r in p.collect()) for p in sampling.hash_split(df.repartition(9), "k", [0.8, 0.2], 42)]
    assert a == b
    assert a[0] | a[1] == {str(i) for i in range(500)} and not (a[0] & a[1])
    assert 330 < len(a[0]) < 470


@pytest.mark.parametrize("rows", [
    [(1, 1.0), (0, 0.0), (1, 1.0), (0, 0.0)],          # perfect
    [(1, 1.0), (1, 1.0), (1, 0.0)],                      # one class only
    [(1, 1.0), (0, 1.0), (0, 1.0), (1, 0.0), (0, 0.0)],  # mixed
    [(1, 0.0), (0, 0.0), (2, 0.0)],                      # classes never predicted
])
def test_metrics_match_spark_evaluator(spark, rows):
    df = spark.createDataFrame(rows, "label int, prediction double").withColumn("label", F.col("label").cast("double"))
    m = evaluate.metrics(df).collect()[0]
    for ours, theirs in (("accuracy", "accuracy"), ("weighted_precision", "weightedPrecision"),
                         ("weighted_recall", "weightedRecall"), ("f1", "f1")):
        ev = MulticlassClassificationEvaluator(metricName=theirs)
        assert m[ours] == pytest.approx(ev.evaluate(df), abs=1e-9)


def test_auc_matches_binary_evaluator_with_ties(spark):
    import random
    rnd = random.Random(3)
    rows = [(float(rnd.random() < 0.4), round(rnd.random(), 1)) for _ in range(300)]
    df = spark.createDataFrame(rows, "label double, score double").repartition(4)
    ours = evaluate.auc(df, "label", "score").collect()[0].auc
    theirs = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label").evaluate(df)
    assert ours == pytest.approx(theirs, abs=1e-9)


def test_auc_single_class_is_null(spark):
    df = spark.createDataFrame([(1.0, 0.3), (1.0, 0.5)], "label double, score double")
    assert evaluate.auc(df, "label", "score").collect()[0].auc is None


def test_auc_pr_matches_binary_evaluator(spark):
    import random
    rnd = random.Random(5)
    rows = [(float(rnd.random() < 0.3), round(rnd.random(), 2)) for _ in range(400)]
    df = spark.createDataFrame(rows, "label double, score double").repartition(3)
    ours = evaluate.auc_pr(df, "label", "score").collect()[0].auc_pr
    theirs = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label",
                                           metricName="areaUnderPR").evaluate(df)
    assert ours == pytest.approx(theirs, abs=1e-9)


def test_oversample_chunks_many_copies(spark):
    rows = [(f"big{i}", 0) for i in range(2500)] + [("tiny", 1)]
    df = spark.createDataFrame(rows, "MDM_CUST_KEY string, label int")
    out = sampling.oversample(df, "label", "MDM_CUST_KEY", 42, chunk=100)
    counts = {r.label: r["count"] for r in out.groupBy("label").count().collect()}
    assert counts == {0: 2500, 1: 2500}
    copies = [r.COPY for r in out.filter("label = 1").collect()]
    assert sorted(copies) == list(range(2500))


def test_oversample_null_label_is_a_class(spark):
    rows = [("a", 1), ("b", 1), ("c", 1), ("d", None)]
    df = spark.createDataFrame(rows, "MDM_CUST_KEY string, label int")
    out = sampling.oversample(df, "label", "MDM_CUST_KEY", 1)
    counts = {r.label: r["count"] for r in out.groupBy("label").count().collect()}
    assert counts == {1: 3, None: 3}
