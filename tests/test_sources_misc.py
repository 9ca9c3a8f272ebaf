import os
import tempfile

from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadspark.operators import ml, profile, score
from leadspark.sources import files, tables


def test_csv_lookup_keeps_leading_zero(spark):
    d = tempfile.mkdtemp(prefix="leadspark-csv-")
    path = os.path.join(d, "lookup.csv")
    with open(path, "w") as f:
        f.write("ZIP CODE,TERR\n01234,T1\n00999,T2\n")
    schema = T.StructType([T.StructField("ZIP CODE", T.StringType()), T.StructField("TERR", T.StringType())])
    got = sorted(tuple(r) for r in files.read_lookup_csv(spark, path, schema).collect())
    assert got == [("00999", "T2"), ("01234", "T1")]


def test_export_and_table_roundtrip(spark):
    d = tempfile.mkdtemp(prefix="leadspark-out-")
    df = spark.createDataFrame([("a", 1.5), ("b", None)], "k string, v double")
    files.export_csv(df, os.path.join(d, "csv"))
    back = files.read_lookup_csv(spark, os.path.join(d, "csv"), df.schema)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    files.save_table(df, os.path.join(d, "pq"), partition_by="k")
    assert spark.read.parquet(os.path.join(d, "pq")).count() == 2


def test_preview_is_ordered_top_k(spark):
    df = spark.createDataFrame([(i, float(i % 5)) for i in range(50)], "k int, v double").repartition(4)
    got = [(r.k, r.v) for r in profile.preview(df, 3, [F.desc("v"), F.asc("k")]).collect()]
    assert got == [(4, 4.0), (9, 4.0), (14, 4.0)]


def test_rule_probability_and_leads(spark):
    df = spark.createDataFrame([("a", 0, 50000.0), ("b", 0, 200000.0), ("c", 1, 90000.0), ("d", 0, 10000.0)],
                               "k string, label int, x double")
    s = score.rule_probability(df, "x", 100000)
    assert {r.k: r.lead_gen_prob for r in s.collect()} == {"a": 0.5, "b": 1.0, "c": 0.9, "d": 0.1}
    assert sorted(r.k for r in score.leads(s, 0.25).collect()) == ["a", "b"]
    assert [r.k for r in score.buyers(s).collect()] == ["c"]


def test_grid_search_folds_come_from_the_key(spark):
    rows = [(f"k{i % 40}", float(i % 10), 1 if i % 10 > 5 else 0) for i in range(200)]
    df = ml.with_fold(spark.createDataFrame(rows, "k string, x double, label int"), "k")
    assert df.groupBy("k").agg(F.countDistinct("fold").alias("n")).filter("n > 1").count() == 0
    g = ml.gbt(maxIter=3)
    search = ml.grid_search(ml.pipeline(ml.assembler(["x"]), g), ml.grid([(g.maxDepth, [1, 2])]), parallelism=2)
    assert search.getFoldCol() == "fold"
    assert len(search.fit(df).avgMetrics) == 2


def test_driver_tables_load(spark):
    assert set(tables.load(spark, "/root/testdata/sf0.001", "nation").columns) == {"n_nationkey", "n_name",
                                                                                   "n_regionkey"}
