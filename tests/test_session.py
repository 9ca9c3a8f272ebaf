import os

from leadspark.session import ensure_checkpoint_dir, freeze, input_bytes, size_shuffle_partitions


def test_checkpoint_dir_is_set_and_freeze_roundtrips(spark):
    d = ensure_checkpoint_dir(spark)
    assert d
    df = spark.range(10).selectExpr("id", "id * 2 as x")
    back = freeze(df, "t")
    assert sorted(tuple(r) for r in back.collect()) == [(i, 2 * i) for i in range(10)]
    # lineage is cut: the plan reads files
    assert "FileScan" in back._jdf.queryExecution().executedPlan().toString() or \
        "Scan parquet" in back._jdf.queryExecution().executedPlan().toString()


def test_shuffle_partitions_follow_input_size(spark):
    path = "/root/testdata/sf0.1/lineitem.parquet"
    b = input_bytes(spark, [path])
    assert b == os.path.getsize(path)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        n = size_shuffle_partitions(spark, [path], bytes_per_partition=1 << 20)
        assert n == max(2 * spark.sparkContext.defaultParallelism, -(-b // (1 << 20)))
        n2 = size_shuffle_partitions(spark, [path], bytes_per_partition=1 << 40)
        assert n2 == 2 * spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_cleanup_scratch_forgets_and_deletes(spark):
    from leadspark.plans import flows
    from leadspark.session import cleanup_scratch
    d = "/root/testdata/sf0.001"
    ft = flows.feature_table(spark, d)
    n = ft.count()
    base = spark.sparkContext.getCheckpointDir().replace("file:", "")
    assert os.path.isdir(base)
    cleanup_scratch(spark)
    assert not os.path.exists(base)
    assert flows.feature_table(spark, d).count() == n      # rebuilt, not read from deleted files


def test_memo_follows_the_files(spark, tmp_path):
    from leadspark.session import forget, memo
    d = str(tmp_path)
    spark.range(3).write.parquet(f"{d}/t.parquet")
    first = memo(spark, d, "n", lambda: spark.read.parquet(f"{d}/t.parquet").count())
    assert memo(spark, d, "n", lambda: -1) == first == 3
    spark.range(5).write.mode("overwrite").parquet(f"{d}/t.parquet")
    assert memo(spark, d, "n", lambda: spark.read.parquet(f"{d}/t.parquet").count()) == 5
    forget(spark)
    assert memo(spark, d, "n", lambda: 7) == 7


def test_temporary_folders_are_refused():
    import pytest
    from leadspark.session import refuse_own_folder
    with pytest.raises(RuntimeError):
        refuse_own_folder("file:///tmp/x")
    refuse_own_folder("hdfs://n/tmp/x")
    refuse_own_folder("file:///mnt/shared/x")


def test_attach_row_refuses_filters(spark):
    import pytest
    from pyspark.sql import functions as F
    from leadspark.operators.attach import attach_row
    one = spark.range(4).agg(F.max("id").alias("m"))
    assert attach_row(spark.range(5), one).count() == 5
    with pytest.raises(ValueError):
        attach_row(spark.range(5), one.filter("m > 100"))
