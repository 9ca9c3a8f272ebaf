"""Feature importance as DataFrames.

* ``trees``: impurity importance of a tree model (``featureImportances``).
* ``nodes``: the splits of a tree model as a table, by a walk over its trees; the
  rows of each split are counted by the leaves that the data fall into.
* ``gain`` / ``weight``: average gain and number of splits per feature over such a
  table, mapped to names by feature index.
* ``permutation``: metric drop when one feature column is truly permuted
  across rows.  The permutation pairs the rows' positions in key order with
  positions in md5 order (two distributed sorts and an equi-join), then the
  pipeline re-assembles the feature vector from the permuted column.
* ``top``: the first k features by importance (ties: input order).
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadspark.functions.exprs import col_of, md5_int
from leadspark.operators.ordering import with_global_index
from leadspark.operators.attach import attach_row

_NAMES = T.StructType([T.StructField("idx", T.IntegerType()), T.StructField("feature", T.StringType())])


def names_frame(spark: SparkSession, names) -> DataFrame:
    return spark.createDataFrame(list(enumerate(names)), _NAMES)


def trees(spark: SparkSession, model, names) -> DataFrame:
    m = model.stages[-1] if isinstance(model, PipelineModel) else model
    if not hasattr(m, "featureImportances"):
        m = next(s for s in reversed(model.stages) if hasattr(s, "featureImportances"))
    imp = m.featureImportances.toArray().tolist()
    rows = [(i, n, float(v)) for i, (n, v) in enumerate(zip(names, imp))]
    schema = T.StructType(list(_NAMES.fields) + [T.StructField("importance", T.DoubleType())])
    return spark.createDataFrame(rows, schema)


def _walk(node, tree: int, leaves: int, out: list) -> int:
    """Append the splits below a node, each with the range of its leaves (numbered from the left); leaves so far."""
    if node.toString().startswith("LeafNode"):
        return leaves + 1
    at = len(out)
    out.append(None)  # a split stands before those below it
    feature, gain = node.split().featureIndex(), node.gain()
    end = _walk(node.rightChild(), tree, _walk(node.leftChild(), tree, leaves, out), out)
    out[at] = (tree, at, feature, float(gain), leaves, end)
    return end


def nodes(spark: SparkSession, model, data: DataFrame) -> DataFrame:
    """(tree, node, idx, gain, n_rows): the splits of a tree or an ensemble, from the root of each tree.

    ``gain`` is per row, as the model has it; ``n_rows`` is how many rows of
    ``data`` (those of the fit, to weigh gains) come to the split: rows per leaf in
    one aggregation, summed over the leaves below.  A tree of one leaf has no split.
    The walk touches only the model, whose size its depth and number of trees bound.
    """
    if isinstance(model, PipelineModel):
        model, data = model.stages[-1], PipelineModel(model.stages[:-1]).transform(data)
    single = not hasattr(model, "trees")
    splits = []
    for t, tree in enumerate([model] if single else model.trees):
        own: list = []
        _walk(tree._call_java("rootNode"), t, 0, own)
        splits += own
    scored = model.copy()
    scored.set(scored.leafCol, "_leaf")
    leaf = F.array("_leaf") if single else vector_to_array("_leaf")
    fell = scored.transform(data.select(scored.getFeaturesCol())).select(F.posexplode(leaf).alias("tree", "leaf"))
    fell = fell.groupBy("tree", F.col("leaf").cast("int").alias("leaf")).agg(F.count(F.lit(1)).alias("n"))
    table = spark.createDataFrame(splits, "tree int, node int, idx int, gain double, first_leaf int, end_leaf int")
    below = F.broadcast(table).alias("s")  # as large as the model
    return below.join(fell.alias("f"), (F.col("s.tree") == F.col("f.tree")) & (F.col("leaf") >= F.col("first_leaf"))
                      & (F.col("leaf") < F.col("end_leaf"))).groupBy("s.tree", "node", "idx", "gain").agg(
        F.sum("n").alias("n_rows"))


def gain(splits: DataFrame, names) -> DataFrame:
    """(idx, feature, importance = average gain x rows per split, splits) of a table of ``nodes``."""
    g = splits.groupBy("idx").agg(F.avg(F.col("gain") * F.col("n_rows")).alias("importance"),
                                  F.count(F.lit(1)).alias("splits"))
    nm = F.broadcast(names_frame(splits.sparkSession, names))   # one row per feature
    return nm.join(g, "idx", "left").na.fill({"importance": 0.0, "splits": 0})


def weight(splits: DataFrame, names) -> DataFrame:
    """(idx, feature, importance = number of splits on the feature)."""
    g = gain(splits, names)
    return g.select("idx", "feature", F.col("splits").cast("double").alias("importance"))


def permute_column(df: DataFrame, col: str, key: str, seed: int = 42) -> DataFrame:
    """``df`` with the values of ``col`` moved between rows by a seeded permutation."""
    a = with_global_index(df.drop(col), [col_of(key)], "_pos")
    b = with_global_index(
        df.select(col_of(key).alias("_pk"), col_of(col).alias("_pv"),
                  md5_int(col_of(key), F.lit(str(seed)), F.lit(col)).alias("_ph")),
        [F.col("_ph"), F.col("_pk")], "_pos")
    j = a.join(b.select("_pos", "_pv"), "_pos")
    return j.withColumnRenamed("_pv", col).drop("_pos").select(*[col_of(c) for c in df.columns])


def permutation(spark: SparkSession, model, df: DataFrame, cols, key: str, metric_fn, seed: int = 42) -> DataFrame:
    """(idx, feature, importance = base metric - metric with the feature permuted).

    ``metric_fn(predictions, by) -> (by, m)`` gets the predictions of all
    variants stacked, ``by`` naming the variant: -1 with no feature permuted, i
    with feature i.  Rows are numbered once by key, and all features' values
    once by (feature, md5, key); each variant's row then takes the value with
    its own number.  Three total sorts in all, whatever the number of features.
    The model must contain its assembler so the permuted column reaches the vector.
    """
    rows = with_global_index(df, [col_of(key)], "_pos")
    vals = F.array(*[F.struct(F.lit(i).alias("_f"), col_of(c).cast("double").alias("_v"),
                              md5_int(col_of(key), F.lit(str(seed)), F.lit(c)).alias("_h"))
                     for i, c in enumerate(cols)])
    long = df.select(col_of(key).alias("_pk"), F.explode(vals).alias("_x")).select("_pk", "_x.*")
    long = with_global_index(long, [F.col("_f"), F.col("_h"), F.col("_pk")], "_g")
    start = long.groupBy("_f").agg(F.min("_g").alias("_g0"))  # a row per feature
    moved = long.join(F.broadcast(start), "_f").select("_f", (F.col("_g") - F.col("_g0")).alias("_pos"), "_v")
    stacked = rows.withColumn("_f", F.explode(F.sequence(F.lit(-1), F.lit(len(cols) - 1))))
    stacked = stacked.join(moved, ["_f", "_pos"], "left")
    for i, c in enumerate(cols):
        stacked = stacked.withColumn(c, F.when(F.col("_f") == i, F.col("_v")).otherwise(col_of(c)))
    m = metric_fn(model.transform(stacked.drop("_v", "_pos")), "_f")
    base = m.agg(F.max(F.when(F.col("_f") == -1, F.col("m"))).alias("base"))
    name = F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("_f") + 1)
    return attach_row(m.filter(F.col("_f") >= 0), base).select(
        F.col("_f").alias("idx"), name.alias("feature"), (F.col("base") - F.col("m")).alias("importance"))


def top(imp: DataFrame, k: int) -> DataFrame:
    """First ``k`` features by importance, ties by input order (a top-k)."""
    return imp.orderBy(F.desc("importance"), F.asc("idx")).limit(k)
