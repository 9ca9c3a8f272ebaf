"""Classifier metrics as DataFrames (one aggregation each, nothing collected).

``metrics``: accuracy, weighted precision / recall / F1 from one confusion
matrix aggregation (the definitions of MulticlassClassificationEvaluator;
a class that is never predicted has precision 0).
``auc``: exact area under the ROC curve by ranks with ties at mid-rank,
computed over the distinct scores with a distributed running sum.
``best_run``: the run with the best metric.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadspark.functions.exprs import col_of
from leadspark.operators.ordering import with_prefix, with_running_sum
from leadspark.operators.attach import attach_row


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return (df.groupBy(col_of(label).cast("double").alias("label"),
                       col_of(prediction).cast("double").alias("prediction"))
              .agg(F.count(F.lit(1)).alias("n")))


def metrics(df: DataFrame, label: str = "label", prediction: str = "prediction", digits: int = 12,
            by: str | None = None) -> DataFrame:
    """One row of metrics, or one for each value of ``by``; one confusion aggregation either way."""
    g = [] if by is None else [by]
    cm = (df.groupBy(*g, col_of(label).cast("double").alias("_l"), col_of(prediction).cast("double").alias("_c"))
          .agg(F.count(F.lit(1)).alias("_n")))
    # each cell counts for its label's row and its prediction's row
    zero = F.lit(0).cast("long")
    sides = F.array(F.struct(F.col("_l").alias("c"), F.col("_n").alias("n_true"), zero.alias("n_pred")),
                    F.struct(F.col("_c").alias("c"), zero.alias("n_true"), F.col("_n").alias("n_pred")))
    hit = F.when(F.col("_l") == F.col("_c"), F.col("_n")).otherwise(zero)
    per = cm.select(*g, hit.alias("_hit"), F.posexplode(sides).alias("_side", "_s"))
    per = per.groupBy(*g, F.col("_s.c").alias("c")).agg(
        F.sum("_s.n_true").alias("n_true"), F.sum("_s.n_pred").alias("n_pred"),
        F.sum(F.when(F.col("_side") == 0, F.col("_hit")).otherwise(0)).alias("tp"))
    tot = per.groupBy(*g).agg(F.sum("n_true").alias("N"))
    per = attach_row(per, tot) if by is None else per.join(tot, by)
    prec = F.when(F.col("n_pred") > 0, F.col("tp") / F.col("n_pred")).otherwise(F.lit(0.0))
    rec = F.when(F.col("n_true") > 0, F.col("tp") / F.col("n_true")).otherwise(F.lit(0.0))
    per = per.withColumn("_p", prec).withColumn("_r", rec)
    f1 = F.when(F.col("_p") + F.col("_r") > 0, F.lit(2.0) * F.col("_p") * F.col("_r") / (F.col("_p") + F.col("_r"))) \
          .otherwise(F.lit(0.0))
    w = F.col("n_true") / F.col("N")
    agg = per.groupBy(*g).agg(
        (F.sum("tp") / F.first("N")).alias("accuracy"),
        F.sum(w * F.col("_p")).alias("weighted_precision"),
        F.sum(w * F.col("_r")).alias("weighted_recall"),
        F.sum(w * f1).alias("f1"),
        F.first("N").cast("long").alias("n"))
    return agg.select(*g, *[F.round(c, digits).alias(c) for c in ("accuracy", "weighted_precision",
                                                                   "weighted_recall", "f1")], "n")


def auc(df: DataFrame, label: str = "label", score: str = "score", digits: int = 12,
        by: str | None = None) -> DataFrame:
    """One-row DataFrame (auc, n_pos, n_neg), or a row for each value of ``by``, by one total sort
    either way; auc is null without both classes."""
    k = [] if by is None else [by]
    g = (df.select(*k, col_of(score).cast("double").alias("_s"), col_of(label).cast("double").alias("_l"))
           .filter(F.col("_s").isNotNull() & F.col("_l").isNotNull())
           .groupBy(*k, "_s").agg(F.sum(F.when(F.col("_l") == 1, 1).otherwise(0)).alias("_pos"),
                                  F.sum(F.when(F.col("_l") == 1, 0).otherwise(1)).alias("_neg")))
    c = with_running_sum(g, [*map(F.col, k), F.col("_s")], "_neg", "_below", inclusive=False)
    # the running sum goes on from group to group: what came before a group's first score is taken off
    a = c.groupBy(*k).agg(
        (F.sum(F.col("_pos") * (F.col("_below") + F.lit(0.5) * F.col("_neg")))
         - F.min("_below") * F.sum("_pos")).alias("_u"),
        F.sum("_pos").alias("n_pos"), F.sum("_neg").alias("n_neg"))
    val = F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0),
                 F.col("_u") / (F.col("n_pos").cast("double") * F.col("n_neg")))
    return a.select(*k, F.round(val, digits).alias("auc"), F.col("n_pos").cast("long").alias("n_pos"),
                    F.col("n_neg").cast("long").alias("n_neg"))


def auc_pr(df: DataFrame, label: str = "label", score: str = "score", digits: int = 12) -> DataFrame:
    """One-row DataFrame (auc_pr): area under the precision-recall curve.

    Points are taken at every distinct score (descending); the curve starts
    at (0, precision of the first point) and is integrated by trapezoids, as
    in Spark's BinaryClassificationMetrics without binning.  Consecutive
    points are paired by their positions (an equi-join), not by a window.
    """
    g = (df.select(col_of(score).cast("double").alias("_s"), col_of(label).cast("double").alias("_l"))
           .filter(F.col("_s").isNotNull() & F.col("_l").isNotNull())
           .groupBy("_s").agg(F.sum(F.when(F.col("_l") == 1, 1).otherwise(0)).alias("_pos"),
                             F.sum(F.when(F.col("_l") == 1, 0).otherwise(1)).alias("_neg")))
    c = with_prefix(g, [F.col("_s").desc()], {"_tp": "_pos", "_fp": "_neg"}, index="_i")
    tot = c.agg(F.sum("_pos").alias("_P"))
    pts = attach_row(c, tot).select(
        "_i", (F.col("_tp") / F.nullif(F.col("_P"), F.lit(0))).alias("_r"), (F.col("_tp") / (F.col("_tp") + F.col("_fp"))).alias("_p"))
    first = pts.agg(F.max(F.when(F.col("_i") == 0, F.col("_p"))).alias("_p_first"))
    prev = pts.select((F.col("_i") + 1).alias("_i"), F.col("_r").alias("_r0"), F.col("_p").alias("_p0"))
    seg = (attach_row(pts.join(prev, "_i", "left"), first)
              .select(F.col("_r"), F.col("_p"), F.coalesce("_r0", F.lit(0.0)).alias("_r0"),
                      F.coalesce("_p0", "_p_first").alias("_p0")))
    a = seg.agg(F.sum((F.col("_r") - F.col("_r0")) * (F.col("_p") + F.col("_p0")) / F.lit(2.0)).alias("_a"))
    return attach_row(a, tot).select(
        F.round(F.when(F.col("_P") > 0, F.col("_a")), digits).alias("auc_pr"))


def best_run(runs: DataFrame, metric: str, run_col: str = "run") -> DataFrame:
    """The run with the highest ``metric`` (ties: smallest run id)."""
    return runs.orderBy(F.desc(metric), F.asc(run_col)).limit(1)
