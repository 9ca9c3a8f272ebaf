"""Descriptive statistics as DataFrames: quantiles, counts, histogram, box
statistics, column summary, preview.

Exact quantiles are selected by counting (``selection``) rather than by
``percentile`` (whose final merge holds every distinct value in one task) or by
a sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadspark.functions.exprs import col_of
from leadspark.functions.images import double_image, image_double
from leadspark.operators.attach import attach_row
from leadspark.operators.selection import quantile_ranks, quantile_value, select_ranks


def _qname(p: float) -> str:
    return "q" + (f"{p:.4f}".rstrip("0").rstrip(".").replace("0.", "", 1) if p < 1 else "1")


def quantiles(df: DataFrame, value: str, probs=(0.25, 0.75), names=None) -> DataFrame:
    """One-row DataFrame of linear-interpolation quantiles of ``value``.

    Same definition as pandas ``quantile`` / SQL ``quantile_cont``: position
    h = (n - 1) p, result v[floor h] + (h - floor h) (v[floor h + 1] - v[floor h]).
    Nulls and NaN are ignored; an empty input gives nulls.
    """
    names = list(names or [_qname(p) for p in probs])
    v = col_of(value).cast("double")
    images = df.select(F.lit(0).alias("_g"), v.alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v")).select(
        "_g", double_image(F.col("_v")).alias("_value"))
    found = select_ranks(images, lambda sizes: quantile_ranks(sizes, probs))
    at = [F.max(F.when(F.col("_slot") == k, F.col("_value"))).alias(f"_{k}") for k in range(2 * len(probs))]
    # a global aggregate: one row, of nulls if there are no values
    row = found.agg(F.max("_size").alias("_n"), *at)
    return row.select(*[quantile_value(i, p, F.col("_n"), lambda k: image_double(F.col(f"_{k}"))).alias(name)
                        for i, (p, name) in enumerate(zip(probs, names))])


def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(col_of(label).alias(label)).agg(F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """Counts in ``bins`` equal-width bins between min and max (last bin closed).

    Returns (bin, lo, hi, n) for non-empty bins.
    """
    v = col_of(value).cast("double")
    x = df.select(v.alias("_x")).filter(F.col("_x").isNotNull() & ~F.isnan("_x"))
    mm = x.agg(F.min("_x").alias("_mn"), F.max("_x").alias("_mx"))
    width = (F.col("_mx") - F.col("_mn")) / F.lit(float(bins))
    raw = F.floor((F.col("_x") - F.col("_mn")) / F.nullif(F.col("_mx") - F.col("_mn"), F.lit(0.0)) * bins)
    # least() skips nulls: map the max == min case (null position) to bin 0 first
    b = F.least(F.coalesce(raw, F.lit(0)), F.lit(bins - 1)).cast("int")
    j = attach_row(x, mm).withColumn("bin", b)
    g = j.groupBy("bin", "_mn", "_mx").agg(F.count(F.lit(1)).alias("n"))
    w = F.coalesce(width, F.lit(0.0))
    return g.select("bin", (F.col("_mn") + F.col("bin") * w).alias("lo"),
                    (F.col("_mn") + (F.col("bin") + 1) * w).alias("hi"), "n")


def _long(df: DataFrame, cols) -> DataFrame:
    """(feature index, value) of every value that is a number."""
    vals = F.array(*[F.struct(F.lit(i).alias("_f"), col_of(c).cast("double").alias("_v")) for i, c in enumerate(cols)])
    rows = df.select(F.explode(vals).alias("_x")).select("_x._f", "_x._v")
    return rows.filter(F.col("_v").isNotNull() & ~F.isnan("_v"))


def box_stats(df: DataFrame, cols, k: float = 1.5) -> DataFrame:
    """Box-plot numbers per column in long format.

    (feature, q1, median, q3, lower_whisker, upper_whisker, n_outliers):
    whiskers are the most extreme values inside [q1 - k IQR, q3 + k IQR];
    nulls and NaN are ignored.  All columns are counted together.
    """
    long = _long(df, cols)
    images = long.select(F.col("_f").alias("_g"), double_image(F.col("_v")).alias("_value"))
    parts = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    found = select_ranks(images, lambda sizes: quantile_ranks(sizes, parts.values()))
    at = [F.max(F.when(F.col("_slot") == k, F.col("_value"))).alias(f"_{k}") for k in range(2 * len(parts))]
    q = found.groupBy(F.col("_g").alias("_f")).agg(F.max("_size").alias("_n"), *at).select("_f", *[
        quantile_value(i, p, F.col("_n"), lambda k: image_double(F.col(f"_{k}"))).alias(name)
        for i, (name, p) in enumerate(parts.items())])  # a row per column
    lo_f = F.col("q1") - k * (F.col("q3") - F.col("q1"))
    hi_f = F.col("q3") + k * (F.col("q3") - F.col("q1"))
    inside = (F.col("_v") >= lo_f) & (F.col("_v") <= hi_f)
    out = long.join(F.broadcast(q), "_f").groupBy("_f", "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("_v"))).alias("lower_whisker"),
        F.max(F.when(inside, F.col("_v"))).alias("upper_whisker"),
        F.sum(F.when(inside, 0).otherwise(1)).cast("long").alias("n_outliers"))
    name = F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("_f") + 1)
    return out.select(name.alias("feature"), "q1", "median", "q3", "lower_whisker", "upper_whisker", "n_outliers")


_STATS = ["count", "nulls", "mean", "stddev", "min", "max", "zeros"]


def summarize(df: DataFrame, cols) -> DataFrame:
    """Column summary in long format (feature, count, nulls, mean, stddev, min,
    max, zeros): one aggregation pass for all columns, then unpivoted."""
    aggs = []
    for i, c in enumerate(cols):
        v = col_of(c).cast("double")
        aggs += [F.count(v).alias(f"count_{i}"),
                 F.sum(F.when(v.isNull(), 1).otherwise(0)).cast("long").alias(f"nulls_{i}"),
                 F.avg(v).alias(f"mean_{i}"), F.stddev_samp(v).alias(f"stddev_{i}"),
                 F.min(v).alias(f"min_{i}"), F.max(v).alias(f"max_{i}"),
                 F.sum(F.when(v == 0, 1).otherwise(0)).cast("long").alias(f"zeros_{i}")]
    wide = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), *[F.col(f"{s}_{i}").alias(s) for s in _STATS])
                     for i, c in enumerate(cols)])
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def preview(df: DataFrame, n: int, order_by) -> DataFrame:
    """First ``n`` rows in a stated order (a top-k, never an unordered limit)."""
    order_by = [order_by] if not isinstance(order_by, (list, tuple)) else order_by
    return df.orderBy(*order_by).limit(n)
