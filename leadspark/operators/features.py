"""Feature operators: composite category, declared pivot, target floor and
outlier cap, label, log transform, and the whole feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadspark.functions.exprs import category, col_of
from leadspark.operators import cleanse
from leadspark.operators.profile import quantiles
from leadspark.session import freeze
from leadspark.operators.attach import attach_row


def add_category(df: DataFrame, l1: str = "L1_DESC", l2: str = "L2_DESC", out: str = "L1_L2_DESC") -> DataFrame:
    return df.withColumn(out, category(l1, l2))


def pivot_sum(df: DataFrame, key: str, cat: str, value: str, values) -> DataFrame:
    """One row per key, one summed column per declared category value.

    The value list is declared, so the schema does not depend on the data
    and no extra job collects the distinct categories.  Categories outside
    the list (and null) are ignored; a declared category without data gives
    a null column.
    """
    values = list(values)
    if len(set(values)) != len(values):
        raise ValueError("pivot values must be unique")
    return (df.select(col_of(key).alias(key), col_of(cat).alias("_cat"), col_of(value).alias("_val"))
              .groupBy(key).pivot("_cat", values).agg(F.sum("_val")))


def floor_to_zero(df: DataFrame, c: str, threshold: float, out: str | None = None) -> DataFrame:
    """Values below ``threshold`` become 0; null stays null."""
    v = col_of(c)
    return df.withColumn(out or c, F.when(v < threshold, F.lit(0)).otherwise(v))


def iqr_upper(df: DataFrame, c: str, where=None, k: float = 1.5) -> DataFrame:
    """One-row DataFrame ``(q1, q3, upper)`` with upper = q3 + k (q3 - q1)."""
    src = df if where is None else df.filter(where)
    q = quantiles(src, c, (0.25, 0.75), ["q1", "q3"])
    return q.withColumn("upper", F.col("q3") + F.lit(k) * (F.col("q3") - F.col("q1")))


def iqr_cap(df: DataFrame, c: str, where=None, k: float = 1.5, out: str | None = None,
            drop_outliers: bool = False) -> DataFrame:
    """Values at or above the upper whisker become 0 (or their rows go).

    The whisker comes from the rows selected by ``where``.  With no such
    row the whisker is null and nothing changes.  The one-row whisker frame
    is joined by broadcast; nothing is collected to the driver.
    """
    up = iqr_upper(df, c, where, k).select(F.col("upper").alias("_upper"))
    v = col_of(c)
    j = attach_row(df, up)
    if drop_outliers:
        j = j.filter(~F.coalesce(v >= F.col("_upper"), F.lit(False)))
        res = j.withColumn(out or c, v)
    else:
        res = j.withColumn(out or c, F.when(v >= F.col("_upper"), F.lit(0)).otherwise(v))
    return res.drop("_upper")


def label(df: DataFrame, c: str, threshold: float, out: str = "label") -> DataFrame:
    return df.withColumn(out, F.when(col_of(c) >= threshold, 1).otherwise(0).cast("int"))


def log_columns(df: DataFrame, cols, cast: str = "float") -> DataFrame:
    """Natural log of each column; non-positive values become null."""
    for c in cols:
        v = col_of(c)
        df = df.withColumn(c, F.when(v > 0, F.ln(v)).cast(cast))
    return df


def check_feature_list(cols) -> list:
    """Feature names must be unique (a duplicate would feed one input twice)."""
    cols = list(cols)
    dup = sorted({c for c in cols if cols.count(c) > 1})
    if dup:
        raise ValueError(f"duplicate feature names: {dup}")
    return cols


def feature_table(sales: DataFrame, *, key: str, pivot_values, target: str, threshold: float,
                  sentinel: str, k: float = 1.5, target_out: str = "TARGET_SALES",
                  label_col: str = "label", drop_outliers: bool = False,
                  precision: int = 4, materialize: bool = True) -> DataFrame:
    """Unified sales -> one labelled feature row per customer.

    keep positive -> category -> pivot -> drop target column, floor target
    -> drop sentinel key -> IQR cap over rows >= threshold -> fill 0 -> label.
    Feature columns are doubles rounded to ``precision`` decimals (the sums
    are exact decimals before that).
    """
    pos = cleanse.keep_positive(sales, "SALES", key)
    cat = add_category(pos, out="_cat")
    wide = pivot_sum(cat, key, "_cat", "SALES", pivot_values)
    for v in pivot_values:
        wide = wide.withColumn(v, F.round(col_of(v).cast("double"), precision))
    t = "_target_floor"
    wide = floor_to_zero(wide, target, threshold, out=t).drop(target)
    wide = cleanse.exclude_key(wide, key, sentinel)
    if materialize:
        # whisker and cap both read the pivot: compute it once
        wide = freeze(wide)
    capped = iqr_cap(wide, t, where=col_of(t) >= threshold, k=k, out=target_out,
                     drop_outliers=drop_outliers).drop(t)
    filled = capped.fillna(0)
    return label(filled, target_out, threshold, label_col)
