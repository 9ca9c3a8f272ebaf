"""Cleansing operators: positive sales, key checks, dedupe, name cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from leadspark.functions.exprs import clean_name, col_of


def keep_positive(df: DataFrame, value: str = "SALES", key: str | None = "MDM_CUST_KEY") -> DataFrame:
    """Rows whose key is not null and whose value is > 0.

    Same net effect as: negatives -> 0, zeros -> null, drop null and NaN.
    An empty-string key is kept.
    """
    v = col_of(value)
    cond = v > 0
    if isinstance(df.schema[value].dataType, (DoubleType, FloatType)):
        cond = cond & ~F.isnan(v)
    if key is not None:
        cond = col_of(key).isNotNull() & cond
    return df.filter(cond)


def empty_key_audit(df: DataFrame, key: str = "MDM_CUST_KEY") -> DataFrame:
    """Rows whose key is the empty string (a data-quality listing)."""
    return df.filter(col_of(key) == "")


def exclude_key(df: DataFrame, key: str, sentinel: str) -> DataFrame:
    """Drop a sentinel key (null keys drop too, as with SQL ``!=``)."""
    return df.filter(col_of(key) != sentinel)


def first_by(df: DataFrame, keys, order, keep=None, unique: bool = False) -> DataFrame:
    """One row per key: the row that comes first by ``order`` (nulls last).

    For each order column the least value per key is found by a hash aggregate
    (partial + final, so a key that holds a large share of the rows is reduced
    map-side) and the rows are joined back to it; nothing is sorted by key and
    order.  Rows that agree in all order columns are equal candidates, and any
    one of them stays; ``unique`` says that there are none (the order is a row
    number or a primary key), which saves looking for them.  Null keys form one
    group (as in a pandas ``drop_duplicates``).
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    order = [order] if isinstance(order, str) else list(order)
    out = df.select(*[col_of(c) for c in df.columns if c in keys or c in order or c in (keep or df.columns)])
    for c in order:
        least = out.groupBy(*[col_of(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min(col_of(c)).alias("_m"))
        cond = col_of(c).eqNullSafe(F.col("_m"))
        for i, k in enumerate(keys):
            cond = cond & col_of(k).eqNullSafe(F.col(f"_k{i}"))
        out = out.join(least, cond, "left_semi")
    if not unique:
        out = out.dropDuplicates(keys)
    return out.select(*[col_of(c) for c in df.columns if c in keys or c in (keep or df.columns)])


def clean_names(df: DataFrame, chars=(" ", ",", ";"), repl: str = "_") -> DataFrame:
    """Replace blanks, commas and semicolons in column names; fail on collisions."""
    new = [clean_name(c, chars, repl) for c in df.columns]
    seen = {}
    for old, n in zip(df.columns, new):
        if n in seen:
            raise ValueError(f"columns {seen[n]!r} and {old!r} both clean to {n!r}")
        seen[n] = old
    return df.toDF(*new)


def drop_strict(df: DataFrame, cols) -> DataFrame:
    """Drop columns, failing (like pandas) when one of them is missing."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise KeyError(f"columns not found: {missing}")
    return df.drop(*cols)
