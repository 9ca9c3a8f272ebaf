"""Full outer merge whose hot keys are divided.

A full outer join needs all rows of a key, and all rows without one, in one task, and
no engine setting splits it.  Here the rows of each key are counted on both sides
first (a hash aggregation, so a key of any size is a row a task).  Keys with more
than a thousandth of all rows - two thousand at most, so broadcasting them is
bounded - are taken out of the join:

* on one side only, their rows are passed on where they lie;
* on both, the larger side's rows are dealt into parts, and the smaller side's rows
  are repeated for each part: an inner join on key and part.

Null keys match only if asked for (``null_safe``); otherwise they are passed on too.
What is left is an ordinary full outer join, in which no key is large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspark.functions.exprs import col_of
from leadspark.operators.attach import attach_row
from leadspark.operators.enrich import merge
from leadspark.session import freeze

#: A key is hot from this part of all rows on; its rows are dealt into parts of about that size.
HOT = 1000


def _counts(df: DataFrame, key: str, n: str) -> DataFrame:
    return df.groupBy(col_of(key).alias("_key")).agg(F.count(F.lit(1)).alias(n))


def hot_keys(left: DataFrame, right: DataFrame, key: str, hot: int = HOT) -> DataFrame:
    """(_key, _left, _right, _parts): keys with more than one in ``hot`` of all rows, and their rows on each side."""
    a, b = _counts(left, key, "_left"), _counts(right, key, "_right").withColumnRenamed("_key", "_rkey")
    both = a.join(b, F.col("_key").eqNullSafe(F.col("_rkey")), "full").select(
        F.coalesce("_key", "_rkey").alias("_key"), F.coalesce("_left", F.lit(0)).alias("_left"),
        F.coalesce("_right", F.lit(0)).alias("_right"))
    rows = left.select(F.lit(1)).unionByName(right.select(F.lit(1))).agg(F.count(F.lit(1)).alias("_total"))
    most = F.greatest("_left", "_right") * hot
    return attach_row(both, rows).where(most > F.col("_total")).select(
        "_key", "_left", "_right", F.ceil(most / F.col("_total")).cast("int").alias("_parts"))


def full_merge(left: DataFrame, right: DataFrame, key: str, suffixes=("_x", "_y"), null_safe: bool = False,
               hot: int = HOT, write: bool = True) -> DataFrame:
    """Full outer merge on a shared key name: one coalesced key column, clashing names suffixed.

    Each side is read several times, and rows of a hot key are dealt by their
    place, so both sides are written first (``write``; not needed for frames
    that only scan files).
    """
    if write:
        left, right = freeze(left, "merge_left"), freeze(right, "merge_right")
    keys = freeze(hot_keys(left, right, key, hot), "merge_hot")
    if not keys.limit(1).count():
        return merge(left, right, key, key, "full", suffixes=suffixes, null_safe=null_safe)
    big = F.broadcast(keys)

    def is_big(side: DataFrame) -> Column:
        return side[f"`{key}`"].eqNullSafe(big["_key"])
    out = merge(left.join(big, is_big(left), "left_anti"), right.join(big, is_big(right), "left_anti"),
                key, key, "full", suffixes=suffixes, null_safe=null_safe)
    meet = (F.col("_left") > 0) & (F.col("_right") > 0)
    if not null_safe:
        meet = meet & F.col("_key").isNotNull()
    own_left, own_right = left.join(big, is_big(left)), right.join(big, is_big(right))
    # the larger side's rows go to one part each, the smaller side's to all
    one = F.array(F.pmod(F.monotonically_increasing_id(), F.col("_parts")).cast("int"))
    every = F.sequence(F.lit(0), F.col("_parts") - 1)
    left_larger = F.col("_left") >= F.col("_right")

    def parted(side: DataFrame, columns: list, larger: Column) -> DataFrame:
        part = F.explode(F.when(larger, one).otherwise(every)).alias("_part")
        rows = side.where(meet).select(*[col_of(c) for c in columns], part)
        return rows.withColumn("_pair", F.struct(col_of(key).alias("k"), F.col("_part").alias("p"))).drop("_part")
    a = parted(own_left, left.columns, left_larger)
    b = parted(own_right, right.columns, ~left_larger).withColumnRenamed(key, "_rkey")
    out = out.unionByName(merge(a, b, "_pair", "_pair", "inner", suffixes=suffixes).drop("_pair", "_rkey"))
    for rows, own, other, mark in ((own_left, left, right, suffixes[0]), (own_right, right, left, suffixes[1])):
        names = {c: c + mark if c != key and c in other.columns else c for c in own.columns}
        alone = rows.where(~meet).select(*[col_of(c).alias(n) for c, n in names.items()])
        out = out.unionByName(alone, allowMissingColumns=True)  # the other side's columns are null
    return out
