"""Exact global positions and running sums without a single-partition window.

A window ``ORDER BY`` with no ``PARTITION BY`` pulls every row into one
task.  Here the rows are range-partitioned by a total sort instead; each
partition's row count (or sum) is a tiny table with one row per partition,
whose prefix sums become offsets that are broadcast back.  The sorted data,
with its partition id and in-partition position as columns, is written to
the session's checkpoint folder first, so the ids the offsets refer to
survive a lost executor and a recomputation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadspark.session import freeze

_PID, _MID = "_ord_pid", "_ord_mid"


def _sorted_frozen(df: DataFrame, order_cols) -> DataFrame:
    # partition id and position are stored as columns, so the written copy
    # keeps them whatever partitioning the read-back gets
    s = (df.orderBy(*order_cols)
           .withColumn(_PID, F.spark_partition_id())
           .withColumn(_MID, F.monotonically_increasing_id()))
    return freeze(s, "sorted")


def with_prefix(df: DataFrame, order_cols, sums: dict | None = None, index: str | None = None,
                inclusive: bool = True) -> DataFrame:
    """One total sort, then any of: ``index`` = 0-based position, and for each
    ``out -> col`` in ``sums`` the running sum of ``col`` up to the row
    (``inclusive``) or up to the row before it.

    ``order_cols`` must make the order total (add a unique key as the last
    tie-breaker) for positions to be reproducible.
    """
    sums = dict(sums or {})
    s = _sorted_frozen(df, order_cols)
    aggs = [F.count(F.lit(1)).alias("_n"), F.min(_MID).alias("_m0")]
    aggs += [F.sum(c).alias(f"_t_{o}") for o, c in sums.items()]
    per_part = s.groupBy(_PID).agg(*aggs)
    # one row per partition: bounded by the partition count, safe to broadcast
    w = Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    offs = per_part.select(_PID, "_m0", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off_n"),
                           *[F.coalesce(F.sum(f"_t_{o}").over(w), F.lit(0)).alias(f"_off_{o}") for o in sums])
    local = s
    if sums:
        # running sums inside one partition: rows of that partition only, in sort order
        frame_end = 0 if inclusive else -1
        wp = Window.partitionBy(_PID).orderBy(_MID).rowsBetween(Window.unboundedPreceding, frame_end)
        for o, c in sums.items():
            local = local.withColumn(f"_loc_{o}", F.coalesce(F.sum(c).over(wp), F.lit(0)))
    j = local.join(F.broadcast(offs), _PID)
    if index:
        j = j.withColumn(index, F.col("_off_n") + F.col(_MID) - F.col("_m0"))
    for o in sums:
        j = j.withColumn(o, F.col(f"_off_{o}") + F.col(f"_loc_{o}"))
    drop = [_PID, _MID, "_m0", "_off_n"] + [f"_off_{o}" for o in sums] + [f"_loc_{o}" for o in sums]
    return j.drop(*drop)


def with_global_index(df: DataFrame, order_cols, out: str = "_idx") -> DataFrame:
    """Add ``out`` = 0-based position of the row in the total order."""
    return with_prefix(df, order_cols, index=out)


def with_running_sum(df: DataFrame, order_cols, value: str, out: str = "_cum",
                     inclusive: bool = True) -> DataFrame:
    """Add ``out`` = sum of ``value`` over all rows up to this one in the total order."""
    return with_prefix(df, order_cols, {out: value}, inclusive=inclusive)
