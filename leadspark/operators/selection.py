"""Exact selection by counting: the values at given ranks, without sorting the data.

Values are 64-bit whole numbers in the order asked for (``functions.images`` gives
them for doubles).  The first pass counts the values of each group by their highest
16 bits; the counts say in which of the at most 65,536 cells a rank lies.  Each
further pass counts, within the cells found, by the next 16 bits.  After as many
passes as the values have 16-bit parts the cell is one value: exact, whatever the
distribution, ties included.

A pass is one scan and a hash aggregation (partial before the shuffle); no row is
sorted, moved or written.  What is kept between passes is one row per group and rank.
Running sums are over the cells of one group, at most 65,536 rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadspark.session import freeze

STEP = 16
CELLS = 1 << STEP


def _located(cells: DataFrame, targets: DataFrame, by: list) -> DataFrame:
    """Each target (by.., _slot, _rank) with the cell in which its rank lies and the rank within it."""
    w = Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
    upto = cells.withColumn("_upto", F.sum("_n").over(w))
    named = targets.select(*[F.col(c).alias(f"_t{c}") for c in by], "_slot", "_rank")
    match = F.lit(True)
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"_t{c}"))
    inside = (F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_n"))
    return upto.join(F.broadcast(named), match & inside).select(
        *by, "_slot", "_cell", (F.col("_rank") - F.col("_upto") + F.col("_n")).alias("_rank"))


def select_ranks(values: DataFrame, wanted: Callable[[DataFrame], DataFrame], bits: int = 64) -> DataFrame:
    """(_g, _slot, _value, _rank, _size): the value at each wanted rank, the rank among its equals, and the group's size.

    ``values`` has the columns _g (group, may be null) and _value (whole number
    of ``bits`` bits, signed if 64).  ``wanted`` makes (_g, _slot, _rank) of the
    groups' sizes (_g, _size); ranks count from 0, those outside a group give
    nothing.  Targets are few by contract - groups times ranks - and broadcast.
    """
    if bits % STEP:
        raise ValueError(f"bits come in steps of {STEP}")
    value, shift = F.col("_value"), bits - STEP

    def cell(at: int) -> Column:
        part = F.shiftright(value, at)
        return part if at == bits - STEP else part.bitwiseAND(F.lit(CELLS - 1))
    cells = values.groupBy("_g", cell(shift).alias("_cell")).agg(F.count(F.lit(1)).alias("_n"))
    cells = freeze(cells, "cells")
    sizes = cells.groupBy("_g").agg(F.sum("_n").alias("_size"))
    targets = _located(cells, wanted(sizes), ["_g"])
    targets = freeze(targets.select("_g", "_slot", F.col("_cell").alias("_prefix"), "_rank"), "targets")
    while shift:
        shift -= STEP
        own = targets.select(F.col("_g").alias("_tg"), "_prefix").distinct()
        inside = values.join(F.broadcast(own), F.col("_g").eqNullSafe(F.col("_tg"))
                             & (F.shiftright(value, shift + STEP) == F.col("_prefix")))
        cells = inside.groupBy("_g", "_prefix", cell(shift).alias("_cell")).agg(F.count(F.lit(1)).alias("_n"))
        found = _located(cells, targets, ["_g", "_prefix"])
        prefix = F.shiftleft(F.col("_prefix"), STEP) + F.col("_cell")
        targets = freeze(found.select("_g", "_slot", prefix.alias("_prefix"), "_rank"), "targets")
    named = sizes.select(F.col("_g").alias("_sg"), "_size")
    return targets.join(F.broadcast(named), F.col("_g").eqNullSafe(F.col("_sg"))).select(
        "_g", "_slot", F.col("_prefix").alias("_value"), "_rank", "_size")


def quantile_ranks(sizes: DataFrame, probs) -> DataFrame:
    """For each probability i the ranks below and above its position (n - 1) p, as slots 2 i and 2 i + 1."""
    ranks = []
    for i, p in enumerate(probs):
        low = F.floor(F.lit(float(p)) * (F.col("_size") - 1))
        ranks += [F.struct(F.lit(2 * i + k).alias("_slot"), (low + k).alias("_rank")) for k in (0, 1)]
    return sizes.select("_g", F.inline(F.array(*ranks)))


def quantile_value(i: int, p: float, n: Column, value: Callable[[int], Column]) -> Column:
    """Linear interpolation between the values of slots 2 i and 2 i + 1 of a group of ``n`` values."""
    h = F.lit(float(p)) * (n - 1)
    frac = h - F.floor(h)
    lo, hi = value(2 * i), F.coalesce(value(2 * i + 1), value(2 * i))
    return F.when(frac == 0, lo).otherwise(lo + (hi - lo) * frac)
