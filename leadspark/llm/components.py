"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round is two aggregations and two equi-joins on the node; a node with
very many neighbours is reduced by map-side partial minima, and its rows in the
join are split by the skew join.  Rounds are written to the shared scratch
folder (lost executors only repeat one round) and their number grows with the
logarithm of the component size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadspark.llm import common as C

MAX_ROUNDS = 100


def _signature(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(r)


def _star_round(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m"))
    low = low.select("u", F.least("u", "m").alias("m"))
    large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    moved = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node that has an edge; root is the smallest node reachable.

    ``edges`` has two columns of one orderable type without nulls; direction
    and repeats don't matter, an edge to itself is ignored.
    """
    e = (edges.where(F.col(a) != F.col(b))
         .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    e = C.freeze(e, "llm_edges")
    before = _signature(e)
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            break
        e = C.freeze(_star_round(e), "llm_edges")
        after = _signature(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
