"""Reproducible split and exact class balancing.

``hash_split`` assigns a row by a bucket of md5(key:seed): the result does
not depend on partitioning or on the order of the input (``randomSplit``
does).  ``oversample`` balances classes exactly, with no driver collection:
with n_c rows in class c and m rows in the largest class, q, r = divmod(m,
n_c); every row is kept q times and the first r rows of the class in md5
order once more.  The hash up to which they go is found by counting
(``selection.select_ranks``), so no class is sorted; a row that needs
many copies (small classes) is cut into bounded chunks spread over the
partitions before the copies are generated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadspark.functions.exprs import col_of, md5_int
from leadspark.operators.attach import attach_row
from leadspark.operators.selection import select_ranks

#: A split compares the key's whole 32-bit hash with the weights' bounds.
HASHES = 1 << 32


def split_bucket(key, seed: int) -> object:
    return md5_int(key, F.lit(str(seed)))


def assign_split(df: DataFrame, key: str, weights=(0.8, 0.2), seed: int = 42, names=("train", "test"),
                 out: str = "split") -> DataFrame:
    """Add ``out`` naming the part of each row; weights are normalised."""
    total = float(sum(weights))
    b = split_bucket(col_of(key), seed)
    expr, acc = None, 0.0
    for w, name in zip(weights[:-1], names[:-1]):
        acc += w / total
        cut = int(round(acc * HASHES))
        expr = F.when(b < cut, F.lit(name)) if expr is None else expr.when(b < cut, F.lit(name))
    last = F.lit(names[len(weights) - 1])
    return df.withColumn(out, last if expr is None else expr.otherwise(last))


def hash_split(df: DataFrame, key: str, weights=(0.8, 0.2), seed: int = 42) -> list:
    names = [f"p{i}" for i in range(len(weights))]
    tagged = assign_split(df, key, weights, seed, names, "_part")
    return [tagged.filter(F.col("_part") == n).drop("_part") for n in names]


def oversample(df: DataFrame, label: str = "label", key: str = "MDM_CUST_KEY", seed: int = 42,
               copy_col: str = "COPY", chunk: int = 10_000) -> DataFrame:
    """Every class grows to the size of the largest; ``copy_col`` = 0 marks the
    original row, 1.. its copies.

    ``key`` tells the rows of a class apart.  The hash at rank r of a class is
    found by counting hashes (and, among rows of that very hash, the key), so the
    rows themselves are neither sorted nor written: each is compared with its
    class's cut.
    """
    h = md5_int(col_of(key), F.lit(str(seed)), F.lit("oversample"))
    hashes = df.select(col_of(label).alias("_g"), h.alias("_value"), col_of(key).alias("_key"))

    def wanted(sizes: DataFrame) -> DataFrame:
        mx = sizes.agg(F.max("_size").alias("_mx"))
        return attach_row(sizes, mx).select("_g", F.floor(F.col("_mx") / F.col("_size")).cast("int").alias("_slot"),
                                            (F.col("_mx") % F.col("_size")).alias("_rank"))
    # one row per class: its slot is the number of copies that each row gets
    cuts = select_ranks(hashes.select("_g", "_value"), wanted, bits=32)
    cuts = cuts.select(F.col("_g").alias("_lab"), F.col("_slot").alias("_q"), F.col("_value").alias("_cut"),
                       F.col("_rank").alias("_more"))
    # among rows of the cut's own hash, the first by key
    same = hashes.join(F.broadcast(cuts), F.col("_g").eqNullSafe(F.col("_lab")) & (F.col("_value") == F.col("_cut")))
    place = F.row_number().over(Window.partitionBy("_g").orderBy("_key"))
    last = same.where("_more > 0").withColumn("_place", place).where("_place = _more").select(
        F.col("_g").alias("_llab"), F.col("_key").alias("_last"))
    plan = cuts.join(F.broadcast(last), F.col("_lab").eqNullSafe(F.col("_llab")), "left").select(
        "_lab", "_q", "_cut", "_last")
    first = (F.col("_h") < F.col("_cut")) | ((F.col("_h") == F.col("_cut")) & (col_of(key) <= F.col("_last")))
    j = df.withColumn("_h", h).join(F.broadcast(plan), col_of(label).eqNullSafe(F.col("_lab")))
    j = j.withColumn("_copies", F.col("_q").cast("long") + F.when(first, 1).otherwise(0))
    cols = [col_of(c) for c in df.columns]
    # rows are cut into chunk rows of at most ``chunk`` copies and spread over the
    # partitions first: no task generates a large share of the output
    j = j.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"),
                                                    F.ceil(F.col("_copies") / F.lit(chunk)) - 1)))
    j = j.repartition(col_of(key), F.col("_chunk"))
    first = F.col("_chunk") * chunk
    j = j.withColumn(copy_col, F.explode(F.sequence(
        first, first + F.least(F.lit(chunk).cast("long"), F.col("_copies") - first) - 1)))
    return j.select(*cols, F.col(copy_col).cast("int").alias(copy_col))
