"""A store of lookups that lie together by key: bucketed tables joined without a shuffle.

Each table is written once, dealt into the same number of buckets by a join key that
is never null, and sorted by it.  Joins of the store's tables on that key read bucket
against bucket, so a chain of any number of lookups moves no rows.

The join key stands for the key *and* its nullness ("=" and the key, or "" for
null), so null keys match null keys, as in pandas merges, by a plain equality; the
null-safe operator would hide the buckets from the planner.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadspark.functions.exprs import col_of
from leadspark.session import keep_table, scratch_path

JOIN_KEY = "_join_key"


def join_key(key) -> Column:
    c = col_of(key).cast("string")
    return F.when(c.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), c))


class LookupStore:
    """Tables of one customer key, in ``buckets`` buckets each."""

    def __init__(self, spark: SparkSession, buckets: int):
        self.spark, self.buckets, self.names = spark, buckets, {}

    def write(self, name: str, df: DataFrame, key: str) -> DataFrame:
        """Write ``df`` as the store's table ``name`` and return it, with its join key."""
        table = f"lookup_store_{name}_{uuid.uuid4().hex}"
        rows = df.withColumn(JOIN_KEY, join_key(key)).repartition(self.buckets, F.col(JOIN_KEY))
        # "path" keeps the files in the shared folder of written intermediates
        (rows.write.format("parquet").bucketBy(self.buckets, JOIN_KEY).sortBy(JOIN_KEY)
         .option("path", scratch_path(self.spark, f"store/{table}")).saveAsTable(table))
        keep_table(self.spark, table)
        self.names[name] = table
        return self.table(name)

    def table(self, name: str) -> DataFrame:
        return self.spark.table(self.names[name])

    def join(self, left: DataFrame, name: str, how: str = "left", cols=None) -> DataFrame:
        """``left`` (with its join key) and the columns ``cols`` of a table of the store."""
        right = self.table(name)
        if cols is not None:
            right = right.select(JOIN_KEY, *[col_of(c) for c in cols])
        clash = (set(left.columns) & set(right.columns)) - {JOIN_KEY}
        if clash:
            raise ValueError(f"columns on both sides: {sorted(clash)}")
        return left.join(right, JOIN_KEY, how)
