"""A fact in one folder a year: years are loaded, loaded again and read one by one.

A load replaces the folders of its own years and leaves the others' files as
they are (dynamic partition overwrite), so a late correction of one year costs
one year of input and output.  Before the write the rows are rebalanced by
year: small years make one file, a large one is split over several tasks by
size, so no task holds a year and no year has a file from every task.

Defined results: rows of other years, or of no year, are not loaded; a year
without rows has no folder, also if it had one before; loading nothing into a
new folder gives an empty fact.  One load of a year at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

YEAR = "YYYY"


def load_years(rows: DataFrame, path: str, years, by: str = YEAR) -> dict[int, int]:
    """Replace ``years`` of the fact at ``path`` by their ``rows``; returns the rows written of each."""
    years = sorted({int(y) for y in years})
    if not years:
        return {}
    seen = Observation()
    counts = [F.count(F.when(F.col(by) == y, True)).alias(f"n{y}") for y in years]
    (rows.where(F.col(by).isin(years)).hint("rebalance", by).observe(seen, *counts)
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path))
    written = {y: seen.get[f"n{y}"] for y in years}
    _remove_folders(rows.sparkSession, [f"{path}/{by}={y}" for y, n in written.items() if not n])
    return written


def _remove_folders(spark: SparkSession, folders: list[str]) -> None:
    # a dynamic overwrite doesn't touch the folder of a year that has no rows any more
    for folder in folders:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def read_years(spark: SparkSession, path: str, schema: T.StructType, years=None, by: str = YEAR) -> DataFrame:
    """The fact, or only ``years`` of it: other folders are not listed into the scan."""
    fact = spark.read.schema(schema).parquet(path).select(*schema.names)
    return fact if years is None else fact.where(F.col(by).isin(sorted({int(y) for y in years})))
