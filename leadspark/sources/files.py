"""Delimited-file lookups and table / file sinks.

Lookups arrive as CSV (spreadsheets are exported per sheet to CSV first).
They are read with an explicit schema: no inference pass over the data and
no type drift (a ZIP such as '01234' stays a string).  Null and empty text are
different: an empty field is null, a quoted empty field is the empty text.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadspark.session import scratch_path

_BAD = "_bad_record"
#: Stands for null inside the reader, so that a quoted empty field is not taken for one; no file contains it.
_NULL = "\u0001null\u0001"


def _reader(spark: SparkSession, header: bool, sep: str, multiline: bool):
    return (spark.read.option("header", header).option("sep", sep).option("nullValue", _NULL).option("emptyValue", "")
            .option("multiLine", multiline).option("quote", '"').option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))


def read_lookup_csv(spark: SparkSession, path: str, schema, header: bool = True, sep: str = ",",
                    multiline: bool = False) -> DataFrame:
    """A file's records; the first malformed one fails the job."""
    return _reader(spark, header, sep, multiline).schema(schema).option("mode", "FAILFAST").csv(path)


@dataclass
class FileRead:
    """Records of a lookup file, and what was found in it."""
    rows: DataFrame
    n_rows: int
    n_bad: int


def read_lookup(spark: SparkSession, path: str, schema: T.StructType, quarantine: str | None = None, header: bool = True,
                sep: str = ",", multiline: bool = True, most_bad: float = 1.0) -> FileRead:
    """A file's good records; malformed ones are set aside.

    The file is parsed once, into a written table, while the numbers of good and
    bad records are observed.  Bad ones (wrong number of fields, or a field that
    its column's type can't hold) are appended to the parquet folder
    ``quarantine`` as (path, read_id, record), the record as it stands in the
    file.  A file with a larger share of bad records than ``most_bad`` is refused:
    its layout is another one.  ``multiline`` reads quoted line breaks, for which a
    file is read by one task; without it a file is split.
    """
    if _BAD in schema.names:
        raise ValueError(f"{_BAD} is the name of the column of bad records")
    full = T.StructType([*[T.StructField(f.name, f.dataType) for f in schema], T.StructField(_BAD, T.StringType())])
    parsed = (_reader(spark, header, sep, multiline).schema(full).option("mode", "PERMISSIVE")
              .option("columnNameOfCorruptRecord", _BAD).csv(path))
    read_id, seen = uuid.uuid4().hex, Observation()
    target = scratch_path(spark, f"lookup_files/{read_id}")
    parsed.observe(seen, F.count(F.lit(1)).alias("n"), F.count(F.col(_BAD)).alias("bad")).write.parquet(target)
    n, bad = seen.get["n"], seen.get["bad"]
    written = spark.read.schema(full).parquet(target)
    if bad and quarantine:
        rows = written.where(F.col(_BAD).isNotNull()).select(
            F.lit(path).alias("path"), F.lit(read_id).alias("read_id"), F.col(_BAD).alias("record"))
        rows.write.mode("append").parquet(quarantine)
    if bad > most_bad * n:
        raise ValueError(f"{bad} of {n} records of {path} are malformed")
    return FileRead(written.where(F.col(_BAD).isNull()).drop(_BAD), n - bad, bad)


def save_table(df: DataFrame, target: str, mode: str = "overwrite", partition_by=None, as_table: bool = False) -> None:
    """Write a result: a catalog table (``as_table``) or a parquet folder."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    if as_table:
        w.saveAsTable(target)
    else:
        w.parquet(target)


def export_csv(df: DataFrame, path: str, header: bool = True) -> None:
    """CSV export written in parallel (one part file per task); null as an empty field, empty text as a quoted one."""
    (df.write.mode("overwrite").option("header", header).option("nullValue", "").option("emptyValue", '""')
     .option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))
