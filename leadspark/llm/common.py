"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadspark.session import ensure_checkpoint_dir, freeze, scratch_path, ship_package

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: space, tab, line feed, vertical tab, form feed, carriage return
SPACES = " \t\n\x0b\x0c\r"

__all__ = ["UPPER", "SPACES", "ensure_checkpoint_dir", "freeze", "read", "ascii_lower", "let", "words",
           "spread_join", "shuffle_partitions", "ship_package", "keep_rows", "scratch_folder", "text_digest"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder for written intermediates, in the session's checkpoint folder."""
    return scratch_path(spark, f"{name}/{uuid.uuid4().hex}")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(c, F.lit("")), UPPER, UPPER.lower())


def text_digest() -> Column:
    """SHA-256 of the column ``text``, 32 bytes; null counts as empty.

    What is judged by the text alone is told by it: rows without an id, or of one id, are not judged together.
    """
    return F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, wherever the result is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(c: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text after lower-casing A-Z; null or no word gives an empty array."""
    t = F.translate(F.coalesce(c, F.lit("")), UPPER + SPACES[1:], UPPER.lower() + " " * len(SPACES[1:]))
    return F.array_remove(F.split(t, " "), "")


def spread_join(rows: DataFrame, unique: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``rows`` joined with one row per ``key``, with hot keys apart.

    ``size`` says how many of the ``total`` rows have the key.  Keys with more
    than a thousandth of all rows - a thousand at most, so that broadcasting
    them is bounded - are joined where the rows lie; the others by a shuffle in
    which no key is large.
    """
    is_hot = F.col(size) * 1000 > total
    hot = unique.where(is_hot)
    marked = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(marked.join(unique.where(~is_hot), key))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def keep_rows(docs: DataFrame, keep: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose key is in ``keep`` (null matches null), with the columns of ``docs``."""
    k = keep.select(F.col(key).alias("__llm_keep"))
    return docs.join(k, docs[key].eqNullSafe(F.col("__llm_keep")), "left_semi")
