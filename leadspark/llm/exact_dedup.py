"""Exact de-duplication over a persistent digest index.

The index is a table bucketed and sorted by the SHA-256 digest of the
normalised text (A-Z lower-cased).  A batch is reduced to one row per digest
(map-side partial aggregation, so a text held by a third of all rows reaches
the shuffle as one row per task), anti-joined with the index (sort-merge: the
index side is read in its stored buckets, without a shuffle) and what is left
is appended in the same bucket layout.

Defined results: a null text counts as empty; empty texts are equal to each
other; of equal texts in one batch the largest ``doc_id`` stays (null is
smaller than any id); rows that agree in ``doc_id`` as well are one document
and share its flags; an empty batch appends nothing; extra columns are ignored.
Texts are hashed whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadspark.llm import common as C

def _digest() -> Column:
    return F.unhex(F.sha2(C.ascii_lower(F.col("text")).cast("binary"), 256))


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest): the digest of each row's normalised text, 32 bytes."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _digest().alias("digest"))


class DigestIndex:
    """Persistent index (digest, keep_id, group_size), bucketed and sorted by digest."""

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int):
        self.spark, self.name, self.path, self.buckets = spark, name, path, buckets

    def _append(self, rows: DataFrame) -> None:
        (rows.repartition(self.buckets, "digest")
         .write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest")
         .option("path", self.path).saveAsTable(self.name))

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def ingest(self, batch: DataFrame) -> None:
        """Add the digests of ``batch`` (doc_id, digest) that the index does not hold.

        Entries already in the index stay as they are: their document was
        published earlier, so it remains the one that is kept.
        """
        if not self.exists():
            self._append(batch.select("digest", F.lit(0).cast("long").alias("keep_id"),
                                      F.lit(0).cast("long").alias("group_size")).where(F.lit(False)))
        rows = batch.groupBy("digest").agg(F.max("doc_id").alias("keep_id"),
                                           F.count(F.lit(1)).alias("group_size"))
        # written, for the optimizer would move the anti-join below the aggregate and shuffle all rows of a digest
        rows = C.freeze(rows, "llm_digest_groups")
        known = self.table().select("digest").hint("merge")
        self._append(rows.join(known, "digest", "left_anti"))

    def flags(self, batch: DataFrame) -> DataFrame:
        """Each row of ``batch`` with keep_id, group_size and whether it is the one that stays.

        The index is cut to the batch's digests first, written once.  The few
        that hold more than a thousandth of the batch - of this batch, whatever
        their groups had in earlier ones - are joined apart.
        """
        own = batch.groupBy("digest").agg(F.count(F.lit(1)).alias("__llm_rows"))
        entries = C.freeze(self.table().hint("merge").join(own, "digest"), "llm_digest_entries")
        out = C.spread_join(batch, entries, "digest", "__llm_rows", batch.count()).drop("__llm_rows")
        return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def temporary_index(spark: SparkSession) -> DigestIndex:
    """An index in the shared scratch folder, for one run."""
    tag = uuid.uuid4().hex
    base = C.ensure_checkpoint_dir(spark).rstrip("/")
    return DigestIndex(spark, f"llm_digest_{tag}", f"{base}/llm_digest_{tag}", C.shuffle_partitions(spark))


def dedup(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, digest, keep_id, group_size, kept.

    The digests are written once, so the texts are read and hashed once.
    """
    spark = docs.sparkSession
    index = index or temporary_index(spark)
    batch = C.freeze(digests(docs), "llm_digests")
    index.ingest(batch)
    return index.flags(batch)


def keep_first(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; rows equal in id and normalised text come once.

    A row is told by its id and digest together, so different texts without an id, or of one id, all stay.
    """
    kept = dedup(docs, index).where("kept").select(F.col("doc_id").alias("__llm_keep"),
                                                   F.col("digest").alias("__llm_kept")).distinct()
    rows = docs.withColumn("__llm_digest", _digest())
    rows = rows.join(kept, (F.col("__llm_digest") == F.col("__llm_kept"))
                     & F.col("doc_id").eqNullSafe(F.col("__llm_keep")), "left_semi")
    same = W.partitionBy("doc_id", "__llm_digest").orderBy("text")
    return (rows.withColumn("__llm_copy", F.row_number().over(same)).where("__llm_copy = 1")
            .drop("__llm_copy", "__llm_digest"))


# -- query --------------------------------------------------------------------

def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the document that stays of its group of equal texts."""
    out = dedup(C.read(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept",
                      F.lower(F.hex("digest")).alias("text_sha256"))


SQL = """
with d as (
  select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                  'abcdefghijklmnopqrstuvwxyz')) as text_sha256
  from documents),
g as (select text_sha256, max(doc_id) as keep_id, count(*) as group_size from d group by text_sha256)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from d join g using (text_sha256)
"""
