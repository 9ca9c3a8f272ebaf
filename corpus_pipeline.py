"""Training-data pipeline: stages over ``documents``, each written as Parquet and read by the next.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame.  All but the last return rows of ``docs`` with its
columns; the last returns the token ids of what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadspark.llm import common as C
from leadspark.llm import decontaminate, exact_dedup, quality, sentencepiece_codec, simhash


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted to the weak labels of ``docs``, does not reject (operator 2)."""
    C.ship_package(spark)
    return quality.keep_good(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one of the largest id (operator 8)."""
    return exact_dedup.keep_first(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies, the one of the smallest id (operator 9)."""
    C.ship_package(spark)
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of the table ``benchmark`` (operator 3)."""
    return decontaminate.clean(docs, C.read(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text (operator 4)."""
    C.ship_package(spark)
    coded = sentencepiece_codec.round_trip(docs)
    return coded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.col("same").alias("round_trip"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_duplicates),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding and decoding", tokens),
]

#: No SQL for the whole pipeline: the fitted classifier and the tokenizer are not expressible.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, in order, over the whole table ``documents``."""
    docs = C.read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = C.freeze(stage(spark, docs, sf_dir), "llm_stage")
    return docs
