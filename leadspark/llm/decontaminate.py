"""Benchmark decontamination: short test items found inside long documents.

An item is contained in a document if at least ``CONTAINMENT`` of its distinct
five-word shingles occur there.  Jaccard similarity of an item and a long
document is tiny, so signatures of whole documents cannot find it; what the
search needs is a sketch of the *item*.  Items are partitioned by the number of
their shingles (powers of two).  An item of n shingles that is contained lacks
at most n - ceil(0.8 n) of them, so of its k = n - ceil(0.8 n) + 1 smallest
shingle hashes (its bottom-k MinHash sketch, k taken at the partition's largest
size) at least one occurs in the document: every contained item is a
candidate, without chance.  Documents are streamed once: their shingle hashes
probe the sketches, and a document hash in no sketch ends there.  Candidates
are verified on the shingles themselves.

Whole texts and all shingles are used.  The item side is as large as the
benchmark; the planner broadcasts it only if its size on disk allows, else
both sides are shuffled by hash (with Spark's own runtime Bloom filter).

Defined results: texts are lower-cased (A-Z) and cut at white space; an item
of fewer than five words is one shingle of all its words and searched for as
such; an item without words, or a null text, is never found; rows with equal
``doc_id`` (or ``item_id``) are judged as one document (item); a null id is an
id like any other; texts of any length are read whole; an empty table of
documents or items gives no pairs; other columns are ignored, whatever their
names.  ``clean`` judges each row by its own text, whatever its id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadspark.llm import common as C

SHINGLE = 5
CONTAINMENT = 0.8


def _zip(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.xxhash64(x, y))


def _from(a: Column, start: int) -> Column:
    return F.slice(a, F.lit(start), F.greatest(F.size(a), F.lit(1)))


def _hashes(w: Column, width: int) -> Column:
    """Hashes of the shingles of ``width`` words, one per position: words are hashed once, then combined."""
    def combine(h: Column) -> Column:
        if width == 1:
            return h
        two = _zip(h, _from(h, 2))
        if width == 2:
            return _cut(two, h)
        if width == 3:
            return _cut(_zip(two, _from(h, 3)), h)

        def four(t: Column) -> Column:
            f = _zip(t, _from(t, 3))
            return _cut(f if width == 4 else _zip(f, _from(h, 5)), h)
        return C.let(two, four)

    def _cut(s: Column, h: Column) -> Column:
        return F.slice(s, F.lit(1), F.greatest(F.size(h) - (width - 1), F.lit(0)))
    return C.let(F.transform(w, lambda x: F.xxhash64(x)), combine)


def _texts(w: Column, width: int) -> Column:
    """The distinct shingles of ``width`` words themselves."""
    def at(a: Column) -> Column:
        n = F.size(a) - (width - 1)
        grams = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))),
                            lambda i: F.concat_ws(" ", *[F.get(a, i + j) for j in range(width)]))
        return F.when(n > 0, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))
    return C.let(w, at)


def _by_width(rows: DataFrame, make, widths: list[int], out: str) -> DataFrame:
    """One row per shingle of a row whose ``width`` it is (or of every width, for documents)."""
    parts = []
    for n in widths:
        own = rows.where(F.col("width") == n) if "width" in rows.columns else rows
        parts.append(own.select(*[c for c in rows.columns if c not in ("w", "width")],
                                F.lit(n).alias("width"), F.explode(make(F.col("w"), n)).alias(out)))
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    return all_


def sketches(hashes: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """(item_id, width, h) of the bottom-k hashes of each item, k by size partition."""
    sized = hashes.distinct().withColumn("n", F.count(F.lit(1)).over(W.partitionBy("item_id", "width")))
    top = F.pow(F.lit(2), F.ceil(F.log2("n"))).cast("long")  # largest size of the item's partition
    k = top - F.ceil(top * F.lit(containment) - F.lit(1e-9)) + 1
    rank = F.row_number().over(W.partitionBy("item_id", "width").orderBy(F.xxhash64("h")))
    return sized.withColumn("k", k).withColumn("r", rank).where("r <= k").select("item_id", "width", "h")


def contained(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT,
              shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, item_id, n_shared, n_shingles) of every item contained in a document."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return _contained(d, items, containment, shingle)


def _contained(d: DataFrame, items: DataFrame, containment: float, shingle: int = SHINGLE) -> DataFrame:
    """As ``contained``, for rows (doc_id, text) with a ``doc_id`` of any type."""
    i = items.select(F.col("item_id").cast("long").alias("item_id"), C.words(F.col("text")).alias("w"))
    i = i.withColumn("width", F.least(F.size("w"), F.lit(shingle))).where("width > 0")
    i = C.freeze(i, "llm_items")
    widths = [r[0] for r in i.select("width").distinct().orderBy("width").collect()]  # at most `shingle` values
    if not widths:
        return d.where(F.lit(False)).select("doc_id", F.lit(0).cast("long").alias("item_id"),
                                            F.lit(0).cast("long").alias("n_shared"),
                                            F.lit(0).cast("long").alias("n_shingles"))
    sketch = C.freeze(sketches(_by_width(i, _hashes, widths, "h"), containment), "llm_sketch")
    texts = _by_width(i, _texts, widths, "s").distinct()
    texts = texts.withColumn("n_shingles", F.count(F.lit(1)).over(W.partitionBy("item_id")))
    texts = C.freeze(texts, "llm_item_shingles")

    probes = _by_width(d.select("doc_id", C.words(F.col("text")).alias("w")), _hashes, widths, "h")
    found = probes.join(sketch, ["width", "h"]).select("doc_id", "item_id").distinct()
    found = C.freeze(found, "llm_candidates")

    some = C.keep_rows(d, found.select("doc_id").distinct())
    own = _by_width(some.select("doc_id", C.words(F.col("text")).alias("w")), _texts, widths, "s")
    shared = (own.join(texts, ["width", "s"]).groupBy("doc_id", "item_id")
              .agg(F.countDistinct("s").alias("n_shared"), F.max("n_shingles").alias("n_shingles")))
    shared = shared.where(F.col("n_shared") >= F.col("n_shingles") * F.lit(containment) - F.lit(1e-9))
    f = found.select(F.col("doc_id").alias("__d"), F.col("item_id").alias("__i"))
    return shared.join(f, F.col("doc_id").eqNullSafe(F.col("__d")) & F.col("item_id").eqNullSafe(F.col("__i")),
                       "left_semi")


def clean(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """The rows of ``docs`` whose text contains no item, with their columns."""
    d = docs.select(C.text_digest().alias("doc_id"), F.col("text").cast("string").alias("text"))
    bad = _contained(d, items, containment).select(F.col("doc_id").alias("__llm_digest")).distinct()
    return docs.withColumn("__llm_digest", C.text_digest()).join(bad, "__llm_digest", "left_anti").drop("__llm_digest")


# -- query --------------------------------------------------------------------

def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) pair with the item contained in the document."""
    out = contained(C.read(spark, sf_dir, "documents"), C.read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", "n_shared", "n_shingles",
                      (F.col("n_shared") / F.col("n_shingles")).alias("containment"))


def _sql_words(table: str, key: str) -> str:
    return (f"select {key}, list_filter(string_split_regex(translate(coalesce(text, ''), "
            f"'{C.UPPER}', '{C.UPPER.lower()}'), '[ \\t-\\r]+'), lambda x: x != '') as w from {table}")


SQL = f"""
with d as ({_sql_words('documents', 'doc_id')}),
i as ({_sql_words('benchmark', 'item_id')}),
widths as (select distinct least(len(w), {SHINGLE}) as k from i where len(w) > 0),
ish as (select distinct item_id, least(len(w), {SHINGLE}) as k,
               unnest(list_transform(range(1, len(w) - least(len(w), {SHINGLE}) + 2),
                      lambda p: array_to_string(w[p:p + least(len(w), {SHINGLE}) - 1], ' '))) as s
        from i where len(w) > 0),
n as (select item_id, count(*) as n_shingles from ish group by item_id),
dsh as (select distinct doc_id, k, unnest(list_transform(range(1, len(w) - k + 2),
                      lambda p: array_to_string(w[p:p + k - 1], ' '))) as s from d, widths where len(w) >= k),
m as (select doc_id, item_id, count(*) as n_shared from dsh join ish using (k, s) group by doc_id, item_id)
select doc_id, item_id, n_shared, n_shingles, n_shared / n_shingles as containment
from m join n using (item_id) where n_shared >= {CONTAINMENT} * n_shingles - 1e-9
"""
