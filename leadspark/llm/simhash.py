"""SimHash near-duplicates: segment-popcount embedding, grid range-join, exact verification.

A 64-bit fingerprint is cut into segments; the vector of the segments' bit
counts is its embedding.  The Manhattan distance of two vectors never exceeds
the Hamming distance of the fingerprints, so fingerprints at Hamming distance
two or less lie within Manhattan distance two.  Each fingerprint is entered in
its own grid cell and the cells one step away; two vectors within distance two
meet in such a cell, and a rule on the two steps picks exactly one of the cells
they may meet in.  What meets is verified on the fingerprints themselves.

* Copies collapse first: only distinct fingerprints are joined.
* Cells that only one fingerprint enters (nearly all) are dropped before the join.
* A cell that more than ``DENSE`` fingerprints enter (a large group of near
  copies) is not paired up: its fingerprints are linked through the 65 words
  within one bit of each.  Two fingerprints share such a word exactly if they
  differ in at most two bits, so components are the same, and the rows are 65
  a fingerprint instead of a square.

More segments make cells more selective, and each fingerprint enters more of
them (two a segment and its own).  The number of segments follows from the count
of distinct fingerprints: the fewest of 16 and 32 with which a random
fingerprint meets at most ``MEETINGS`` others; pairs and components are the same.

Defined results: a null or empty text, or one of white space only, has
fingerprint zero and is linked like any other; fewer words than a shingle
give one shingle of all words; repeated rows share fingerprint and component;
a null ``doc_id`` never names a component unless it has no other member; an
empty table gives an empty result; other columns are ignored, whatever their
names.  ``keep_one`` keeps one row of a component: of those with its smallest
id (null if no row has one) the one whose text has the smallest SHA-256.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from leadspark.llm import common as C
from leadspark.llm.components import components

SHINGLE = 3
MAX_BITS = 2
SEED = 42
#: Numbers of segments to choose from.
SEGMENTS = (16, 32)
#: Random fingerprints that one may meet; beyond, more segments are taken.
MEETINGS = 8
#: A cell with more fingerprints is linked by words within one bit instead of pairs.
DENSE = 64
#: Bytes of text whose words are held at once.
PIECE = 1 << 22
_GAP = re.compile(rb"[ \t-\r]")


def _pieces(data: bytes) -> Iterator[list[bytes]]:
    """Words of a text, in lists of about PIECE bytes."""
    at = 0
    while at < len(data):
        gap = _GAP.search(data, at + PIECE) if at + PIECE < len(data) else None
        end = gap.start() if gap else len(data)
        yield data[at:end].split()
        at = end


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of the k-word shingles of the whole text, repeats included."""
    counts, n, tail = np.zeros(64, np.int64), 0, []
    for part in _pieces((text or "").encode("utf-8", "surrogatepass").lower()):
        w = tail + part
        if len(w) >= k:
            grams = map(b" ".join, zip(*(w[i:] for i in range(k))))
            h = np.fromiter(map(xxh64_intdigest, grams, repeat(SEED)), np.uint64, len(w) - k + 1)
            counts += _bit_counts(h)
            n += len(h)
        tail = w[-(k - 1):] if k > 1 else []
    if not n:
        if not tail:
            return 0
        counts, n = _bit_counts(np.array([xxh64_intdigest(b" ".join(tail), SEED)], np.uint64)), 1
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, k: int = SHINGLE, digests: bool = False) -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed long; with ``digests`` also the text's digest."""
    names = ["doc_id", "fp", "digest"] if digests else ["doc_id", "fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), k) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64()), *b.columns[2:]], names)
    more = [C.text_digest().alias("digest")] if digests else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)
    return rows.mapInArrow(run, "doc_id long, fp long" + (", digest binary" if more else ""))


def meeting_share(segments: int) -> float:
    """Share of pairs of random fingerprints whose bit counts lie within Manhattan distance two."""
    width = 64 // segments
    each = np.array([comb(2 * width, width + d) for d in range(-width, width + 1)]) / 4.0 ** width
    step = np.array([each[width], 2 * each[width + 1], 2 * each[width + 2]])  # a segment's distance is 0, 1, 2
    total = np.array([1.0, 0.0, 0.0])
    for _ in range(segments):
        total = np.array([total[0] * step[0], total[0] * step[1] + total[1] * step[0],
                          total[0] * step[2] + total[1] * step[1] + total[2] * step[0]])
    return float(total.sum())


def segments_for(fingerprints: int) -> int:
    """The fewest segments with which a random fingerprint meets at most MEETINGS of so many others."""
    return next((s for s in SEGMENTS if meeting_share(s) * fingerprints <= MEETINGS), SEGMENTS[-1])


def _cells(fps: DataFrame, segments: int) -> DataFrame:
    """(fp, cell, step): the fingerprint's own cell (step 0) and those one step away (+i, -i)."""
    width = 64 // segments
    counts = [F.bit_count(F.shiftrightunsigned("fp", width * i).bitwiseAND(F.lit((1 << width) - 1)))
              for i in range(segments)]
    rows = fps.select("fp", F.array(*counts).alias("c"))
    base = [(width + 1) ** i for i in range(segments)]
    own = sum((F.col("c")[i] * F.lit(base[i]).cast("long") for i in range(segments)), F.lit(0).cast("long"))
    rows = rows.withColumn("own", own)

    def at(cell: Column, step: int, inside: Column | None = None) -> Column:
        s = F.struct(cell.alias("cell"), F.lit(step).alias("step"))
        return s if inside is None else F.when(inside, s)
    steps = [at(F.col("own"), 0)]
    for i in range(segments):
        steps += [at(F.col("own") + F.lit(base[i]).cast("long"), i + 1, F.col("c")[i] < width),
                  at(F.col("own") - F.lit(base[i]).cast("long"), -i - 1, F.col("c")[i] > 0)]
    return rows.select("fp", F.explode(F.array(*steps)).alias("s")).where("s is not null").select(
        "fp", "s.cell", "s.step")


def _paired(rows: DataFrame, max_bits: int) -> DataFrame:
    """Pairs that meet in a cell, each in one cell only, verified on the fingerprints."""
    a = rows.select("cell", F.col("fp").alias("a"), F.col("step").alias("sa"))
    b = rows.select("cell", F.col("fp").alias("b"), F.col("step").alias("sb"))
    one = "sa = 0 or (sb != 0 and (abs(sa) < abs(sb) or sa = -sb))"
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    return a.join(b, (a["cell"] == b["cell"]) & (F.col("a") < F.col("b")) & F.expr(one) & close).select("a", "b")


def _starred(fps: DataFrame) -> DataFrame:
    """Links between fingerprints that share a word within one bit: each to the smallest."""
    words = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.shiftleft(F.lit(1).cast("long"), i)) for i in range(64)])
    near = fps.select("fp", F.explode(words).alias("word"))
    low = near.groupBy("word").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return near.join(low, "word").where("fp != a").select("a", F.col("fp").alias("b")).distinct()


def links(fps: DataFrame, max_bits: int = MAX_BITS, segments: int | None = None,
          dense: int = DENSE) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of distinct ``fp`` at most max_bits apart."""
    if not 0 <= max_bits <= 2:
        raise ValueError("cells one step away cover distances up to two bits")
    cells = _cells(fps, segments or segments_for(fps.count()))
    shared = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = C.freeze(shared, "llm_cells")
    meet = C.freeze(cells.join(shared, "cell"), "llm_meet")
    pairs = _paired(meet.where(F.col("n") <= dense), max_bits)
    if max_bits < 2:  # words within one bit stand for two bits: pair up whatever the size
        return _paired(meet, max_bits)
    return pairs.unionByName(_starred(meet.where(F.col("n") > dense).select("fp").distinct()))


def near_duplicates(docs: DataFrame, k: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over links."""
    return _members(C.freeze(fingerprints(docs, k), "llm_fp"), max_bits).select("doc_id", "fp", "component_id")


def _members(rows: DataFrame, max_bits: int) -> DataFrame:
    """``rows`` (doc_id, fp, ...) with ``root``, a fingerprint of the component, and ``component_id``."""
    groups = rows.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n"))
    groups = C.freeze(groups, "llm_fp_groups")
    roots = components(links(groups.select("fp"), max_bits), "a", "b")
    named = groups.join(roots, groups["fp"] == roots["node"], "left").select(
        "fp", "low", "n", F.coalesce("root", "fp").alias("root"))
    named = C.freeze(named, "llm_named")
    low = named.groupBy("root").agg(F.min("low").alias("component_id"))
    labels = named.join(low, "root").select("fp", "n", "root", "component_id")
    return C.spread_join(rows, labels, "fp", "n", rows.count())


def keep_one(docs: DataFrame, k: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of ``docs`` of each component, with its columns: of the smallest id, then of the smallest digest."""
    rows = _members(C.freeze(fingerprints(docs, k, digests=True), "llm_fp"), max_bits)
    rows = rows.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    rows = rows.groupBy("root", "doc_id", "digest").agg(F.count(F.lit(1)).alias("n"))
    first = rows.groupBy("root", "doc_id").agg(F.min(F.struct("digest", "n")).alias("s"))
    first = first.select(F.col("doc_id").alias("__llm_id"), F.col("s.digest").alias("__llm_first"), "s.n")
    first = C.freeze(first, "llm_first")
    named = docs.withColumn("__llm_digest", C.text_digest())
    here = (F.col("__llm_digest") == F.col("__llm_first")) & named["doc_id"].eqNullSafe(F.col("__llm_id"))
    again = first.where("n > 1")
    if again.isEmpty():
        return named.join(first, here, "left_semi").drop("__llm_digest")
    # rows that agree in id and text come once
    copies = W.partitionBy("doc_id", "__llm_digest").orderBy("__llm_digest")
    one = named.join(again, here, "left_semi").withColumn("__llm_copy", F.row_number().over(copies))
    once = named.join(first.where("n = 1"), here, "left_semi")
    return once.unionByName(one.where("__llm_copy = 1").drop("__llm_copy")).drop("__llm_digest")


# -- query --------------------------------------------------------------------

def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and component."""
    out = near_duplicates(C.read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
