"""Spelling variants: words one edit apart, found by a frontier that walks a relational trie.

The trie of all words is a distributed table, one row a node: the node is its
prefix, and holds the characters that lead on.  A state (word, position, node,
edits) says that the word's first ``position`` characters have been spelt on the
way to the node.  Level by level the states whose node has that depth are joined
with the nodes and move on: along the word's own character, or, with no edit
made, along another character (replaced) or past a character of the word
(deleted).  A state that spells its whole word with one edit and stands on a word
has found a neighbour.  An insertion is the deletion seen from the other word,
and of a replacement the word with the smaller character looks for the other;
pairs are mirrored in the end.

What keeps the frontier small, without losing a pair:

* The edit lies in the word's second half or in the second half of the word
  spelt backwards.  Both tries are walked, and a word may be edited only from its
  middle on: up to there its own path is known, so it enters at its middle.
* Each child carries a 64-bit signature of the endings below it.  A state moves
  only where the bit of what its word has left is set.

Words of more than ``LEVELS`` code points, which would need as many levels, are
compared by the hashes of the word without each of its characters, and verified.

Rows are joined with one row a node, so a prefix that many words share makes no
pairs of words; what a prefix's rows are summed up from is summed up before the
shuffle.  Each level is written to the shared scratch folder.

Defined results: a null or empty text has no runs; a null ``doc_id`` counts as
empty text before the colon; repeated rows are counted each; of equal counts the
form is the smallest word in code-point order; an empty table gives an empty
result; other columns of ``docs`` are not read.  Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadspark.llm import common as C
from leadspark.llm import textbytes as T

LETTERS = "A-Za-z\\u00C0-\\u00FF"
LEAST_LENGTH = 7
LEAST_COUNT = 2
#: A word's form occurs at least so many times as often.
RATIO = 10
#: One run in so many loses a character.
SLIPS = 31
#: Code points of the longest words that walk the trie.
LEVELS = 32
_TRIE = ("side int, node string, is_word int, next array<struct<c: string, ends: boolean, below: bigint>>, "
         "chars string, level int")


# -- words ----------------------------------------------------------------------

def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT,
                slips: int = SLIPS) -> DataFrame:
    """(word, n) of the words of whole texts that are long and frequent enough.

    A run whose checksum with its ``doc_id`` is divisible by ``slips`` counts
    without one of its characters.
    """
    runs = F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"[{LETTERS}]{{{least_length},}}+"), F.lit(0))
    own = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.select(own.alias("id"), F.explode(runs).alias("run"))
    # lower() changes A-Z only where all is ASCII, and is the faster there
    lower = F.when(F.octet_length("run") == F.length("run"), F.lower("run")).otherwise(
        F.translate("run", C.UPPER, C.UPPER.lower()))
    rows = rows.select("id", lower.alias("run"))
    rows = rows.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % slips == 0, F.concat(F.col("run").substr(F.lit(1), at),
                                                     F.col("run").substr(at + 2, F.length("run")))).otherwise(F.col("run"))
    words = rows.select(word.alias("word")).where(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


# -- trie -------------------------------------------------------------------------

def _bit(rest: Column) -> Column:
    """The bit of an ending in a signature."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(rest), F.lit(64)).cast("int"))


def _sides(words: DataFrame) -> DataFrame:
    """(side, w, size, middle): each word forwards (side 0) and backwards, and the place where it may be edited first."""
    size, half = F.length("word"), F.floor(F.length("word") / 2).cast("int")
    forms = F.array(F.struct(F.lit(0).alias("side"), F.col("word").alias("w"), size.alias("size"), half.alias("middle")),
                    F.struct(F.lit(1).alias("side"), F.reverse("word").alias("w"), size.alias("size"),
                             (size - half).alias("middle")))
    return words.select(F.inline(forms))


def _from(w: str, at) -> Column:
    """The characters of ``w`` from the place ``at`` (0 is the first) on."""
    return F.col(w).substr(at + 1, F.length(w))


def trie(words: DataFrame) -> DataFrame:
    """(side, level, node, is_word, next, chars): the nodes from each word's middle to its end.

    ``next`` lists a node's characters: (c, ends, below), whether a word ends
    there and the signature of the endings below; ``chars`` has the characters alone.
    """
    rows = _sides(words).select("side", "w", F.explode(F.sequence("middle", "size")).alias("level"))
    at = F.col("level")
    rows = rows.select("side", "level", F.col("w").substr(F.lit(1), at).alias("node"),
                       F.col("w").substr(at + 1, F.lit(1)).alias("c"), _from("w", at + 1).alias("rest"))
    edges = rows.groupBy("side", "level", "node", "c").agg(
        F.max((F.col("rest") == "").cast("int")).alias("ends"), F.bit_or(_bit(F.col("rest"))).alias("below"))
    edge = F.struct("c", (F.col("ends") == 1).alias("ends"), "below")
    nodes = edges.groupBy("side", "level", "node").agg(
        F.max((F.col("c") == "").cast("int")).alias("is_word"),
        F.collect_list(F.when(F.col("c") != "", edge)).alias("next"))
    return nodes.withColumn("chars", F.array_join("next.c", ""))


def _step(states: DataFrame, nodes: DataFrame) -> DataFrame:
    """The states that follow, one edit made; ``done`` ones stand on a word that their own word is one edit away from."""
    own = states.select(
        "side", "node", "w", "pos", "edits", F.col("w").substr(F.col("pos") + 1, F.lit(1)).alias("c0"),
        F.col("w").substr(F.col("pos") + 2, F.lit(1)).alias("c1"), _from("w", F.col("pos") + 1).alias("rest1"),
        _from("w", F.col("pos") + 2).alias("rest2"))
    own = own.withColumns({"bit1": _bit(F.col("rest1")), "bit2": _bit(F.col("rest2"))})
    j = own.join(nodes, ["node", "side"])  # sorted by what tells rows apart first
    # of a run of one character, the last is deleted
    may_drop = (F.col("edits") == 0) & (F.col("c0") != F.col("c1"))
    # most nodes have one way on, along the word itself: an edit leads nowhere there
    j = j.where((F.col("edits") == 1) | (F.col("chars") != F.col("c0"))
                | may_drop & (F.col("rest1") == "") & (F.col("is_word") == 1))

    def reaches(x, rest: str, bit: str) -> Column:
        return (x["below"].bitwiseAND(F.col(bit)) != 0) & ((F.col(rest) != "") | x["ends"])

    def moved(x, by: int, rest: str) -> Column:
        return F.struct(F.concat("node", x["c"]).alias("node"), (F.col("pos") + by).alias("pos"),
                        (F.col(rest) == "").alias("done"))
    along = F.transform(F.filter("next", lambda x: F.when(F.col("edits") == 1, x["c"] == F.col("c0"))
                                 .otherwise(x["c"] > F.col("c0")) & reaches(x, "rest1", "bit1")),
                        lambda x: moved(x, 1, "rest1"))
    past = F.transform(F.filter("next", lambda x: may_drop & (x["c"] == F.col("c1")) & reaches(x, "rest2", "bit2")),
                       lambda x: moved(x, 2, "rest2"))
    here = F.struct(F.col("node"), (F.col("pos") + 1).alias("pos"), F.lit(True).alias("done"))
    last = F.filter(F.array(here), lambda x: may_drop & (F.col("rest1") == "") & (F.col("is_word") == 1))
    return j.select("side", "w", F.inline(F.concat(along, past, last))).select("side", "node", "w", "pos", "done")


def _walk(words: DataFrame, shortest: int, longest: int) -> DataFrame | None:
    """(word, near) of words of up to ``longest`` code points, each pair in one direction at least."""
    if not longest:
        return None
    spark = words.sparkSession
    short = C.freeze(_sides(words.where(F.length("word") <= longest)), "llm_trie_words")
    folder = C.scratch_folder(spark, "llm_trie")
    trie(words.where(F.length("word") <= longest)).write.partitionBy("level").parquet(folder)
    nodes, found, states = spark.read.schema(_TRIE).parquet(folder), None, None
    for level in range(shortest // 2, longest):
        enter = short.where((F.col("middle") <= level) & (F.col("size") > level)).select(
            "side", F.col("w").substr(1, level).alias("node"), "w", F.lit(level).alias("pos"), F.lit(0).alias("edits"))
        if states is not None:
            enter = enter.unionByName(states.where("not done").select("side", "node", "w", "pos", F.lit(1).alias("edits")))
        states = C.freeze(_step(enter, nodes.where(F.col("level") == level).drop("level")), "llm_trie_states")
        done = states.where("done").select("side", "w", "node")
        found = done if found is None else found.unionByName(done)
    if found is None:
        return None

    def read(c: str) -> Column:
        return F.when(F.col("side") == 0, F.col(c)).otherwise(F.reverse(F.col(c)))
    return found.select(read("w").alias("word"), read("node").alias("near"))


# -- words that are longer ----------------------------------------------------------

def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, size, place, key, last) of a word without each of its characters, and of the whole word (place -1)."""
    back = T._inverse_power(1)
    for b in batches:
        for own, word in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            c = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64)
            n = len(c)
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((c + np.uint64(1)) * T.powers(n))))
            key = np.append(sums[:-1] + (sums[n] - sums[1:]) * back, sums[n])
            last = np.append(np.append(c[1:] != c[:-1], True), False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n + 1, own, np.int64)), pa.array(np.append(np.full(n, n - 1), n).astype(np.int32)),
                 pa.array(np.append(np.arange(n), -1).astype(np.int32)), pa.array(T.mix(key).view(np.int64)),
                 pa.array(last)], ["id", "size", "place", "key", "last"])


def _long_pairs(words: DataFrame, longest: int) -> DataFrame:
    """(word, near) of pairs with a word of more than ``longest`` code points."""
    some = words.where(F.length("word") >= longest).select(F.xxhash64("word").alias("id"), "word")
    some = C.freeze(some, "llm_long_words")
    keys = some.mapInArrow(_without, "id long, size int, place int, key long, last boolean")
    keys = C.freeze(keys, "llm_long_keys")
    other = keys.select(F.col("id").alias("other"), "size", "key", "place")
    cut = keys.where("place >= 0")
    replaced = cut.join(other, ["size", "key", "place"]).where("id < other")
    dropped = cut.where("last").drop("place").join(other.where("place < 0").drop("place"), ["size", "key"])
    pairs = replaced.select("id", "other").unionByName(dropped.select("id", "other")).distinct()
    pairs = pairs.join(some, "id").join(some.select(F.col("id").alias("other"), F.col("word").alias("near")), "other")
    pairs = pairs.where(F.levenshtein("word", "near", 1) == 1)
    return pairs.where(F.greatest(F.length("word"), F.length("near")) > longest).select("word", "near")


def near_pairs(words: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(word, near): each two of the distinct words of ``words`` that are one edit apart, in both orders."""
    words = words.select("word")
    shortest, longest = words.agg(F.min(F.length("word")), F.max(F.length("word"))).first()
    longest = longest or 0
    pairs = _walk(words, shortest or 0, min(longest, levels))
    if longest > levels:
        long = _long_pairs(words, levels)
        pairs = long if pairs is None else pairs.unionByName(long)
    if pairs is None:
        return words.select("word", F.col("word").alias("near")).where(F.lit(False))
    return pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("word").alias("near"))).distinct()


# -- forms ------------------------------------------------------------------------

def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form: the last form that forms lead to.

    Each round doubles the steps made; a form is ``RATIO`` times as frequent as
    its word, so rounds are few.
    """
    links = C.freeze(forms.select("word", F.col("form").alias("root")), "llm_roots")
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = links.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                    F.col("next").isNotNull().alias("moved"))
        links = C.freeze(new, "llm_roots")
        if not links.where("moved").limit(1).count():
            return links.select("word", "root")
        links = links.select("word", "root")


def variants(counts: DataFrame, ratio: int = RATIO, levels: int = LEVELS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every row of ``counts`` (word, n), whose words are distinct."""
    counts = C.freeze(counts.select("word", "n"), "llm_words")
    pairs = near_pairs(counts, levels)
    near = pairs.join(counts.select(F.col("word").alias("near"), F.col("n").alias("m")), "near")
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"),
                                    F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best"))
    named = counts.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.expr(f"if(-best.m >= {int(ratio)} * n, best.near, null)").alias("form"),
        F.expr(f"if(-best.m >= {int(ratio)} * n, -best.m, null)").alias("form_n"))
    named = C.freeze(named, "llm_forms")
    roots = _roots(named.where("form is not null"))
    return named.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


# -- query --------------------------------------------------------------------

def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents with its form, root, count and number of near words."""
    return variants(word_counts(C.read(spark, sf_dir, "documents")))
