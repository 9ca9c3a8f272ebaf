"""Quality classifier from weak labels.

1. *Labellers.*  Overlapping heuristics vote good, bad or nothing on each
   document, from counts over its whole text.
2. *Label model.*  Documents are counted by their vote pattern (at most
   3^labellers groups, whatever the corpus), and expectation-maximisation over
   these counts estimates each labeller's rate of bad votes given the true
   class, and the class share.  Its result is P(good | pattern).
3. *Scorer.*  A linear model on hashed features (4-grams of character classes,
   words repeated in place) is fitted by logistic loss to the patterns'
   posterior labels of at most ``SAMPLE`` documents, those with the smallest
   hash of their id, and then scores every document.  It judges documents on
   which labellers abstain or disagree.

Counts, patterns and scores cover all documents and whole texts; the sample
bound concerns the fit alone.

Defined results: a null text, or one without words, gets no vote, has score
zero and is rejected; rows are judged by their own text, so rows without an
id, or of one id, are not judged together, and equal texts are scored alike;
rows without an id are in the fit's sample by the hash of their text; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadspark.llm import common as C
from leadspark.llm import textbytes as T

#: Documents the scorer is fitted on, at most.
SAMPLE = 8192
#: Hash buckets of the scorer's features.
BUCKETS = 1 << 14
#: 4-grams of a text that weigh as much as the usual log-odds.
LEAST_GRAMS = 16
#: A document scored below this is rejected: one that is at least three times as likely bad as good, for a filter
#: should keep clean documents rather than catch the last bad one.
KEEP_FROM = 0.25
#: Bad votes on good documents, at most, for any labeller.
FALSE_ALARM = 0.01
EM_ROUNDS = 200
FIT_ROUNDS = 300
GRAM = 4

# fixed values: frequent words of the languages
FUNCTION_WORDS = ("the of and to in is that for it with as was on be by are this "
                  "de la le les des et en un une que qui dans pour du est par sur pas "
                  "el los las una y por con se del al no "
                  "der die und das den von zu mit sich auf für ist im dem nicht ein eine").split()

GOOD, BAD, NONE = 1, 0, 2

# classes of bytes for the hashed 4-grams: letters of a case, digits, white space; others stand for themselves
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123] = 97
_CLASS[65:91] = 65
_CLASS[48:58] = 48
_CLASS[128:] = 97
_CLASS[[32, 9, 10, 11, 12, 13]] = 32


# marks that don't end a word of prose
_MARK = np.zeros(256, bool)
_MARK[list(b"#$%&*@^~+=|<>/_!;")] = True


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


#: name -> (signal, bad if ..., good if ...); a document with fewer units than the third number gets no vote
LABELLERS = {
    "symbols": ("symbol", lambda x: x > 0.06, lambda x: x < 0.02, 20),
    "capitals": ("upper", lambda x: x > 0.5, lambda x: x < 0.2, 20),
    "repeats": ("same", lambda x: x > 0.15, lambda x: x < 0.05, 20),
    "variety": ("variety", lambda x: x < 0.15, lambda x: x > 0.3, 30),
    "runs": ("run", lambda x: x > 0.1, lambda x: x < 0.02, 20),
    "function words": ("function", lambda x: x < 0.03, lambda x: x > 0.12, 20),
    "decorated words": ("decorated", lambda x: x > 0.2, lambda x: x < 0.05, 20),
    "doubled marks": ("doubled", lambda x: x > 0.2, lambda x: x < 0.05, 20),
    "separators": ("bar", lambda x: x > 0.15, lambda x: x < 0.02, 10),
    "sentence ends": ("stop", lambda x: x < 0.01, lambda x: (x > 0.05) & (x < 0.4), 30),
    "word length": ("long", lambda x: x > 0.3, lambda x: x < 0.1, 20),
}


class Distinct:
    """Distinct words of a text that comes in pieces: merged whenever as many new ones are held as merged ones."""

    def __init__(self):
        self.held, self.new, self.merged = [], 0, 0

    def add(self, hashes: np.ndarray) -> None:
        self.held.append(np.unique(hashes))
        self.new += len(self.held[-1])
        if self.new > max(self.merged, T.BLOCK):
            self._merge()

    def _merge(self) -> None:
        self.held = [np.unique(np.concatenate(self.held))]
        self.new, self.merged = 0, len(self.held[0])

    def take(self) -> int:
        """The number of distinct words; the next text begins."""
        self._merge()
        n = self.merged
        self.__init__()
        return n


def _signals(col: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Signals of the column's texts, and their numbers of words."""
    n = len(col)
    sums = {k: np.zeros(n) for k in ("bytes", "letters", "words", "symbol", "upper", "same", "function", "bar",
                                     "stop", "long", "decorated", "doubled", "variety", "run")}
    function = np.sort(np.array([T.hash_of(w) for w in FUNCTION_WORDS], np.uint64))
    back = np.zeros(0, np.int64), np.zeros(0, np.uint64)  # row and hash of the last two words of the blocks before
    seen = Distinct()
    for b, w, more in T.whole_words(col):
        if not len(b.buf):
            continue
        pos_row = np.repeat(b.row, b.end - b.start)

        def add(key, mask, row):
            sums[key] += np.bincount(row[mask], minlength=n)
        up = (b.buf >= 65) & (b.buf <= 90)
        letter = up | ((b.buf >= 97) & (b.buf <= 122))
        add("upper", up, pos_row)
        add("letters", letter, pos_row)
        add("symbol", np.isin(b.buf, np.frombuffer(b"#$%&*@^~<>{}[]\\=_+", np.uint8)), pos_row)
        sums["bytes"] += np.bincount(pos_row, minlength=n)
        row, lastb = w.row, w.last
        sums["words"] += np.bincount(row, minlength=n)
        rows, hashes = (np.concatenate(x) for x in zip(back, (row, w.hash)))
        same = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
        old = len(rows) - len(row)
        add("same", np.concatenate(([False], same))[:len(rows)][old:], row)
        add("run", np.concatenate(([False] * 2, same[1:] & same[:-1]))[:len(rows)][old:], row)
        back = rows[-2:], hashes[-2:]
        if more or seen.held:  # distinct words of the whole text
            seen.add(w.hash)
            if not more:
                sums["variety"][b.row[0]] += seen.take()
        else:
            order = np.lexsort((w.hash, row))
            fresh = np.ones(len(row), bool)
            fresh[1:] = (row[order][1:] != row[order][:-1]) | (w.hash[order][1:] != w.hash[order][:-1])
            add("variety", fresh, row[order])
        near = np.searchsorted(function, w.hash).clip(max=len(function) - 1)
        add("function", function[near] == w.hash, row)
        add("bar", (w.size == 1) & ((lastb == 124) | (lastb == 45) | (lastb == 42)), row)
        add("stop", (lastb == 46) | (lastb == 63) | ((lastb == 33) & (w.before != 33)), row)
        add("long", w.size > 14, row)
        mark = _MARK[lastb] & (w.size > 1)
        add("decorated", mark, row)
        add("doubled", mark & (w.before == lastb), row)
    words = sums["words"]
    out = {"symbol": _ratio(sums["symbol"], sums["bytes"]), "upper": _ratio(sums["upper"], sums["letters"])}
    per_word = sums.keys() - {"bytes", "letters", "words", "symbol", "upper"}
    out |= {k: _ratio(sums[k], words) for k in per_word}
    return out, words


def _votes(signals: dict[str, np.ndarray], words: np.ndarray) -> np.ndarray:
    """Vote of each labeller (columns) on each text."""
    cols = []
    for key, bad, good, least in LABELLERS.values():
        x = signals[key]
        cols.append(np.where(words < least, NONE, np.where(bad(x), BAD, np.where(good(x), GOOD, NONE))))
    return np.stack(cols, axis=1)


def patterns(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, pattern, n_words): a digit per labeller, 1 good, 0 bad, 2 no vote."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            signals, words = _signals(b.column(1))
            votes = _votes(signals, words)
            text = ["".join(map(str, v)) for v in votes]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(text, pa.string()), pa.array(words.astype(np.int64))],
                ["doc_id", "digest", "pattern", "n_words"])
    return _texts(docs).mapInArrow(run, "doc_id long, digest binary, pattern string, n_words long")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       C.text_digest().alias("digest"))


def label_model(counts: dict[str, int], rounds: int = EM_ROUNDS) -> tuple[dict[str, float], np.ndarray, float]:
    """EM over pattern counts: P(good | pattern), P(bad vote | class, labeller), share of good.

    Votes are independent given the class, and no vote says nothing.  There are
    several kinds of bad documents, each caught by some of the labellers, so on
    bad documents good votes are common; what sets the classes apart is that
    bad votes are rare on good documents.  The model holds that rate at
    ``FALSE_ALARM`` at most, which also fixes which class is which.
    """
    names = sorted(counts)
    votes = np.array([[int(c) for c in p] for p in names], int).reshape(-1, len(LABELLERS))
    weight = np.array([counts[p] for p in names], float)
    bad, good = (votes == BAD).astype(float), (votes == GOOD).astype(float)
    rate = np.empty((2, len(LABELLERS)))
    rate[GOOD], rate[BAD] = FALSE_ALARM, 0.3
    share, post = 0.8, np.full(len(names), 0.8)
    for _ in range(rounds if names else 0):
        logit = bad @ np.log(rate[GOOD] / rate[BAD]) + good @ np.log((1 - rate[GOOD]) / (1 - rate[BAD]))
        new = 1 / (1 + np.exp(-(logit + np.log(share / (1 - share)))))
        settled = np.abs(new - post).max() < 1e-9
        post = new
        if settled:
            break
        for c, p in ((GOOD, weight * post), (BAD, weight * (1 - post))):
            rate[c] = (p @ bad + 0.5) / (p @ (bad + good) + 1)
        rate[GOOD] = np.minimum(rate[GOOD], FALSE_ALARM)
        share = ((weight * post).sum() + 1) / (weight.sum() + 2)
    return dict(zip(names, post.tolist())), rate, share


# -- hashed linear scorer -----------------------------------------------------

def _grams(b: T.Block) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the 4-grams of character classes of a block's pieces."""
    if len(b.buf) < GRAM:
        z = np.zeros(0, np.int64)
        return z, z
    c = _CLASS[b.buf].astype(np.uint32)
    code = c[:-3] | c[1:-2] << np.uint32(8) | c[2:-1] << np.uint32(16) | c[3:] << np.uint32(24)
    bucket = ((code * np.uint32(2654435761)) >> np.uint32(32 - 14)).astype(np.int64) % (BUCKETS - 2)
    row = np.repeat(b.row, b.end - b.start)
    inside = np.repeat(b.end, b.end - b.start)[:-3] >= np.arange(len(code)) + GRAM
    return row[:-3][inside], bucket[inside]


def features(col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, bucket, share), the relative frequency of each feature within a text, and each text's 4-grams."""
    n = len(col)
    rows, buckets, counts = [], [], []
    tail = np.zeros(0, np.uint8)  # last bytes of the text that goes on
    back = np.zeros(0, np.int64), np.zeros(0, np.uint64)  # row and hash of the last word of the blocks before
    for b, w, more in T.whole_words(col):
        if len(tail):
            b = T.Block(np.concatenate((tail, b.buf)), b.start, b.end + len(tail), b.row)
        r, k = _grams(b)
        tail = b.buf[1 - GRAM:].copy() if more else tail[:0]
        row, hashes = (np.concatenate(x) for x in zip(back, (w.row, w.hash)))
        same = np.zeros(len(row), bool)  # whether a word repeats the one before it
        same[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
        old, back = len(row) - len(w.row), (row[-1:], hashes[-1:])
        row, same = row[old:], same[old:]
        key = np.concatenate((r * BUCKETS + k, row * BUCKETS + np.where(same, BUCKETS - 1, BUCKETS - 2)))
        u, c = np.unique(key, return_counts=True)
        rows.append(u // BUCKETS), buckets.append(u % BUCKETS), counts.append(c)
    if not rows:
        return
    row, bucket = np.concatenate(rows), np.concatenate(buckets)
    count = np.concatenate(counts).astype(float)
    words = bucket >= BUCKETS - 2
    total = [np.maximum(np.bincount(row[m], weights=count[m], minlength=n), 1) for m in (~words, words)]
    yield row, bucket, count / np.where(words, total[1][row], total[0][row]), total[0]


def fit(row: np.ndarray, bucket: np.ndarray, share: np.ndarray, target: np.ndarray,
        rounds: int = FIT_ROUNDS, ridge: float = 1e-4, rate: float = 0.3) -> tuple[np.ndarray, float]:
    """Weights and intercept of the logistic model with soft targets (full-batch Adam)."""
    n = max(1, len(target))
    w, first, second = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for t in range(1, (rounds if len(target) else 0) + 1):
        z = np.bincount(row, weights=share * w[bucket], minlength=n) + w[-1]
        err = 1 / (1 + np.exp(-z.clip(-30, 30))) - target
        g = np.append(np.bincount(bucket, weights=share * err[row], minlength=BUCKETS), err.sum()) / n
        g[:-1] += ridge * w[:-1]
        first = 0.9 * first + 0.1 * g
        second = 0.999 * second + 0.001 * g * g
        w -= rate * (first / (1 - 0.9 ** t)) / (np.sqrt(second / (1 - 0.999 ** t)) + 1e-8)
    return w[:-1], float(w[-1])


class Model(NamedTuple):
    weights: np.ndarray
    intercept: float
    usual: float  # log-odds of the share of good documents


def train(docs: DataFrame, labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit the scorer on at most ``sample`` documents of ``docs`` with the labels (doc_id, digest, label)."""
    place = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")).otherwise(F.xxhash64("digest"))
    picked = (labelled.where("n_words > 0").select("doc_id", "digest", "label").distinct()
              .orderBy(place, "doc_id", "digest").limit(sample))
    picked = picked.select(F.col("doc_id").alias("__llm_id"), F.col("digest").alias("__llm_digest"), "label")

    def run(batches):
        for b in batches:
            for row, bucket, share, _ in features(b.column(1)):
                at = np.searchsorted(row, np.arange(len(b) + 1)) if (np.diff(row) >= 0).all() else None
                if at is None:
                    order = np.argsort(row, kind="stable")
                    row, bucket, share = row[order], bucket[order], share[order]
                    at = np.searchsorted(row, np.arange(len(b) + 1))
                offsets = pa.array(at.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(2), pa.ListArray.from_arrays(offsets, pa.array(bucket.astype(np.int32))),
                     pa.ListArray.from_arrays(offsets, pa.array(share))], ["doc_id", "label", "bucket", "share"])
    t = _texts(docs)
    same = (t["digest"] == F.col("__llm_digest")) & t["doc_id"].eqNullSafe(F.col("__llm_id"))
    rows = t.join(F.broadcast(picked), same).dropDuplicates(["doc_id", "digest"]).select("doc_id", "text", "label")
    got = rows.mapInArrow(run, "doc_id long, label double, bucket array<int>, share array<double>")
    got = got.orderBy(F.xxhash64("doc_id"), "doc_id", "bucket").limit(sample).toArrow()
    bucket, share = got.column("bucket").combine_chunks(), got.column("share").combine_chunks()
    size = np.diff(np.asarray(bucket.offsets)) if len(got) else np.zeros(0, np.int64)
    target = got.column("label").to_numpy()
    good = (target.sum() + 1) / (len(target) + 2)
    return Model(*fit(np.repeat(np.arange(len(got)), size), np.asarray(bucket.flatten(), np.int64),
                      np.asarray(share.flatten()), target), float(np.log(good / (1 - good))))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, digest, score) of every document; zero if it has no words.

    A text of a few letters says little: its evidence is drawn towards the usual log-odds.
    """
    w = docs.sparkSession.sparkContext.broadcast(tuple(model))  # BUCKETS numbers

    def run(batches):
        weight, b0, usual = w.value
        for b in batches:
            z, words = np.full(len(b), b0), np.zeros(len(b), bool)
            for row, bucket, share, grams in features(b.column(1)):
                z += np.bincount(row, weights=share * weight[bucket], minlength=len(b))
                z = usual + (z - usual) * grams / (grams + LEAST_GRAMS)
                words[row[bucket >= BUCKETS - 2]] = True
            p = np.where(words, 1 / (1 + np.exp(-z.clip(-30, 30))), 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(np.round(p, 6))],
                                             ["doc_id", "digest", "score"])
    return _texts(docs).mapInArrow(run, "doc_id long, digest binary, score double")


def posteriors(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, pattern, n_words, label): the label model's P(good) of each document."""
    spark = docs.sparkSession
    rows = C.freeze(patterns(docs), "llm_votes")
    # one row per pattern: at most 3^labellers, however many documents
    counts = {r["pattern"]: r["n"] for r in
              rows.where("n_words > 0").groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()}
    post, _, share = label_model(counts)
    table = spark.createDataFrame([(p, v) for p, v in sorted(post.items())] or [("", share)],
                                  "pattern string, label double")
    return rows.join(F.broadcast(table), "pattern", "left").select("doc_id", "digest", "pattern", "n_words", "label")


def classify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, digest, score) of every document of ``docs``, by a scorer fitted to its own weak labels."""
    labelled = C.freeze(posteriors(docs), "llm_labels")
    return score(docs, train(docs, labelled, sample))


def keep_good(docs: DataFrame, keep_from: float = KEEP_FROM) -> DataFrame:
    """The rows of ``docs`` whose text the classifier does not reject, with their columns."""
    good = classify(docs).where(F.col("score") >= keep_from).select(F.col("digest").alias("__llm_digest")).distinct()
    return C.keep_rows(docs.withColumn("__llm_digest", C.text_digest()), good, "__llm_digest").drop("__llm_digest")


# -- query --------------------------------------------------------------------

def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its weak label, its score and whether it is kept."""
    docs = C.read(spark, sf_dir, "documents")
    labelled = C.freeze(posteriors(docs), "llm_labels")
    out = score(docs, train(docs, labelled))
    # a text has one vote pattern and one label, however many rows have the text
    weak = labelled.groupBy("digest", F.round("label", 6).alias("weak_label"), F.col("pattern").alias("votes"))
    weak = C.freeze(weak.agg(F.count(F.lit(1)).alias("n")), "llm_weak")
    out = C.spread_join(out, weak, "digest", "n", labelled.count())
    return out.select("doc_id", "weak_label", "votes", "score", (F.col("score") >= KEEP_FROM).alias("kept"))
