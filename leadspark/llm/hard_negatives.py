"""Hard negatives by threshold joins over an inverted index (L2AP style).

Vectors become whole numbers, floor(256 x); a score is an inner product.  All
rows are dealt into ranges, anchors into blocks, and each pair of a range and a
block is searched by one task, in two passes: the positives of each anchor, then,
with their scores known, the negatives in each positive's window.

One search finds all pairs of at least a threshold, which each anchor has of its own:

* **Index.**  A row's components are sorted by size.  The longest suffix whose
  norm, times any anchor's norm, stays below a share of the threshold is left out;
  the others are entered in the lists of their dimensions.
* **Accumulation.**  The anchors' dimensions are gone through, the ones with most
  weight first, and each list's entries times the anchors' components are added.
* **Pruning.**  Partial score, plus the product of what norms remain, plus the norm
  left out, bounds a pair's score; pairs whose bound is below the threshold go.
  Once few pairs are left, they are scored exactly; all results are.
* **Thresholds** start high and are lowered, for the anchors that need it, until their
  windows are full (or to the least score that counts).  A window's worst entry is
  then the threshold for further rows of the range.

A task's best rows of each window contain those of the whole table that lie in its
range, so ranks over all ranges are exact.  What a task holds is bounded by
``RANGE`` rows and ``BLOCK`` anchors; ties of any number are cut by the row's id.

Defined results: rows with a null label, a null vector or a null or non-finite
component take no part, nor do rows without an id (they can't be named) and rows
of a norm above 2^30 (their scores leave the range of a long); an empty vector has
score zero, and of vectors of different lengths the shorter one counts as filled
up with zeros.  Identical rows count once; rows of one id that differ are rows of
their own, but none is the other's positive or negative.  An empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadspark.llm import common as C

POSITIVES = 5
NEGATIVES = 10
#: A negative's score, as hundredths of the positive's: least and most.
WINDOW = (30, 90)
#: Rows of a range and anchors of a block at most, and the number of ranges at least.
RANGE = 1 << 16
BLOCK = 1 << 12
RANGES = 24
#: Rows and anchors whose scores are accumulated at once.
ROWS = 1 << 12
ANCHORS = 64
#: Share of the threshold that components left out of the index may stand for.
SHARE = 0.5
#: Thresholds of the first search and of each further one, as parts of the one before.
FIRST, LOWER = 0.6, 0.7
#: Dimensions between two prunings, and the share of pairs below which the rest is scored exactly.
STRIDE, FEW = 8, 1 / 16
NORM = 1 << 30


# -- rows -----------------------------------------------------------------------

def vectors(rows: DataFrame, vec_id: str = "vec_id", label: str = "label", embedding: str = "embedding") -> DataFrame:
    """(vec_id, label, v): the rows that take part, once each, with whole-number components."""
    x = F.transform(F.col(embedding), lambda c: c.cast("double"))
    own = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), x.alias("x"))
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    norm = F.aggregate("x", F.lit(0.0), lambda s, c: s + F.floor(c * 256).cast("double") ** 2)
    own = own.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & ~bad
                    & (norm <= float(NORM) ** 2))
    return own.select("vec_id", "label", F.transform("x", lambda c: F.floor(c * 256).cast("long")).alias("v")).distinct()


def _grid(rows: DataFrame, anchors: DataFrame, more: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows and anchors, each for every pair (range, block) that it meets."""
    n, m = rows.count(), anchors.count()
    ranges, blocks = max(RANGES, -(-n // RANGE)), max(1, -(-m // BLOCK))

    def dealt(*by: Column, parts: int) -> Column:
        return F.pmod(F.xxhash64(*by), F.lit(parts)).cast("int")

    def every(parts: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = rows.select(dealt(F.col("vec_id"), F.col("v"), parts=ranges).alias("range"), every(blocks).alias("block"),
                       "vec_id", "label", "v")
    right = anchors.select(every(ranges).alias("range"), dealt(F.lit(1), F.col("vec_id"), F.col("v"), parts=blocks).alias("block"),
                           "vec_id", "label", "v", *more)
    return left, right


# -- one search ------------------------------------------------------------------

class Vectors:
    """Vectors of a task as a matrix, sorted by id."""

    def __init__(self, table: pa.Table, width: int | None = None):
        table = table.sort_by("vec_id")
        self.table = table
        self.id, self.label = (table.column(c).to_numpy() for c in ("vec_id", "label"))
        lists = table.column("v").combine_chunks()
        flat, size = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
        self.m = np.zeros((len(self.id), max([0, *size]) if width is None else width), np.int64)
        row = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        fits = place < self.m.shape[1]  # beyond the other side's width there is nothing to multiply with
        self.m[row[fits], place[fits]] = flat[fits]
        self.norm = np.sqrt((self.m.astype(float) ** 2).sum(axis=1))


class Index:
    """Lists of the dimensions of some rows, without the suffixes whose norm stays below ``least``."""

    def __init__(self, m: np.ndarray, least: float):
        self.m = m
        square = m.astype(float) ** 2
        order = np.argsort(-square, axis=1, kind="stable")
        suffix = np.sqrt(np.cumsum(np.take_along_axis(square, order, 1)[:, ::-1], axis=1)[:, ::-1])
        kept = np.zeros(m.shape, bool)
        np.put_along_axis(kept, order, (suffix >= least) & (suffix > 0), 1)
        self.lists = [np.flatnonzero(kept[:, d]) for d in range(m.shape[1])]
        self.values = [m[rows, d] for d, rows in enumerate(self.lists)]
        self.indexed = np.where(kept, square, 0).sum(axis=1)
        self.left_out = np.sqrt(np.where(kept, 0, square).sum(axis=1))
        self.norm = np.sqrt(square.sum(axis=1))

    def search(self, q: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, anchor, score) of the pairs of at least the anchor's threshold."""
        weight = (q.astype(float) ** 2)
        norm = np.sqrt(weight.sum(axis=1))
        order = np.argsort(-weight.sum(axis=0), kind="stable")
        partial = np.zeros((len(self.m), len(q)), np.int64)
        rest_x, rest_q = self.indexed.copy(), weight.sum(axis=1)
        alive = None
        for k, d in enumerate(order):
            partial[self.lists[d]] += self.values[d][:, None] * q[:, d][None, :]
            rest_x[self.lists[d]] -= self.values[d].astype(float) ** 2
            rest_q -= weight[:, d]
            if (k + 1) % STRIDE == 0 or k + 1 == len(order):
                alive = self._alive(partial, rest_x, rest_q, norm, least)
                if alive.mean() < FEW:
                    break
        if alive is None:  # no dimensions: every score is zero
            alive = self._alive(partial, rest_x, rest_q, norm, least)
        row, anchor = np.nonzero(alive)
        score = np.zeros(len(row), np.int64)
        for at in range(0, len(row), 1 << 16):
            own = slice(at, at + (1 << 16))
            score[own] = np.einsum("ij,ij->i", self.m[row[own]], q[anchor[own]])
        good = score >= least[anchor]
        return row[good], anchor[good], score[good]

    def _alive(self, partial, rest_x, rest_q, norm, least) -> np.ndarray:
        x, q = np.sqrt(np.maximum(rest_x, 0)), np.sqrt(np.maximum(rest_q, 0))
        bound = partial + x[:, None] * q[None, :] + self.left_out[:, None] * norm[None, :]
        # what rounding may have taken from the norms
        return bound + (1 + 1e-6 * self.norm[:, None] * norm[None, :]) >= least[None, :]


def _first(row: np.ndarray, group: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` of each group: higher scores first, then earlier rows."""
    order = np.lexsort((row, -score, group))
    g = group[order]
    start = np.concatenate(([True], g[1:] != g[:-1])) if len(g) else np.zeros(0, bool)
    rank = np.arange(len(g)) - np.maximum.accumulate(np.where(start, np.arange(len(g)), 0))
    return order[rank < k]


class Windows:
    """The best rows so far of some anchors' windows (lo, hi: [anchor, window]; a window above its hi is closed)."""

    def __init__(self, lo: np.ndarray, hi: np.ndarray, k: int):
        self.lo, self.hi, self.k = lo, hi, k
        self.row, self.slot, self.score = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, row: np.ndarray, anchor: np.ndarray, score: np.ndarray) -> None:
        rows, slots, scores = [self.row], [self.slot], [self.score]
        for w in range(self.lo.shape[1]):
            fits = (score >= self.lo[anchor, w]) & (score <= self.hi[anchor, w])
            rows.append(row[fits])
            slots.append(anchor[fits] * self.lo.shape[1] + w)
            scores.append(score[fits])
        row, slot, score = map(np.concatenate, (rows, slots, scores))
        best = _first(row, slot, score, self.k)
        self.row, self.slot, self.score = row[best], slot[best], score[best]

    def drop(self, anchors: np.ndarray, lo: int, hi: int) -> None:
        """Forget some anchors' entries among the rows from ``lo`` to ``hi``."""
        keep = (self.row < lo) | (self.row >= hi) | ~np.isin(self.slot // self.lo.shape[1], anchors)
        self.row, self.slot, self.score = self.row[keep], self.slot[keep], self.score[keep]

    def least(self) -> np.ndarray:
        """The score that a further row needs, by anchor: that of the last one of a full window, the low end of others."""
        n = np.bincount(self.slot, minlength=self.lo.size)
        worst = np.full(self.lo.size, np.iinfo(np.int64).max)
        np.minimum.at(worst, self.slot, self.score)
        need = np.where(n >= self.k, worst, self.lo.ravel()).reshape(self.lo.shape)
        return np.where(self.lo <= self.hi, need, np.iinfo(np.int64).max).min(axis=1)


def best_rows(m: np.ndarray, q: np.ndarray, start: np.ndarray, win: Windows, alike) -> None:
    """Fill the anchors' windows from the rows ``m``; ``alike(row, anchor)`` says which pairs count."""
    norm = np.sqrt((q.astype(float) ** 2).sum(axis=1))
    for at in range(0, len(m), ROWS):
        own = m[at:at + ROWS]
        need = win.least()
        least = np.maximum(start, need) if at == 0 else need
        todo = np.flatnonzero(need < np.iinfo(np.int64).max)
        while len(todo):
            # anchors that omit alike much share an index
            part = SHARE * least[todo] / np.maximum(norm[todo], 1)
            todo = todo[np.argsort(part, kind="stable")]
            for a in range(0, len(todo), ANCHORS * 16):
                group = todo[a:a + ANCHORS * 16]
                index = Index(own, max(0.0, float((SHARE * least[group] / np.maximum(norm[group], 1)).min())))
                found = []
                for b in range(0, len(group), ANCHORS):
                    some = group[b:b + ANCHORS]
                    row, anchor, score = index.search(q[some], least[some])
                    ok = alike(row + at, some[anchor])
                    found.append((row[ok] + at, some[anchor[ok]], score[ok]))
                win.drop(group, at, at + len(own))  # what a lower threshold finds again
                win.add(*map(np.concatenate, zip(*found)))
            # an anchor goes on while its threshold is above what its windows need
            need = win.least()
            todo = todo[least[todo] > need[todo]]
            least[todo] = np.maximum(need[todo], np.floor(least[todo] * LOWER).astype(np.int64))


# -- passes -----------------------------------------------------------------------

def _positives(rows: pa.Table, anchors: pa.Table, k: int) -> pa.Table:
    out = []
    if rows.num_rows and anchors.num_rows:
        a = Vectors(anchors)
        x = Vectors(rows, a.m.shape[1])
        for label in np.unique(a.label):
            mine, theirs = np.flatnonzero(a.label == label), np.flatnonzero(x.label == label)
            if not len(theirs):
                continue
            q, m, ids = a.m[mine], x.m[theirs], x.id[theirs]
            win = Windows(np.zeros((len(mine), 1), np.int64), np.full((len(mine), 1), np.iinfo(np.int64).max - 1), k)
            start = np.floor(FIRST * a.norm[mine] * x.norm[theirs].max()).astype(np.int64)
            best_rows(m, q, start, win, lambda row, anchor: ids[row] != a.id[mine[anchor]])
            out.append((a, mine[win.slot], ids[win.row], win.score))
    return pa.table({"anchor_id": _all(pa.int64(), [a.id[s] for a, s, _, _ in out]),
                     "anchor": _all(pa.int64(), [a.table.column("key").to_numpy()[s] for a, s, _, _ in out]),
                     "positive_id": _all(pa.int64(), [i for _, _, i, _ in out]),
                     "positive_score": _all(pa.int64(), [s for _, _, _, s in out])})


def _all(kind: pa.DataType, parts: list) -> pa.Array:
    return pa.array(np.concatenate(parts) if parts else [], kind)


def _negatives(rows: pa.Table, anchors: pa.Table, k: int) -> pa.Table:
    out = []
    if rows.num_rows and anchors.num_rows:
        a = Vectors(anchors)
        x = Vectors(rows, a.m.shape[1])
        lists = a.table.column("windows").combine_chunks()
        size = np.diff(lists.offsets.to_numpy())
        top = int(size.max())
        lo, hi = np.ones((len(size), top), np.int64), np.zeros((len(size), top), np.int64)
        slot = np.repeat(np.arange(len(size)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        ends = lists.flatten()
        lo[slot], hi[slot] = ends.field("lo").to_numpy(), ends.field("hi").to_numpy()
        win = Windows(lo, hi, k)
        open_hi = np.where(lo <= hi, hi, np.iinfo(np.int64).max).min(axis=1)
        best_rows(x.m, a.m, np.floor(open_hi * 0.95).astype(np.int64), win,
                  lambda row, anchor: (x.label[row] != a.label[anchor]) & (x.id[row] != a.id[anchor]))
        out.append((a.table.column("key").to_numpy()[win.slot // top], win.slot % top, x.id[win.row], win.score))
    return pa.table({"anchor": _all(pa.int64(), [o[0] for o in out]), "place": _all(pa.int32(), [o[1] for o in out]),
                     "negative_id": _all(pa.int64(), [o[2] for o in out]),
                     "negative_score": _all(pa.int64(), [o[3] for o in out])})


def _by_rank(rows: DataFrame, by: list[str], score: str, row: str, k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc(score), F.asc(row))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES,
         window: tuple[int, int] = WINDOW) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``rows`` and ``anchors`` are as ``vectors`` gives them, anchors among the rows.
    For each anchor and each of its first positives, the first negatives whose
    hundredfold score lies in the window of hundredths of the positive's score.  Only
    positives of scores from zero on have such negatives.
    """
    low, high = window
    if not 0 <= low <= high <= 100:
        raise ValueError("a window is a part of the positive's score, in hundredths")
    anchors = C.freeze(anchors.withColumn("key", F.monotonically_increasing_id()), "llm_anchors")
    left, right = _grid(rows, anchors, ["key"])
    found = left.groupBy("range", "block").cogroup(right.groupBy("range", "block")).applyInArrow(
        lambda a, b: _positives(a, b, positives),
        "anchor_id long, anchor long, positive_id long, positive_score long")
    first = _by_rank(found, ["anchor"], "positive_score", "positive_id", positives)

    def part(share: int, up: int) -> Column:
        """A part of the positive's score, rounded down or up, without a product that leaves the range of a long."""
        return F.expr(f"positive_score div 100 * {share} + (positive_score % 100 * {share} + {99 * up}) div 100")
    first = first.select("anchor", "anchor_id", (F.col("rank") - 1).alias("place"), "positive_id", "positive_score",
                         part(low, 1).alias("lo"), part(high, 0).alias("hi"))
    first = C.freeze(first, "llm_positives")
    windows = first.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", "lo", "hi"))).alias("windows"))
    known = C.freeze(anchors.join(windows, anchors["key"] == windows["anchor"]).drop("anchor"), "llm_windows")
    left, right = _grid(rows, known, ["key", "windows"])
    found = left.groupBy("range", "block").cogroup(right.groupBy("range", "block")).applyInArrow(
        lambda a, b: _negatives(a, b, negatives), "anchor long, place int, negative_id long, negative_score long")
    best = _by_rank(found, ["anchor", "place"], "negative_score", "negative_id", negatives)
    return best.join(first, ["anchor", "place"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


# -- query ------------------------------------------------------------------------

def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth row, labels of every seventh row moved on by one."""
    e = C.read(spark, sf_dir, "embeddings")
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = C.freeze(vectors(e.select("vec_id", moved.alias("label"), "embedding")), "llm_vectors")
    return mine(rows, rows.where(F.col("vec_id") % 100 == 0))


SQL = """
with e as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         [floor(256 * x::double)::bigint for x in embedding] as v
  from embeddings
  where label is not null and embedding is not null
    and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
scored as (
  select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as alike,
         list_sum([p[1] * p[2] for p in list_zip(a.v, b.v)])::bigint as score
  from e a join e b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
positive as (
  select anchor_id, other_id as positive_id, score as positive_score from scored where alike
  qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5)
select p.anchor_id, p.positive_id,
       row_number() over (partition by p.anchor_id, p.positive_id order by n.score desc, n.other_id)::int as rank,
       n.other_id as negative_id, p.positive_score, n.score as negative_score
from positive p join scored n on n.anchor_id = p.anchor_id and not n.alike
 and 30 * p.positive_score <= 100 * n.score and 100 * n.score <= 90 * p.positive_score
qualify rank <= 10
"""
