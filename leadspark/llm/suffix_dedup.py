"""Removal of repeated passages by a distributed merge sort of suffixes.

A byte goes if it is covered by a 100-byte string that also starts earlier (in
a document of smaller id, or earlier in the same one).

1. *Copies.*  Documents of equal text are found by digest; all but the first
   are removed whole (their strings all start earlier) and take no part below.
   The others are written once, bucketed by a part number.
2. *Which suffixes.*  Of the ``GRAM``-byte strings inside a 100-byte window the
   leftmost of least hash is the window's anchor.  Equal windows have equal
   anchors at the same place, so only anchors whose hash occurs twice matter.
   Hashes are exchanged by value, once per part with its number of holders, and
   counted.
3. *Sorted runs.*  Each part sorts the suffixes at its remaining anchors, with
   the bytes before the anchor as context, at most some ``ENTRIES`` in a run.  Suffixes
   that agree in all they are compared by collapse to the first one in their run.
   Runs are front-coded.
4. *Exchange and merge.*  Runs are cut at splitters (quantiles of a bounded
   sample of keys, no longer than an anchor, so suffixes of one anchor stay
   together) and each range is merged by a loser tree that never
   compares known prefixes again.  The merged order with its common prefixes
   says, for each distance of window start and anchor, which windows are equal:
   equal to the right by the common prefix, equal to the left by the order of
   the contexts.  All but the first of equal windows are repeated.
5. *Removal.*  Repeated stretches go back to their part and are cut out.

A key with very many holders: an anchor found at more than ``DENSE_FROM`` places
(parts round their number up to a power of two), however few the parts are, is
replaced by the suffixes of its windows themselves, which differ at the
passage's edges, so ranges split them; equal ones collapse in their run, stretch
by stretch before their bytes are copied.

The numbers of parts, buckets and ranges follow the bytes and suffixes, so what a
task holds at once (a part, a bucket of hashes, a run, a range) does not grow with
the table.

All texts are handled whole, and all windows; nothing is sampled but the
splitters, which only balance the ranges.

Defined results: a null text is empty; texts of fewer than 100 bytes lose
nothing; rows equal in id and text are one document and get the same result;
documents of equal id but different text are ordered by a hash of the text; a
null id comes before all others.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadspark.llm import common as C
from leadspark.llm import loser_tree as LT
from leadspark.llm import textbytes as T

LENGTH = 100
GRAM = 40
#: Places that may share an anchor before its windows are sorted one by one.
DENSE_FROM = 1 << 15
#: Keys the splitters are chosen from, at most.
SAMPLE = 1 << 16
#: Windows handled at once.
WINDOWS = 1 << 18
#: Bytes of text in a part, about: its texts lie in one task's memory.
PART_BYTES = 4 << 20
#: Suffixes sorted at once, and about those of a range.
ENTRIES = 1 << 16
#: Every so many keys of a run, one is a candidate for the splitters.
EVERY = 64
#: Runs in a row group of the written file: a reader holds one group at a time.
ROW_GROUP = 4
#: Buckets of a table, at most (Spark's own limit).
BUCKETS = 100_000
_FLAGS = np.uint64(63)
#: Rows of bytes gathered at once.
_ROWS = 1 << 14
_TIMES = np.uint64(0xD6E8FEB86659FD93)


# -- anchors ------------------------------------------------------------------

def _hash_grams(buf: np.ndarray, size: int) -> np.ndarray:
    """A 58-bit hash (in the high bits) of each ``size``-byte string of ``buf``."""
    n = len(buf)
    p = T.powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * p, out=sums[1:])
    h = (sums[size:] - sums[:-size]) * p[n - 1 - np.arange(n - size + 1)]
    h *= T._inverse_power(n - 1)
    h ^= h >> np.uint64(32)
    h *= _TIMES
    h ^= h >> np.uint64(29)
    h *= _TIMES
    return h & ~_FLAGS


def window_anchors(buf: np.ndarray, length: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Place of the anchor of each window of ``length`` bytes, and the hash of each string of ``size`` bytes."""
    h = _hash_grams(buf, size)
    w = length - size + 1
    n = len(h)
    pad = -n % w
    place = (np.arange(n + pad) % w).astype(np.uint64)
    packed = np.concatenate((h, np.full(pad, ~np.uint64(0)))) & ~_FLAGS | place
    rows = packed.reshape(-1, w)
    upto = np.minimum.accumulate(rows, axis=1).ravel()
    onward = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    p = np.arange(n - w + 1)
    a, b = onward[p], upto[p + w - 1]
    left = (a & ~_FLAGS) <= (b & ~_FLAGS)
    in_a, in_b = (a & _FLAGS).astype(np.int64), (b & _FLAGS).astype(np.int64)
    at = np.where(left, p // w * w + in_a, (p + w - 1) // w * w + in_b)
    return at, h


class Anchors:
    """Anchors of a stretch of texts: place, first and last window start, text, hash (places in ``buf``)."""

    def __init__(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray, offset: np.ndarray,
                 length: int, size: int):
        self.buf = buf
        none = np.zeros(0, np.int64)
        self.at = self.lo = self.hi = self.doc = none
        self.shift, self.hash = none, none.astype(np.uint64)
        if len(buf) < length:
            return
        at, h = window_anchors(buf, length, size)
        piece = np.repeat(np.arange(len(start)), end - start)[:len(at)]
        ok = np.flatnonzero(np.arange(len(at)) + length <= end[piece])
        if not len(ok):
            return
        fresh = np.ones(len(ok), bool)
        fresh[1:] = (at[ok[1:]] != at[ok[:-1]]) | (piece[ok[1:]] != piece[ok[:-1]])
        first = np.flatnonzero(fresh)
        self.lo = ok[first]
        self.hi = ok[np.append(first[1:], len(ok)) - 1]
        self.at = at[self.lo]
        self.doc = doc[piece[self.lo]]
        self.shift = (offset - start)[piece[self.lo]]  # place in buf -> place in the document
        self.hash = h[self.at]


def stretches(texts: list[bytes], length: int = LENGTH, size: int = GRAM) -> Iterator[Anchors]:
    """Anchors of all windows of the texts, in stretches of bounded size.

    A window's anchor depends on the window alone, so a long text may be cut
    anywhere as long as each window lies in one stretch.
    """
    held, total = [], 0

    def flush():
        buf = np.frombuffer(b"".join(x[2] for x in held), np.uint8)
        ends = np.cumsum([len(x[2]) for x in held])
        starts = np.concatenate(([0], ends[:-1]))
        return Anchors(buf, starts, ends, np.array([x[0] for x in held]), np.array([x[1] for x in held]), length, size)
    for i, t in enumerate(texts):
        for at in range(0, max(0, len(t) - length + 1), WINDOWS):
            part = t[at:at + WINDOWS + length - 1]
            held.append((i, at, part))
            total += len(part)
            if total >= WINDOWS:
                yield flush()
                held, total = [], 0
    if held:
        yield flush()


# -- group functions ----------------------------------------------------------

def _in_order(t: pa.Table) -> pa.Table:
    return t.sort_by([("doc_id", "ascending"), ("tie", "ascending")])


def _texts(t: pa.Table) -> list[bytes]:
    return t.column("text").to_pylist()


def _blob(*arrays: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def _hash_rows(buckets: int, length: int, size: int):
    """Part -> (bucket, part, sorted distinct hashes); the low bits say, as a power of two, how often the part has it."""
    def run(t: pa.Table) -> pa.Table:
        part = t.column("part")[0].as_py()
        found = [a.hash for a in stretches(_texts(t), length, size)]
        h, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
        to = ((h >> np.uint64(6)) % np.uint64(buckets)).astype(np.int64)
        h = h | np.ceil(np.log2(n)).astype(np.uint64)
        order = np.argsort(to, kind="stable")
        cut = np.searchsorted(to[order], np.arange(buckets + 1))
        rows = [(k, part, h[order[i:j]].tobytes()) for k, (i, j) in enumerate(zip(cut, cut[1:])) if j > i]
        return pa.table([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
                         pa.array([r[2] for r in rows], pa.binary())], ["bucket", "part", "hashes"])
    return run


def _repeated_rows(dense_from: int):
    """Bucket of hashes -> (part, those that occur twice); the lowest bit marks those of many places."""
    def run(t: pa.Table) -> pa.Table:
        blobs = [np.frombuffer(b, np.uint64) for b in t.column("hashes").to_pylist()]
        all_ = np.concatenate(blobs)
        bare = all_ & ~_FLAGS
        u, inverse = np.unique(bare, return_inverse=True)
        n = np.bincount(inverse, weights=np.exp2((all_ & _FLAGS).astype(float)), minlength=len(u))
        out = bare | (n > dense_from).astype(np.uint64)[inverse]
        good = (n > 1)[inverse]
        cut = np.cumsum([0, *map(len, blobs)])
        hits = [out[i:j][good[i:j]].tobytes() for i, j in zip(cut, cut[1:])]
        return pa.table([t.column("part"), pa.array(hits, pa.binary())], ["part", "hits"])
    return run


RUN = [("shared", np.uint8), ("size", np.uint8), ("before", np.uint8), ("near", np.uint8), ("far", np.uint8),
       ("doc", np.int32), ("part", np.int32), ("id", np.int64), ("tie", np.int64), ("at", np.int64)]


class Run:
    """Sorted suffixes: key bytes, bytes before the anchor, windows' distances, place."""

    def __init__(self, keys: list[bytes], shared: list[int], contexts: list[bytes], meta: dict[str, np.ndarray]):
        self.keys, self.shared, self.contexts, self.meta = keys, shared, contexts, meta

    def pack(self, i: int, j: int) -> bytes:
        """Entries i to j - 1, front-coded; the first is written in full."""
        shared = np.array(self.shared[i:j], np.uint8)
        shared[:1] = 0
        tails = [k[s:] for k, s in zip(self.keys[i:j], shared.tolist())]
        meta = {k: v[i:j] for k, v in self.meta.items()}
        meta |= {"shared": shared, "size": np.array(list(map(len, tails)), np.uint8),
                 "before": np.array(list(map(len, self.contexts[i:j])), np.uint8)}
        n = np.array([j - i, sum(map(len, tails))], np.int64)
        return _blob(n, *(meta[k].astype(t) for k, t in RUN)) + b"".join(tails) + b"".join(self.contexts[i:j])

    @staticmethod
    def unpack(blob: bytes) -> Run:
        n, tail_bytes = np.frombuffer(blob, np.int64, 2).tolist()
        at, got = 16, {}
        for k, t in RUN:
            got[k] = np.frombuffer(blob, t, n, at)
            at += n * np.dtype(t).itemsize
        keys = LT.expand(got["shared"], got["size"], blob[at:at + tail_bytes])
        at += tail_bytes
        ends = (at + np.cumsum(got["before"].astype(np.int64))).tolist()
        contexts = [blob[e - b:e] for e, b in zip(ends, got["before"].tolist())]
        return Run(keys, got["shared"].tolist(), contexts,
                   {k: v for k, v in got.items() if k not in ("shared", "size", "before")})


def _matrix(buf: np.ndarray, at: np.ndarray, size: np.ndarray, width: int, step: int = 1) -> np.ndarray:
    """Bytes from ``at`` on (backwards for step -1), padded with zeros to ``width``."""
    out, j = np.empty((len(at), width), np.uint8), np.arange(width)
    for i in range(0, len(at), _ROWS):
        inside = j < size[i:i + _ROWS, None]
        place = np.where(inside, at[i:i + _ROWS, None] + step * j, 0)
        out[i:i + _ROWS] = np.where(inside, buf[place], 0)
    return out


def _again(buf: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Which of the windows at ``at`` (ascending) equal an earlier one of them: found by hash, compared by bytes."""
    _, first, inverse = np.unique(_hash_grams(buf, length)[at], return_index=True, return_inverse=True)
    before = first[inverse]
    rows = np.flatnonzero(before != np.arange(len(at)))
    out, j = np.zeros(len(at), bool), np.arange(length)
    for i in range(0, len(rows), _ROWS):
        r = rows[i:i + _ROWS]
        out[r] = (buf[at[r][:, None] + j] == buf[at[before[r]][:, None] + j]).all(axis=1)
    return out


def _words_of(m: np.ndarray) -> list[np.ndarray]:
    """Columns of big-endian 8-byte words, which sort like the bytes."""
    pad = -m.shape[1] % 8
    m = np.ascontiguousarray(np.pad(m, ((0, 0), (0, pad))))
    w = m.view(">u8")
    return [w[:, i].astype(np.uint64) for i in range(w.shape[1])]


def _shared(m: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Prefix each row shares with the one before it."""
    out = np.zeros(len(m), np.int64)
    if len(m) > 1:
        differ = m[1:] != m[:-1]
        k = np.where(differ.any(axis=1), differ.argmax(axis=1), m.shape[1])
        out[1:] = np.minimum(k, np.minimum(size[1:], size[:-1]))
    return out


SAMPLED, DENSE = 0, 1  # kinds of runs: suffixes at anchors; suffixes of windows
RUNS = "part int, kind int, run binary, sample array<binary>, removed binary"


def _sorted_run(g: dict[str, np.ndarray], part: int, ids: np.ndarray, ties: np.ndarray, length: int,
                every: int, gone: list) -> tuple[bytes, list[bytes], bytes]:
    """(run, sample of its keys, stretches repeated within the part, with ``gone``) of a part's suffixes."""
    order = np.lexsort((g["at"], g["doc"], g["far"], *_words_of(g["ctx"])[::-1], g["key_n"],
                        *_words_of(g["key"])[::-1]))
    g = {k: v[order] for k, v in g.items()}
    same = np.zeros(len(order), bool)  # as the one before in all that is compared: repeated, for that is earlier
    same[1:] = ((g["key_n"][1:] == g["key_n"][:-1]) & (g["far"][1:] == g["far"][:-1])
                & (g["key"][1:] == g["key"][:-1]).all(axis=1) & (g["ctx"][1:] == g["ctx"][:-1]).all(axis=1))
    gone = [*gone, (g["doc"][same], (g["at"] - g["far"])[same], (g["at"] - g["near"])[same] + length)]
    removed = _blob(*_joined(*map(np.concatenate, zip(*gone))))
    g = {k: v[~same] for k, v in g.items()}
    keys = [r[:n].tobytes() for r, n in zip(g["key"], g["key_n"].tolist())]
    contexts = [r[:n].tobytes() for r, n in zip(g["ctx"], g["ctx_n"].tolist())]
    meta = {"near": g["near"], "far": g["far"], "doc": g["doc"], "part": np.full(len(keys), part),
            "id": ids[g["doc"]], "tie": ties[g["doc"]], "at": g["at"]}
    run = Run(keys, _shared(g["key"], g["key_n"]).tolist(), contexts, meta)
    return run.pack(0, len(keys)), keys[every // 2::every], removed


def _run_rows(length: int, size: int, every: int = EVERY, entries: int | None = None):
    """Part and its repeated hashes -> a row for each run of each kind of suffixes it has."""
    entries = entries or ENTRIES

    def run(docs: pa.Table, hits: pa.Table) -> pa.Table:
        rows: list = []
        found, gone = {SAMPLED: [], DENSE: []}, {SAMPLED: [], DENSE: []}

        def flush(kind):
            got = found[kind]
            if got:
                g = {k: np.concatenate([x[k] for x in got]) for k in got[0]}
                part = docs.column("part")[0].as_py()
                rows.append((part, kind, *_sorted_run(g, part, docs.column("doc_id").to_numpy(),
                                                      docs.column("tie").to_numpy(), length, every, gone[kind])))
            found[kind], gone[kind] = [], []

        def add(kind, a, *all_):
            for i in range(0, len(all_[0]), entries):
                at, near, far, doc, shift = (x[i:i + entries] for x in all_)
                found[kind].append({"key": _matrix(a.buf, at, length - near, length), "key_n": length - near,
                                    "ctx": _matrix(a.buf, at - 1, far, length - size, -1), "ctx_n": far,
                                    "near": near, "far": far, "doc": doc, "at": at + shift})
                if sum(len(x["at"]) for x in found[kind]) >= entries:
                    flush(kind)
        if len(docs) and len(hits):
            docs = _in_order(docs)
            want = np.unique(np.concatenate([np.frombuffer(b, np.uint64) for b in hits.column("hits").to_pylist()]))
            bare = want & ~_FLAGS
            for a in stretches(_texts(docs), length, size) if len(want) else ():
                k = np.searchsorted(bare, a.hash).clip(max=len(bare) - 1)
                use = bare[k] == a.hash
                many = use & ((want[k] & np.uint64(1)) > 0)
                use &= ~many
                add(SAMPLED, a, a.at[use], (a.at - a.hi)[use], (a.at - a.lo)[use], a.doc[use], a.shift[use])
                count = (a.hi - a.lo + 1)[many]  # each window is its own suffix
                own = np.repeat(a.lo[many], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                if not len(own):
                    continue
                doc, shift, again = np.repeat(a.doc[many], count), np.repeat(a.shift[many], count), _again(a.buf, own, length)
                gone[DENSE].append(_joined(doc[again], (own + shift)[again], (own + shift)[again] + length))
                own, doc, shift = own[~again], doc[~again], shift[~again]
                zero = np.zeros(len(own), np.int64)
                add(DENSE, a, own, zero, zero, doc, shift)
        for kind in found:
            flush(kind)
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.binary()), pa.binary()]
        cols = list(zip(*rows)) or [[]] * len(kinds)
        return pa.table([pa.array(c, t) for c, t in zip(cols, kinds)], [f.split()[0] for f in RUNS.split(", ")])
    return run


def _joined(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches as (doc, start, end), those that meet or overlap made one."""
    if not len(doc):
        z = np.zeros(0, np.int64)
        return z, z, z
    order = np.lexsort((start, doc))
    doc, start, end = (x[order].astype(np.int64) for x in (doc, start, end))
    # the furthest end so far within a document: documents are set apart by more than any place
    gap = int(end.max()) + 2
    far = np.maximum.accumulate(end + doc * gap)
    fresh = np.ones(len(doc), bool)
    fresh[1:] = start[1:] + doc[1:] * gap > far[:-1]
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], start[first], far[last] - doc[first] * gap


def _cut_runs(splitters: dict[int, list[bytes]], ranges: int):
    """Runs (kind, run) -> (range, run): each cut where its kind's splitters fall; kinds have ranges of their own."""
    def run(batches):
        from bisect import bisect_left
        for b in batches:
            for kind, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                r = Run.unpack(blob)
                cut = [0, *(bisect_left(r.keys, s) for s in splitters[kind]), len(r.keys)]
                rows = [(kind * ranges + k, r.pack(i, j)) for k, (i, j) in enumerate(zip(cut, cut[1:])) if j > i]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int32()),
                                                  pa.array([x[1] for x in rows], pa.binary())], ["range", "run"])
    return run


def repeated_windows(runs: list[Run], length: int, size: int) -> dict[str, np.ndarray]:
    """Merged entries of a range with, for each, which of its windows start earlier elsewhere."""
    order = np.array(list(LT.merge([(r.keys, r.shared) for r in runs])), np.int64).reshape(-1, 3)
    base = np.cumsum([0, *(len(r.keys) for r in runs)])
    pick = base[order[:, 0]] + order[:, 1]
    g = {k: np.concatenate([r.meta[k] for r in runs])[pick].astype(np.int64) for k in runs[0].meta}
    n = len(pick)
    shared = order[:, 2]
    contexts = [c for r in runs for c in r.contexts]
    ctx_n = np.array([len(c) for c in contexts], np.int64)
    ends = np.cumsum(ctx_n)
    buf = np.frombuffer(b"".join(contexts) or b"\0", np.uint8)
    ctx = _matrix(buf, ends - ctx_n, ctx_n, length - size)[pick]
    ctx_n = ctx_n[pick]
    by_ctx = np.lexsort((ctx_n, *_words_of(ctx)[::-1]))
    ctx_shared = _shared(ctx[by_ctx], ctx_n[by_ctx])
    by_place = np.lexsort((g["at"], g["tie"], g["id"]))
    dup = np.zeros((n, length - size + 1), bool)
    for d in range(length - size + 1):
        has = by_place[(g["near"][by_place] <= d) & (d <= g["far"][by_place])]
        if len(has) < 2:
            continue
        right = np.cumsum(shared < length - d)
        left = np.empty(n, np.int64)
        left[by_ctx] = np.cumsum(ctx_shared < d) if d else 0
        key = right[has] * (n + 1) + left[has]
        _, first = np.unique(key, return_index=True)
        later = np.ones(len(has), bool)
        later[first] = False
        dup[has[later], d] = True
    return g | {"dup": dup}


def _merge_rows(length: int, size: int):
    """Range -> (part, stretches that are repeated)."""
    def run(t: pa.Table) -> pa.Table:
        g = repeated_windows([Run.unpack(b) for b in t.column("run").to_pylist()], length, size)
        entry, d = np.nonzero(g["dup"])
        start = g["at"][entry] - d
        doc, part = g["doc"][entry], g["part"][entry]
        rows = []
        order = np.argsort(part, kind="stable")
        parts, cut = np.unique(part[order], return_index=True)
        for p, own in zip(parts.tolist(), np.split(order, cut[1:])):
            rows.append((p, _blob(*_joined(doc[own], start[own], start[own] + length))))
        return pa.table([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())],
                        ["part", "removed"])
    return run


OUT = "doc_id long, tie long, n_removed long, n_spans long, kept_sha256 string"


def _removal(docs: pa.Table, removed: pa.Table) -> pa.Table:
    """Documents that lose something."""
    docs = _in_order(docs)
    got = [np.frombuffer(b, np.int64).reshape(3, -1) for b in removed.column("removed").to_pylist()]
    doc, start, end = _joined(*np.concatenate(got, axis=1)) if got else [np.zeros(0, np.int64)] * 3
    rows = []
    texts = docs.column("text")
    which, cut = np.unique(doc, return_index=True)
    for i, own in zip(which.tolist(), np.split(np.arange(len(doc)), cut[1:])):
        view, h, at = memoryview(texts[i].as_buffer()), hashlib.sha256(), 0
        for s, e in zip(start[own].tolist(), end[own].tolist()):
            h.update(view[at:s])
            at = e
        h.update(view[at:])
        rows.append((docs.column("doc_id")[i].as_py(), docs.column("tie")[i].as_py(),
                     int((end[own] - start[own]).sum()), len(own), h.hexdigest()))
    cols = list(zip(*rows)) or [[]] * 5
    kinds = [pa.int64()] * 4 + [pa.string()]
    return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], [f.split()[0] for f in OUT.split(", ")])


# -- operator -----------------------------------------------------------------

def _splitters(runs: DataFrame, kind: int, ranges: int, sample: int, whole: int) -> list[bytes]:
    """Quantiles of a bounded sample of keys, for ``ranges`` ranges and more if these were large; they only
    balance the ranges.

    A splitter has at most ``whole`` bytes: keys that agree so far stay together.
    """
    keys = runs.where(F.col("kind") == kind).select(F.explode("sample").alias("key"))
    n = keys.count()
    ranges = max(ranges, n * EVERY // ENTRIES)
    if n > sample:  # thinned where they lie, so that no task sends more than its share to the driver
        keys = keys.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < (1 << 30) * sample // n)
    rows = keys.limit(2 * sample).collect()  # at most twice `sample` keys
    s = sorted(bytes(r[0]) for r in rows)
    return sorted({s[len(s) * k // ranges][:whole] for k in range(1, ranges)}) if s else []


def removed_passages(docs: DataFrame, length: int = LENGTH, gram: int = GRAM,
                     dense_from: int = DENSE_FROM, sample: int = SAMPLE, part_bytes: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    if not 1 <= length - gram + 1 <= 64:
        raise ValueError("a window has at most 64 strings to choose its anchor from")
    spark = docs.sparkSession
    n = C.shuffle_partitions(spark)
    least = -(1 << 63)
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(least)).alias("doc_id"), text.alias("text"),
                       F.unhex(F.sha2(text, 256)).alias("sha"), F.xxhash64(text).alias("tie"))
    light = C.freeze(rows.select("doc_id", "sha", "tie", F.length("text").cast("long").alias("n_bytes")), "llm_texts")
    first = light.groupBy("sha").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    first = C.freeze(first, "llm_first")

    # the documents that take part, once each, bucketed by part
    f = first.select(F.col("sha").alias("__s"), F.col("first_id").alias("__f"))
    own = rows.where(F.length("text") >= length).join(
        f, (F.col("sha") == F.col("__s")) & (F.col("doc_id") == F.col("__f")), "left_semi")
    repeated = light.groupBy("doc_id", "sha").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not repeated.isEmpty():
        own = own.dropDuplicates(["doc_id", "sha"])
    total, n_rows = light.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)), F.count(F.lit(1))).first()
    parts = max(2 * n, -(-total // (part_bytes or PART_BYTES)))
    buckets = max(n, total // (8 * (part_bytes or PART_BYTES)))  # of hashes: 8 bytes for some 31 of text
    n = max(n, min(parts // 2, BUCKETS))
    own = own.select(F.pmod(F.xxhash64("doc_id", "tie"), F.lit(parts)).cast("int").alias("part"),
                     "doc_id", "tie", "text")
    name = f"llm_parts_{uuid.uuid4().hex}"
    path = f"{C.ensure_checkpoint_dir(spark).rstrip('/')}/{name}"
    own.repartition(n, "part").write.format("parquet").bucketBy(n, "part").option("path", path).saveAsTable(name)
    table = spark.table(name)

    hashes = table.groupBy("part").applyInArrow(_hash_rows(buckets, length, gram), "bucket int, part int, hashes binary")
    hits = hashes.groupBy("bucket").applyInArrow(_repeated_rows(dense_from), "part int, hits binary")
    hits = C.freeze(hits, "llm_hits")
    runs = table.groupBy("part").cogroup(hits.groupBy("part")).applyInArrow(
        _run_rows(length, gram), RUNS)
    path = C.scratch_folder(spark, "llm_runs")
    runs.write.option("parquet.block.row.count.limit", ROW_GROUP).parquet(path)
    runs = spark.read.parquet(path)

    # suffixes of one anchor are compared by prefixes of ``gram`` bytes and more: none is cut off from another;
    # windows are compared whole
    splitters = {SAMPLED: _splitters(runs, SAMPLED, n, sample, gram), DENSE: _splitters(runs, DENSE, n, sample, length)}
    most = 1 + max(map(len, splitters.values()))
    cut = runs.select("kind", "run").mapInArrow(_cut_runs(splitters, most), "range int, run binary")
    merged = cut.groupBy("range").applyInArrow(_merge_rows(length, gram), "part int, removed binary")
    removed = merged.unionByName(runs.select("part", "removed"))
    lost = table.groupBy("part").cogroup(removed.groupBy("part")).applyInArrow(_removal, OUT)

    everything = C.spread_join(light, first, "sha", "n", n_rows)
    lost = lost.withColumnRenamed("doc_id", "__d").withColumnRenamed("tie", "__t")
    out = everything.join(lost, (F.col("doc_id") == F.col("__d")) & (F.col("tie") == F.col("__t")), "left")
    copy = (F.col("doc_id") != F.col("first_id")) & (F.col("n_bytes") >= length)
    zero = F.lit(0).cast("long")
    return out.select(
        F.when(F.col("doc_id") != least, F.col("doc_id")).alias("doc_id"), "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
        F.when(copy, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", zero)).alias("n_spans"),
        F.when(copy, F.sha2(F.lit("").cast("binary"), 256)).otherwise(
            F.coalesce("kept_sha256", F.lower(F.hex("sha")))).alias("kept_sha256"))


# -- query --------------------------------------------------------------------

def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with what is removed from it as repeated earlier text."""
    return removed_passages(C.read(spark, sf_dir, "documents"))
