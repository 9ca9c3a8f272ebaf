"""SentencePiece encoding and decoding by a batched numpy Viterbi.

Texts are cut into words (runs of the word mark and what follows) by array
operations on their bytes; words tile a text, so Arrow's dictionary finds a block's
distinct ones, each of which is encoded once.  Words of equal length advance together: at each place the
substrings that end there are looked up by hash among the sorted hashes of the
pieces, the best of the candidates is chosen by a vectorised maximum, and the
length of the winner is stored as the backpointer.

What "best" means depends on the model:

* unigram: the largest sum of piece scores, the Viterbi path;
* BPE: the piece that the merge rules leave last.  A sequence of pieces is the
  BPE encoding exactly if each two neighbours are (no merge crosses the border
  between them), so at each place exactly one candidate fits the piece before
  it, and the maximum runs over a score that is 0 for it and -inf otherwise.
  The result equals merging by rank, so it equals the library's.

The border test walks both pieces' merges backwards, vectorised over all
candidate pairs.  Characters without a piece become their bytes' pieces.

Defined results: a null text gives an empty list, and an empty list the empty
text; white space other than the space is kept as it is; the word mark itself
(U+2581) decodes as a space; repeated rows give repeated results; bytes that are
no UTF-8 count as U+FFFD; an empty table gives an empty one; other columns, whatever
their names, are not read.  A very long text is held whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadspark.llm import common as C
from leadspark.llm import textbytes as T

MODEL = "piece_bpe_32k.model"
MARK = "▁"
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Distinct words a worker remembers, and candidate cells handled at once.
REMEMBER = 400_000
#: Bytes of text handled at once.
BLOCK = 1 << 20
CELLS = 1 << 21
#: A longer word is cut where its neighbouring characters stand together in no piece.
LONG_WORD = 48


def _merge(text: str, rank: dict[str, int]) -> list[str]:
    """BPE of a short text by definition: merge the best pair, the leftmost of equals, until none is left."""
    parts = list(text)
    while len(parts) > 1:
        best = min(((rank.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))))
        if best[0] == 1 << 60:
            break
        i = best[1]
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
    return parts


class Pieces:
    """Vocabulary tables of a model file."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        self.unknown = sp.unk_id()
        self.byte = {int(self.text[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.raw = [b"" if sp.is_control(i) else bytes([int(self.text[i][3:5], 16)]) if sp.is_byte(i)
                    else " ⁇ ".encode() if sp.is_unknown(i) else self.text[i].replace(MARK, " ").encode()
                    for i in range(n)]
        self.spelt = pa.array(self.raw, pa.binary())
        score = np.array([sp.get_score(i) for i in range(n)])
        self.score = score
        # a BPE model scores its pieces by the order of their merges: whole numbers from 0 down
        long = [i for i in normal if len(self.text[i]) > 1]
        self.is_bpe = bool(long) and bool(np.all(score[long] == np.round(score[long])))
        ids = {self.text[i]: i for i in normal}
        self.max_len = max(map(len, ids), default=1)
        self.joint = {p[i:i + 2] for p in ids for i in range(len(p) - 1)}
        # pieces by hash of their code points
        self.chars = np.zeros((n, self.max_len), np.uint32)
        self.length = np.zeros(n, np.int64)
        for p, i in ids.items():
            self.length[i] = len(p)
            self.chars[i, :len(p)] = np.frombuffer(p.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.left = np.arange(n)
        self.right = np.arange(n)
        self.rank = np.full(n, -1, np.int64)
        usable = list(ids.values())
        if self.is_bpe:
            order = {self.text[i]: r for r, i in enumerate(sorted(long, key=lambda i: (-score[i], i)))}
            usable = [i for p, i in ids.items() if len(p) == 1]
            for p, r in order.items():
                parts = _merge(p, {k: v for k, v in _inside(p, order) if k != p})
                if len(parts) == 2 and parts[0] in ids and parts[1] in ids:  # else no merge ever makes it
                    i = ids[p]
                    self.left[i], self.right[i], self.rank[i] = ids[parts[0]], ids[parts[1]], r
                    usable.append(i)
            made = np.flatnonzero(self.rank >= 0)
            key = self.left[made] * n + self.right[made]
            self.pair_key, self.pair_rank = key[np.argsort(key)], self.rank[made][np.argsort(key)]
        h = self._hashes(self.chars)[np.arange(n), self.length]
        usable = np.array(sorted(usable), np.int64)
        self.sorted_hash = np.sort(h[usable])
        self.sorted_id = usable[np.argsort(h[usable], kind="stable")]
        self.maybe = np.zeros(1 << 20, bool)  # most substrings are no piece: one look here says so
        self.maybe[(self.sorted_hash >> np.uint64(44)).astype(np.int64)] = True
        # border tests already made: a slot holds the last pair that fell on it
        self.pair_slot = np.full(1 << 21, -1, np.int64)
        self.pair_fits = np.zeros(1 << 21, bool)
        cut = [c for c in "\n\t\r\x0b\x0c" if not any(c in j for j in self.joint)]
        self.cut_marks = not any(j[1] == MARK != j[0] for j in self.joint)
        self.alone = np.zeros(256, bool)
        self.alone[[ord(c) for c in cut]] = True
        self.forget()

    def forget(self) -> None:
        """Start with no word remembered."""
        self.known: dict[bytes, int] = {}  # word -> its place in the arrays below
        self.first, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    @staticmethod
    def _hashes(codes: np.ndarray) -> np.ndarray:
        """Prefix hashes of the rows: column k covers the first k code points."""
        h = np.zeros((len(codes), codes.shape[1] + 1), np.uint64)
        for k in range(codes.shape[1]):
            h[:, k + 1] = h[:, k] * BASE + codes[:, k].astype(np.uint64) + np.uint64(1)
        return h

    # -- border test --------------------------------------------------------------

    def _pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * len(self.text) + b
        at = np.searchsorted(self.pair_key, key).clip(max=len(self.pair_key) - 1)
        return np.where(self.pair_key[at] == key, self.pair_rank[at], np.iinfo(np.int64).max)

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether no merge crosses the border of the pieces a | b, from the tests made before or a new one."""
        key = a * len(self.text) + b
        slot = (key * 0x9E3779B1 >> 11) & (len(self.pair_slot) - 1)
        out = self.pair_fits[slot]
        new = np.flatnonzero(self.pair_slot[slot] != key)
        if len(new):
            out[new] = self._fits(a[new], b[new])
            self.pair_slot[slot[new]] = key[new]
            self.pair_fits[slot[new]] = out[new]
            out[a < 0] = True
        return out

    def _fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The border test.  Ids below zero (unknown characters) never merge."""
        ok = np.ones(len(a), bool)
        live = np.flatnonzero((a >= 0) & (b >= 0))
        x, y = a[live].copy(), b[live].copy()
        limit = np.full(len(live), np.iinfo(np.int64).max)
        while len(live):
            crossed = self._pair_rank(x, y) < limit
            ok[live[crossed]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~crossed & ((rx >= 0) | (ry >= 0))
            live, x, y, rx, ry = live[go], x[go], y[go], rx[go], ry[go]
            # undo the later of the two merges; of equal ranks the right one came later
            undo = rx > ry
            limit = np.where(undo, rx, ry + 1)
            x, y = np.where(undo, self.right[x], x), np.where(undo, y, self.left[y])
        return ok

    # -- words --------------------------------------------------------------------

    def _candidates(self, codes: np.ndarray) -> np.ndarray:
        """Piece id of each substring: [word, end, length - 1]; -2 where there is none."""
        n, size = codes.shape
        top = min(self.max_len, size)
        out = np.full((n, size + 1, top), -2, np.int64)
        h = self._hashes(codes)
        power = np.uint64(1)
        with np.errstate(over="ignore"):
            for k in range(1, top + 1):
                power = power * BASE
                sub = h[:, k:] - h[:, :-k] * power
                w, e = np.nonzero(self.maybe[(sub >> np.uint64(44)).astype(np.int64)])
                own = sub[w, e]
                at = np.searchsorted(self.sorted_hash, own).clip(max=len(self.sorted_hash) - 1)
                hit = self.sorted_hash[at] == own
                w, e, i = w[hit], e[hit], self.sorted_id[at[hit]]
                same = self.length[i] == k
                for c in range(k):  # the hash proposes, the characters decide
                    same &= self.chars[i, c] == codes[w, e + c]
                out[w[same], e[same] + k, k - 1] = i[same]
        return out

    def _best_lengths(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece, length) chosen at each place of each word."""
        n, size = codes.shape
        cand = self._candidates(codes)
        top = cand.shape[2]
        last = np.full((n, size + 1), -1, np.int64)
        back = np.ones((n, size + 1), np.int64)
        total = np.full((n, size + 1), -np.inf)
        total[:, 0] = 0
        floor = float(self.score.min()) - 10  # of an unknown character, as in the library
        rows = np.arange(n)
        for e in range(1, size + 1):
            k = min(top, e)
            c = cand[:, e, :k]
            before = e - 1 - np.arange(k)
            have = c >= 0
            if self.is_bpe:
                w, j = np.nonzero(have)
                prev = last[w, before[j]]
                fit = (before[j] == 0) | self.fits(prev, c[w, j])
                value = np.full(c.shape, -np.inf)
                value[w[fit], j[fit]] = 0.0
            else:
                value = np.where(have, self.score[np.maximum(c, 0)] + total[:, before], -np.inf)
                value[:, 0] = np.where(have[:, 0], value[:, 0], total[:, e - 1] + floor)
            best = value.argmax(axis=1)
            back[:, e] = best + 1
            last[:, e] = np.where(np.isfinite(value[rows, best]), np.maximum(c[rows, best], -1), -1)
            total[:, e] = value[rows, best]
        return last, back

    def _spell(self, char: int) -> tuple[int, ...]:
        raw = chr(char).encode("utf-8", "surrogatepass")
        return tuple(self.byte[x] for x in raw) if len(self.byte) == 256 else (self.unknown,)

    def _encode_equal(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, one after the other, and how many each has) of words of one length."""
        size = len(words[0])
        step = max(1, CELLS // (size * min(self.max_len, size)))
        flat, count = [], []
        for at in range(0, len(words), step):
            some = words[at:at + step]
            raw = "".join(some).encode("utf-32-le", "surrogatepass")
            codes = np.frombuffer(raw, np.uint32).reshape(len(some), size)
            last, back = self._best_lengths(codes)
            place, ids = np.full(len(some), size), []
            while (place > 0).any():
                rows = np.flatnonzero(place > 0)
                got = np.full(len(some), -3, np.int64)
                got[rows] = last[rows, place[rows]]
                unknown = rows[got[rows] == -1]
                got[unknown] = -10 - codes[unknown, place[unknown] - 1].astype(np.int64)
                ids.append(got)
                place[rows] -= back[rows, place[rows]]
            table = np.stack(ids[::-1], axis=1)
            n = (table != -3).sum(axis=1)
            ids = table[table != -3]
            if (ids <= -10).any():  # characters without a piece: their bytes
                spelt = [self._spell(-10 - i) if i < 0 else (i,) for i in ids.tolist()]
                row = np.repeat(np.arange(len(n)), n)
                n = np.bincount(row, weights=list(map(len, spelt)), minlength=len(n)).astype(np.int64)
                ids = np.fromiter(chain.from_iterable(spelt), np.int64)
            flat.append(ids)
            count.append(n)
        return np.concatenate(flat), np.concatenate(count)

    def _learn(self, words: list[bytes]) -> None:
        """Encode words and remember them; a space in a word stands for the word mark."""
        split = [w.decode().replace(" ", MARK) for w in words]
        split = [[w] if len(w) <= LONG_WORD else self._cut(w) for w in split]
        groups: dict[int, dict[str, int]] = {}  # equal-length parts, each once
        for part in chain.from_iterable(split):
            groups.setdefault(len(part), {}).setdefault(part, 0)
        flat, count, at = [], [], 0
        for own in groups.values():
            own.update(zip(own, range(at, at + len(own))))
            at += len(own)
            ids, n = self._encode_equal(list(own))
            flat.append(ids.astype(np.int32))
            count.append(n)
        flat, count = np.concatenate(flat), np.concatenate(count)
        place = np.fromiter((groups[len(p)][p] for p in chain.from_iterable(split)), np.int64)
        ids, n = _gather(flat, np.cumsum(count) - count, count, place)
        ends = np.concatenate(([0], np.cumsum(n)))[np.cumsum([0, *map(len, split)])]
        self.known.update(zip(words, range(len(self.count), len(self.count) + len(words))))
        self.flat = np.concatenate((self.flat, ids))
        self.count = np.concatenate((self.count, np.diff(ends)))
        self.first = np.cumsum(self.count) - self.count

    def _cut(self, word: str) -> list[str]:
        """A long word in parts between which no piece reaches."""
        parts, at = [], 0
        for i in range(1, len(word)):
            if word[i - 1:i + 1] not in self.joint:
                parts.append(word[at:i])
                at = i
        return [*parts, word[at:]]

    def _starts(self, buf: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Byte offsets at which words start; ``first`` are those at which texts start.

        A word is a run of marks and what follows up to the next mark; characters
        that stand together with no other one in any piece are words of their own.
        """
        start = np.zeros(len(buf), bool)
        if self.cut_marks:
            mark = buf == 32
            spelt = np.flatnonzero(buf == 0xE2)  # the mark itself has three bytes
            if len(spelt):
                ext = np.append(buf, [0, 0])
                spelt = spelt[(ext[spelt + 1] == 0x96) & (ext[spelt + 2] == 0x81)]
                for k in range(3):
                    mark[spelt + k] = True
            alone = self.alone[buf]
            start |= mark
            start[1:] &= ~mark[:-1]
            start |= alone
            start[1:] |= alone[:-1]
        start[first] = True
        return np.flatnonzero(start)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after the other, and how many each has)."""
        parts = list(self.encode_column(pa.array(texts, pa.string())))
        if not parts:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        return np.concatenate([ids for _, ids, _ in parts]), np.concatenate([n for _, _, n in parts])

    def encode_column(self, col: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(rows, their ids one after the other, number of ids of each) of runs of a column's texts."""
        # the blank before a text is the mark of its first word
        col = pc.if_else(pc.equal(col, ""), "", pc.binary_join_element_wise(" ", col, ""))
        buf, off = T.column_bytes(col)
        row = 0
        while row < len(col):
            last = max(row + 1, int(np.searchsorted(off, off[row] + BLOCK, "right")) - 1)
            own, cut = buf[off[row]:off[last]], off[row:last + 1] - off[row]
            yield last - row, *self._block(own, cut)
            row = last

    def _block(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(buf):
            return np.zeros(0, np.int32), np.zeros(len(off) - 1, np.int64)
        start = self._starts(buf, off[:-1][np.diff(off) > 0])
        words = pa.Array.from_buffers(pa.binary(), len(start), [
            None, pa.py_buffer(np.append(start, len(buf)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(buf))])
        words = words.dictionary_encode()
        if len(self.known) > REMEMBER:
            self.forget()
        distinct = words.dictionary.to_pylist()
        new = [w for w in distinct if w not in self.known]
        if new:
            self._learn(new)
        place = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))
        ids, n = _gather(self.flat, self.first, self.count, place[words.indices.to_numpy()])
        ends = np.concatenate(([0], np.cumsum(n)))
        return ids, np.diff(ends[np.searchsorted(start, off)])

    def decode(self, lists: pa.ListArray) -> pa.Array:
        """The texts of lists of ids."""
        flat = self.spelt.take(lists.flatten())
        size = np.asarray(pc.list_value_length(lists), np.int64)
        parts = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), flat)
        whole = pc.binary_join(parts, b"")
        whole = pc.if_else(pc.starts_with(whole, b" "), pc.binary_replace_slice(whole, 0, 1, b""), whole)
        try:
            return whole.cast(pa.string())
        except pa.ArrowInvalid:  # ids that are no encoding may spell broken characters
            return pa.array([t.decode("utf-8", "replace") for t in whole.to_pylist()], pa.string())


def _gather(flat: np.ndarray, first: np.ndarray, count: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, number of ids of each) of the entries at ``place``, one after the other."""
    n = count[place]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(n) else 0
    return flat[np.repeat(first[place] - (ends - n), n) + np.arange(total)], n


@lru_cache(maxsize=2)
def pieces(model: str) -> Pieces:
    """Tables of a model file, or of a name that ``public_tokenizers`` knows; one copy a worker."""
    if os.sep not in model:
        import public_tokenizers
        model = public_tokenizers.path(model)
    return Pieces(model)


def _inside(p: str, order: dict[str, int]) -> Iterator[tuple[str, int]]:
    """Pieces that occur in ``p``."""
    for i in range(len(p)):
        for j in range(i + 2, len(p) + 1):
            if p[i:j] in order:
                yield p[i:j], order[p[i:j]]


def _texts(col: pa.Array) -> pa.Array:
    """The texts without nulls and broken characters."""
    col = col.fill_null("") if col.null_count else col
    try:
        col.validate(full=True)
    except pa.ArrowInvalid:
        col = pa.array([t.decode("utf-8", "replace") for t in col.cast(pa.binary()).to_pylist()], pa.string())
    return col


def _lists(ids: np.ndarray, n: np.ndarray) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum(n)))
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids, pa.int32()))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text, ids) of every row of ``docs``."""
    def run(batches):
        p = pieces(model)
        for b in batches:
            at = 0
            for rows, ids, n in p.encode_column(_texts(b.column(1))):
                part = b.slice(at, rows)
                at += rows
                yield pa.RecordBatch.from_arrays([*part.columns, _lists(ids, n)], ["doc_id", "text", "ids"])
    return _rows(docs).mapInArrow(run, "doc_id long, text string, ids array<int>")


def decode(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """``rows`` (doc_id, text, ids) with the text that the ids stand for, ``decoded``."""
    def run(batches):
        p = pieces(model)
        for b in batches:
            ids = b.column(2).fill_null([]) if b.column(2).null_count else b.column(2)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], p.decode(ids)], ["doc_id", "text", "ids", "decoded"])
    return rows.select("doc_id", "text", "ids").mapInArrow(
        run, "doc_id long, text string, ids array<int>, decoded string")


def round_trip(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, ids, decoded, same): encoded and decoded again in one pass; ``same`` says whether the text came back."""
    def run(batches):
        p = pieces(model)
        for b in batches:
            at, texts = 0, _texts(b.column(1))
            for rows, ids, n in p.encode_column(texts):
                lists = _lists(ids, n)
                decoded = p.decode(lists)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, rows), lists, decoded, pc.equal(decoded, texts.slice(at, rows))],
                    ["doc_id", "ids", "decoded", "same"])
                at += rows
    return _rows(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded string, same boolean")


# -- query --------------------------------------------------------------------

def digest(coded: DataFrame) -> DataFrame:
    """Per document: number and hash of its ids, digest of the decoded text, whether it is the text."""
    same = F.col("same") if "same" in coded.columns else F.col("decoded") == F.coalesce("text", F.lit(""))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"),
                        F.sha2("decoded", 256).alias("decoded_sha256"), same.alias("round_trip"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    return digest(round_trip(C.read(spark, sf_dir, "documents")))
