"""Byte-level BPE: encoding by a priority queue of merge ranks, decoding by joining vocabulary strings.

A text is cut into words by the splitting rule of byte-level BPE models, each
distinct word of a block is merged once, and the ids of all words are gathered.

* **Merging.**  A word's bytes are the symbols of a doubly linked list.  A heap
  holds (rank, place, id made) of each pair of neighbours that has a merge; the
  least is taken, and skipped as stale if the symbols at its place are no longer
  that pair.  A merge puts the two new pairs of its symbol on the heap, so a word
  of n bytes takes O(n log n) steps, also one of a megabyte.
* **Splitting** runs over arrays of code points: words tile a text, so a block's
  words are its own bytes with the words' offsets, and Arrow's dictionary finds
  the distinct ones.  Which code points are letters, numbers and white space is
  asked of the library's splitter when a code point is met first, so its version
  of Unicode counts.
* A long text is cut into pieces before a space that stands between ASCII
  letters: a word ends and a word begins there whatever lies around.
* **Decoding** joins the vocabulary's byte strings of the ids.

Defined results: a null or empty text has no ids and decodes to the empty text; a
special string inside a text is one token; bytes that are no UTF-8 count as
U+FFFD; ids that the vocabulary lacks stand for nothing, and ids whose bytes are
no UTF-8 decode to U+FFFD as in the library; repeated rows, also of one id, give
repeated results and a null ``doc_id`` stays null; an empty table gives an empty
one; other columns of ``docs``, whatever their names, are not read.  Merges of
one rank are made from left to right.  A very long text is held whole (its ids
are one row), its words in pieces of ``BLOCK`` bytes.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadspark.llm import common as C
from leadspark.llm import textbytes as T

MODEL = "byte_bpe_50k.json"
#: Bytes of text handled at once.
BLOCK = 1 << 21
#: Distinct words a worker remembers, and the longest it does so for.
REMEMBER = 500_000
LONG_WORD = 64

#: Bits of an id in the keys of merges.
ID_BITS = 20
IDS = (1 << ID_BITS) - 1

LETTER, NUMBER, MARK, SPACE, BLANK, NEW = range(1, 7)
#: What follows an apostrophe in a word of its own.
SHORT = {1: "stmd", 2: ("re", "ve", "ll")}


def byte_letters() -> list[str]:
    """The character that stands for each byte: itself if printable Latin-1, else one from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


class ByteBpe:
    """Vocabulary, merges and splitter of a model file of the ``tokenizers`` library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, splitter = spec["model"], spec["pre_tokenizer"] or {}
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix",
                                               "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if (model["type"] != "BPE" or not plain or spec["normalizer"] or splitter.get("type") != "ByteLevel"
                or splitter["add_prefix_space"] or not splitter.get("use_regex", True)):
            raise ValueError(f"{path} is no plain byte-level BPE model")
        letters = byte_letters()
        of = {c: b for b, c in enumerate(letters)}
        vocab = model["vocab"]
        if max(vocab.values()) > IDS:
            raise ValueError(f"{path}: ids of more than {ID_BITS} bits")
        self.raw = [b""] * (1 + max([*vocab.values(), *(a["id"] for a in spec["added_tokens"])]))
        for text, i in [*vocab.items(), *((a["content"], a["id"]) for a in spec["added_tokens"])]:
            self.raw[i] = bytes(of[c] for c in text) if all(c in of for c in text) else text.encode()
        self.byte_id = [vocab[c] for c in letters]
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a] << ID_BITS | vocab[b]] = rank + 1 << ID_BITS | vocab[a + b]
        # of two bytes
        self.first = [[self.merges.get(a << ID_BITS | b, 0) for b in self.byte_id] for a in self.byte_id]
        self.special = {}
        for a in spec["added_tokens"]:
            if a["single_word"] or a["lstrip"] or a["rstrip"]:
                raise ValueError(f"{path}: added token {a['content']!r} takes its surroundings along")
            self.special[a["content"].encode()] = a["id"]
        longest = sorted(self.special, key=len, reverse=True)
        self.find_special = re.compile(b"|".join(map(re.escape, longest))) if longest else None
        self.splitter = Tokenizer.from_file(path).pre_tokenizer
        self.kind = np.full(0x110000, NEW, np.uint8)
        self.forget()

    def forget(self) -> None:
        """Start with no word remembered."""
        self.known: dict[bytes, int] = {}
        self.flat, self.count = array("i"), array("i")

    # -- merging ------------------------------------------------------------------

    def merge(self, word: bytes) -> list[int]:
        """Ids of a word.

        A heap entry is one number: rank, id made and place, in this order.
        An entry is stale if the pair at its place is another by now.  Beyond the end
        of the list lies the symbol -1, which has no merge.
        """
        n, get, first = len(word), self.merges.get, self.first
        bits = n.bit_length()
        place = (1 << bits) - 1
        symbol = [self.byte_id[b] for b in word]
        made = [first[a][b] for a, b in zip(word, word[1:])]  # of the pair that begins at each place
        heap = [m << bits | i for i, m in enumerate(made) if m]
        if not heap:
            return symbol
        heapify(heap)
        symbol.append(-1)
        made += 0, 0
        before, after = list(range(-1, n)), list(range(1, n + 2))
        while heap:
            entry = heappop(heap)
            i = entry & place
            if made[i] != entry >> bits:
                continue  # stale
            j, h = after[i], before[i]
            k = after[j]
            symbol[i] = new = made[i] & IDS
            symbol[j] = -1
            made[j] = 0
            after[i] = k
            before[k] = i
            made[i] = m = get(new << ID_BITS | symbol[k], 0)
            if m:
                heappush(heap, m << bits | i)
            if h >= 0:
                made[h] = m = get(symbol[h] << ID_BITS | new, 0)
                if m:
                    heappush(heap, m << bits | h)
        return [s for s in symbol if s >= 0]

    # -- splitting ----------------------------------------------------------------

    def _learn_kinds(self, points: np.ndarray) -> None:
        """Ask the library's splitter which of its classes code points are in."""
        points = points[self.kind[points] == NEW].tolist()
        kinds = dict.fromkeys(points, SPACE)
        for kind, like in ((LETTER, "a"), (NUMBER, "1"), (MARK, "!")):
            probe = "".join(f"\n{like}{chr(c)}" for c in points)
            ends = {end for _, (_, end) in self.splitter.pre_tokenize_str(probe)}
            kinds |= {c: kind for i, c in enumerate(points) if 3 * i + 2 not in ends}  # not cut before it
        self.kind[points] = [kinds[c] for c in points]
        self.kind[32] = BLANK

    def _starts(self, buf: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """Byte offsets at which words start; ``cut`` has the offsets at which texts start."""
        points, at = buf, None
        if len(buf) and buf.max() >= 128:
            points = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), np.uint32)
            at = np.flatnonzero((buf & 0xC0) != 0x80)
            cut = np.searchsorted(at, cut)
        n = len(points)
        kind = self.kind[points]
        if (kind == NEW).any():
            self._learn_kinds(np.unique(points))
            kind = self.kind[points]
        first = np.zeros(n + 2, bool)
        first[cut[cut < n]] = True
        first[n:] = True
        space = kind >= SPACE
        start = np.empty(n, bool)
        start[0] = True
        # a word begins where the class changes; one blank before it belongs to it, so begins it
        start[1:] = np.where(space[1:], ~space[:-1], np.where(space[:-1], kind[:-1] == SPACE, kind[1:] != kind[:-1]))
        # of several spaces before a word, the last stands apart
        start[:-1] |= space[:-1] & ~space[1:] & ~first[1:n]
        start |= first[:n]
        mark = np.flatnonzero((points == 39) & start)
        if len(mark):
            ext = np.concatenate((points, np.zeros(2, points.dtype)))
            a, b = ext[mark + 1], ext[mark + 2]
            one = np.isin(a, [ord(c) for c in SHORT[1]]) & ~first[mark + 1]
            two = ~one & ~first[mark + 1] & ~first[mark + 2] & np.logical_or.reduce(
                [(a == ord(x)) & (b == ord(y)) for x, y in SHORT[2]])
            mark, size = mark[one | two], np.where(one, 2, 3)[one | two]
            start[mark + 1] = False
            end = mark + size
            start[end[end < n]] = True
        place = np.flatnonzero(start)
        return place if at is None else at[place]

    def _pieces(self, buf: np.ndarray, special: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
        """(from, to) of the pieces of one text, cut where words certainly end."""
        at, n, size = 0, len(buf), BLOCK
        inside = np.zeros(n if special else 0, bool)
        for a, b in special:
            inside[a + 1:b] = True
        while n - at > size:
            own = buf[at:at + size]
            letter = (own | 32) - np.uint8(97) < 26
            fits = (own[1:-1] == 32) & letter[:-2] & letter[2:]
            if special:
                fits &= ~inside[at + 1:at + size - 1]
            place = np.flatnonzero(fits)
            if not len(place):
                size *= 2
                continue
            end = at + 1 + int(place[-1])
            yield at, end
            at, size = end, BLOCK
        yield at, n

    # -- encoding -----------------------------------------------------------------

    def _block(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each text) of the texts ``buf[off[i]:off[i + 1]]``."""
        if not len(buf):
            return np.zeros(0, np.int32), np.zeros(len(off) - 1, np.int64)
        cut, held = off[:-1][np.diff(off) > 0], []
        if self.find_special:
            raw = buf.tobytes()
            for row in range(len(off) - 1) if any(s in raw for s in self.special) else ():
                held += [m.span() for m in self.find_special.finditer(raw, off[row], off[row + 1])]
            cut = np.unique(np.concatenate((cut, np.array(held, np.int64).ravel())))
        start = self._starts(buf, cut)
        for a, b in held:  # one word
            lo, hi = np.searchsorted(start, [a + 1, b])
            start = np.delete(start, np.arange(lo, hi))
        words = pa.Array.from_buffers(pa.binary(), len(start), [
            None, pa.py_buffer(np.append(start, len(buf)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(buf))])
        words = words.dictionary_encode()
        place, index = self._places(words.dictionary.to_pylist()), words.indices.to_numpy()
        count = np.frombuffer(self.count, np.int32)
        first = (np.cumsum(count) - count)[place][index]
        n = count[place][index].astype(np.int64)
        ends = np.cumsum(n)
        flat = np.frombuffer(self.flat, np.int32)
        ids = flat[np.repeat(first - (ends - n), n) + np.arange(ends[-1])]
        sums = np.concatenate(([0], ends))
        return ids, np.diff(sums[np.searchsorted(start, off)])

    def _places(self, words: list[bytes]) -> np.ndarray:
        """Where the ids of distinct words are kept."""
        if len(self.known) > REMEMBER:
            self.forget()
        known, special = self.known, self.special
        place = np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words))
        for k in np.flatnonzero(place < 0).tolist():
            w = words[k]
            ids = [special[w]] if w in special else self.merge(w)
            place[k] = len(self.count)
            if len(w) <= LONG_WORD:
                known[w] = len(self.count)
            self.flat.extend(ids)
            self.count.append(len(ids))
        return place

    def encode(self, col: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(rows, their ids one after the other, number of ids of each) of runs of a column's texts."""
        buf, off = T.column_bytes(col)
        row = 0
        while row < len(col):
            last = max(row + 1, int(np.searchsorted(off, off[row] + BLOCK, "right")) - 1)
            own, cut = buf[off[row]:off[last]], off[row:last + 1] - off[row]
            if last > row + 1 or len(own) <= BLOCK:
                ids, n = self._block(own, cut)
            else:
                special = [m.span() for m in self.find_special.finditer(own.tobytes())] if self.find_special else []
                parts = [self._block(own[a:b], np.array([0, b - a]))[0] for a, b in self._pieces(own, special)]
                ids = np.concatenate(parts)
                n = np.array([len(ids)])
            yield last - row, ids, n
            row = last

    # -- decoding -----------------------------------------------------------------

    @property
    def vocabulary(self) -> pa.Array:
        return pa.array([*self.raw, b""], pa.binary())

    def decode(self, lists: pa.ListArray) -> pa.Array:
        """The texts of lists of ids."""
        ids = lists.flatten().to_numpy(zero_copy_only=False)
        n = len(self.raw)
        if len(ids) and (ids.min() < 0 or ids.max() >= n):
            ids = np.where((ids < 0) | (ids >= n), n, ids)
        ends = np.cumsum(np.asarray(pc.list_value_length(lists), np.int64))
        parts = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)),
                                         self.vocabulary.take(pa.array(ids)))
        whole = pc.binary_join(parts, b"")
        try:
            return whole.cast(pa.string())
        except pa.ArrowInvalid:  # ids may spell broken characters
            return pa.array([t.decode("utf-8", "replace") for t in whole.to_pylist()], pa.string())


@lru_cache(maxsize=2)
def coder(model: str) -> ByteBpe:
    """A model file, or a name that ``public_tokenizers`` knows; one copy a worker."""
    if os.sep not in model:
        import public_tokenizers
        model = public_tokenizers.path(model)
    return ByteBpe(model)


def _valid(col: pa.Array) -> pa.Array:
    """The texts without nulls and broken characters."""
    col = col.fill_null("") if col.null_count else col
    try:
        col.validate(full=True)
    except pa.ArrowInvalid:
        col = pa.array([t.decode("utf-8", "replace") for t in col.cast(pa.binary()).to_pylist()], pa.string())
    return col


def _lists(ids: np.ndarray, n: np.ndarray) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum(n)))
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))


def _packed(ids: np.ndarray, n: np.ndarray) -> pa.Array:
    """Each text's ids as little-endian unsigned 32-bit integers."""
    ends = np.concatenate(([0], np.cumsum(n))) * 4
    return pa.Array.from_buffers(pa.binary(), len(n), [
        None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(ids.astype("<i4")))])


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text, ids) of every row of ``docs``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(model)
        for b in batches:
            at = 0
            for rows, ids, n in own.encode(_valid(b.column(1))):
                part = b.slice(at, rows)
                at += rows
                yield pa.RecordBatch.from_arrays([*part.columns, _lists(ids, n)], ["doc_id", "text", "ids"])
    return _rows(docs).mapInArrow(run, "doc_id long, text string, ids array<int>")


def decode(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """``rows`` (doc_id, ids) with the text that the ids stand for, ``decoded``; a null list is empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(model)
        for b in batches:
            ids = b.column(1)
            if ids.null_count or ids.flatten().null_count:
                ids = pa.array([[i for i in x or [] if i is not None] for x in ids.to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns, own.decode(ids)], ["doc_id", "ids", "decoded"])
    own = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"))
    return own.mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def round_trip(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, packed, decoded): encoded and decoded again in one pass.

    ``packed`` holds the ids as little-endian unsigned 32-bit integers, the form
    in which token files are written.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(model)
        for b in batches:
            at = 0
            for rows, ids, n in own.encode(_valid(b.column(1))):
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, rows), _packed(ids, n), own.decode(_lists(ids, n))],
                    ["doc_id", "packed", "decoded"])
                at += rows
    return _rows(docs).mapInArrow(run, "doc_id long, packed binary, decoded string")


# -- query --------------------------------------------------------------------

def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: number and digest of its ids, digest of the text that they decode to."""
    out = round_trip(C.read(spark, sf_dir, "documents"))
    return out.select("doc_id", (F.octet_length("packed") / 4).cast("long").alias("n_tokens"),
                      F.sha2("packed", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
