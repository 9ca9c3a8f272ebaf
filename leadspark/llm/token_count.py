"""Token counts of whole texts by a tokenizer of the ``tokenizers`` library.

Documents of up to ``CHUNK`` characters are counted word by word: white space is
a boundary (see below), so a text has as many tokens as its words together, and
each worker asks the library for a word's count once and remembers it.  A longer
document is encoded in chunks that overlap, with offsets, and the chunks' token
sequences are spliced inside each overlap.  A splice point is a place after
white space at which both sequences start a token, with the same ids at the
same offsets from the overlap's first such place to its last one.  White space
is a proven boundary of this tokenizer: its splitter drops white space, so no
word, composed character or special string reaches across.  Where an overlap
holds no such place (a very long word), it is widened, at last to the whole of
the chunk before, which is then encoded together with the next one.

Each text is handled alone, in memory proportional to a chunk (to the distance
between two splice points, in the worst case).

Defined results: a null text is empty and has no tokens; repeated rows are
counted alike; special strings inside a text are special tokens (the
library's default); nothing is added, cut or padded.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadspark.llm import common as C

MODEL = "word_bpe_49k.json"
#: Characters of a chunk, and of the first overlap of two chunks.
CHUNK = 1 << 15
OVERLAP = 1 << 9
LIMIT = 2048
#: Characters of documents handled at once.
BATCH = 1 << 20
#: Words whose counts a worker remembers, and the longest word it does so for.
REMEMBER = 400_000
WORD = 64

_AFTER_SPACE = re.compile(r"(?<=[ \n\t\r])[^ \n\t\r]")


_PROBES = ["a", "the", "Word", "don't", "'s", "1", "2024", ",", "...", "(x)", "\u00e9", "e\u0301", "\u4e2d\u6587", "_", "#a", "\ufb01"]


def parts_at_white_space(t) -> bool:
    """Whether the tokenizer gives words with white space between them the tokens that each has alone.

    Tried on words of all kinds beside each other and on its own special strings; white space alone has no token.
    """
    words = _PROBES + [x.content for x in t.get_added_tokens_decoder().values()]
    if any(c in w for w in words for c in " \n\t\r"):
        return False

    def ids(texts: list[str]) -> list[list[int]]:
        return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    alone = dict(zip(words, ids(words)))
    for gap in (" ", "\n", "\t", "\r", "  ", " \n "):
        pairs = [(a, b) for a in words for b in words[:len(_PROBES) + 8]]
        if ids([gap]) != [[]] or ids([gap + a + gap + b + gap for a, b in pairs]) != [
                alone[a] + alone[b] for a, b in pairs]:
            return False
    return True


@lru_cache(maxsize=4)
def tokenizer(model: str):
    """The tokenizer of a file, or of a name that ``public_tokenizers`` knows."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
    from tokenizers import Tokenizer
    path = model
    if os.sep not in model:
        import public_tokenizers
        path = public_tokenizers.path(model)
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    if not parts_at_white_space(t):
        raise ValueError(f"white space is no boundary of the tokenizer {model}: its words cannot be counted apart")
    return t


Tokens = list[tuple[int, int]]


def _encoder(model: str) -> Callable[[str, int], Tokens]:
    t = tokenizer(model)

    def encode(text: str, at: int) -> Tokens:
        """(place in the document, id) of the tokens of a chunk that starts at ``at``."""
        e = t.encode(text, add_special_tokens=False)
        return [(at + o[0], i) for o, i in zip(e.offsets, e.ids)]
    return encode


def splice(left: Tokens, right: Tokens, text: str, lo: int, hi: int) -> int | None:
    """The place in [lo, hi) where ``left`` may end and ``right`` go on, or None."""
    places = [lo + m.start() for m in _AFTER_SPACE.finditer(text[lo:hi])]
    if len(places) < 2:
        return None
    first, last = places[0], places[-1]
    a = [x for x in left if first <= x[0] < last]
    b = [x for x in right if first <= x[0] < last]
    starts = {x[0] for x in a}
    good = [p for p in places[:-1] if p in starts]
    if a != b or not good:
        return None
    return good[len(good) // 2]


def chunked(text: str, encode: Callable[[str, int], Tokens], chunk: int = CHUNK,
            overlap: int = OVERLAP) -> Iterator[Tokens]:
    """Token runs whose concatenation is the encoding of the whole text."""
    if overlap < 1 or chunk <= overlap:
        raise ValueError("a chunk is longer than the overlap, which is not empty")
    begin, end = 0, min(chunk, len(text))
    left = encode(text[:end], 0)
    keep_from = 0  # tokens before this place have been handed out
    while end < len(text):
        width, nxt = overlap, min(end + chunk - overlap, len(text))
        while True:
            lo = max(end - width, begin)
            if lo <= begin:  # widened over the whole chunk: encode both together
                left = encode(text[begin:nxt], begin)
                break
            right = encode(text[lo:nxt], lo)
            at = splice(left, right, text, lo, end)
            if at is not None:
                yield [x for x in left if keep_from <= x[0] < at]
                left, begin, keep_from = [x for x in right if x[0] >= at], lo, at
                break
            width *= 2
        end = nxt
    yield [x for x in left if x[0] >= keep_from]


class WordCounts:
    """Token counts of texts from the library's counts of their words."""

    def __init__(self, model: str):
        self.tokenizer, self.known = tokenizer(model), {"": 0}

    def _ask(self, words: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def count(self, texts: list[str]) -> list[int]:
        split = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        if len(self.known) > REMEMBER:
            self.known = {"": 0}
        new = list(set(chain.from_iterable(split)).difference(self.known))
        known, long = self.known, {}
        for w, n in zip(new, self._ask(new)):
            (known if len(w) <= WORD else long)[w] = n
        if long:
            known = known | long
        return [sum(map(known.__getitem__, ws)) for ws in split]


@lru_cache(maxsize=4)
def word_counts(model: str) -> WordCounts:
    """One copy a worker."""
    return WordCounts(model)


def count_tokens(docs: DataFrame, model: str = MODEL, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row of ``docs``."""
    def counts(texts: list[str]) -> list[int]:
        out, held, size = [0] * len(texts), [], 0

        def flush():
            for i, n in zip(held, word_counts(model).count([texts[i] for i in held])):
                out[i] = n
            held.clear()
        for i, text in enumerate(texts):
            if len(text) > chunk:
                out[i] = sum(map(len, chunked(text, _encoder(model), chunk, overlap)))
            elif text:
                held.append(i)
                size += len(text)
                if size >= BATCH:
                    flush()
                    size = 0
        if held:
            flush()
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = counts([t or "" for t in b.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())],
                                             ["doc_id", "n_bytes", "n_tokens"])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")


# -- query --------------------------------------------------------------------

def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count of every document and whether it exceeds the limit."""
    out = count_tokens(C.read(spark, sf_dir, "documents"))
    return out.withColumn("over_limit", F.col("n_tokens") > LIMIT)
