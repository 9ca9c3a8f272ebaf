"""Texts of an Arrow column as byte blocks, for vectorised passes in bounded memory."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text that a vectorised pass holds at once (a few 8-byte arrays of this length).
BLOCK = 1 << 18

#: The white space of this package: space and the control characters 9 to 13.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True

BASE = np.uint64(0x9E3779B97F4A7C15)


class Block(NamedTuple):
    buf: np.ndarray    # bytes
    start: np.ndarray  # of each piece in buf
    end: np.ndarray
    row: np.ndarray    # the row each piece belongs to


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column, without a copy; a null has no bytes."""
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    large = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64 if large else np.int32)[col.offset:col.offset + len(col) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, off.astype(np.int64)


def blocks(col: pa.Array, limit: int | None = None) -> Iterator[Block]:
    """The column's texts in blocks of about ``limit`` bytes; longer texts in pieces cut before white space."""
    limit = limit or BLOCK
    buf, off = column_bytes(col)
    first = 0
    while first < len(col):
        last = int(np.searchsorted(off, off[first] + limit, "right")) - 1
        if last > first:
            lo, hi = off[first], off[last]
            yield Block(buf[lo:hi], off[first:last] - lo, off[first + 1:last + 1] - lo, np.arange(first, last))
            first = last
            continue
        at, hi = off[first], off[first + 1]
        while at < hi:
            end = hi
            if hi - at > limit:
                gap = np.flatnonzero(IS_SPACE[buf[at + limit // 2:at + limit]])
                end = at + limit // 2 + gap[-1] if len(gap) else at + limit
            yield Block(buf[at:end], np.zeros(1, np.int64), np.array([end - at]), np.array([first]))
            at = end
        first += 1


_POWERS: dict[int, np.ndarray] = {}


def powers(n: int) -> np.ndarray:
    """BASE^0 .. BASE^(n-1) modulo 2^64."""
    have = _POWERS.get(0)
    if have is None or len(have) < n:
        have = np.ones(max(n, BLOCK + 4096), np.uint64)
        have[1:] = BASE
        np.cumprod(have, out=have)
        _POWERS[0] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Words(NamedTuple):
    start: np.ndarray
    end: np.ndarray
    piece: np.ndarray  # index of the block's piece
    hash: np.ndarray


def word_table(b: Block) -> Words:
    """Words (runs without white space) of a block's pieces with a 64-bit hash of their bytes."""
    n = len(b.buf)
    if not n:
        z = np.zeros(0, np.int64)
        return Words(z, z, z, z.astype(np.uint64))
    solid = ~IS_SPACE[b.buf]
    cut = np.zeros(n + 1, bool)
    cut[b.start] = True
    cut[b.end] = True
    before = np.concatenate(([False], solid[:-1])) & ~cut[:-1]
    start = np.flatnonzero(solid & ~before)
    after = np.concatenate((solid[1:], [False])) & ~cut[1:]
    end = np.flatnonzero(solid & ~after) + 1
    # polynomial hash: the sum of (byte + 1) * BASE^(place in the word)
    p = powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((b.buf.astype(np.uint64) + np.uint64(1)) * p, out=sums[1:])
    length = (end - start).astype(np.uint64)
    h = (sums[end] - sums[start]) * powers(n)[n - 1 - start]
    piece = np.searchsorted(b.start, start, "right") - 1
    empty = b.end[piece] <= start  # an empty piece shares its start with the next one
    if empty.any():
        order = np.flatnonzero(b.end > b.start)
        piece = order[np.searchsorted(b.start[order], start, "right") - 1]
    # words at different places have weights shifted by a known power: dividing by BASE^start is
    # multiplying by BASE^(n-1-start) up to the block's constant BASE^(n-1), which is taken out
    h = h * _inverse_power(n - 1)
    return Words(start, end, piece, mix(h + length * np.uint64(0xC2B2AE3D27D4EB4F)))


class Whole(NamedTuple):
    row: np.ndarray
    start: np.ndarray   # in the block, 0 if in an earlier one
    size: np.ndarray
    last: np.ndarray    # byte
    before: np.ndarray  # the byte before it in the word, or 0
    hash: np.ndarray


def whole_words(col: pa.Array, fold: np.ndarray | None = None) -> Iterator[tuple[Block, Whole, bool]]:
    """(block, words that end in it, whether its text goes on), the same words for any block size.

    ``fold`` maps the bytes that words are made of; blocks come unmapped.  A
    word cut by the end of a block is carried on as the sum, size and last
    bytes of what is read of it.
    """
    held, stream = None, blocks(col)
    b = next(stream, None)
    while b is not None:
        after = next(stream, None)
        more = after is not None and after.row[0] == b.row[-1]
        buf = b.buf if fold is None else fold[b.buf]
        w = word_table(b._replace(buf=buf))
        size, last = w.end - w.start, buf[w.end - 1]
        got = Whole(b.row[w.piece], w.start, size, last, np.where(size > 1, buf[w.end - 2], 0), w.hash)
        if held is not None or more:
            got = Whole(*(np.array(x) for x in got))
        total = None
        if held is not None:  # the first word began earlier
            total = (held[0] + pow(int(BASE), held[1], 1 << 64) * _sum(buf[:size[0]])) % (1 << 64)
            got.before[0] = got.before[0] if size[0] > 1 else held[2]
            got.size[0] += held[1]
            got.hash[0] = _finish(total, int(got.size[0]))
            held = None
        if more and len(buf) and not (IS_SPACE[buf[-1]] or IS_SPACE[(after.buf if fold is None else fold[after.buf[:1]])[0]]):
            if total is None or len(size) > 1:
                total = _sum(buf[w.start[-1]:])
            held = total, int(got.size[-1]), int(got.last[-1])
            got = Whole(*(x[:-1] for x in got))
        yield b, got, more
        b = after


def _sum(word: np.ndarray) -> int:
    """The polynomial hash of a word before its bits are spread."""
    return int(((word.astype(np.uint64) + np.uint64(1)) * powers(len(word))).sum())


def _finish(total: int, size: int) -> np.uint64:
    return mix(np.array([total], np.uint64) + np.array([size], np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))[0]


def _inverse_power(k: int) -> np.uint64:
    return np.uint64(pow(pow(int(BASE), k, 1 << 64), -1, 1 << 64))


def hash_of(word: str) -> np.uint64:
    """The hash ``word_table`` gives a word."""
    raw = np.frombuffer(word.encode(), np.uint8)
    return word_table(Block(raw, np.zeros(1, np.int64), np.array([len(raw)]), np.zeros(1, np.int64))).hash[0]


def per_row(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``values`` by row."""
    return np.bincount(row, weights=values, minlength=n)
