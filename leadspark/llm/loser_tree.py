"""Front-coded sorted runs of byte strings and their merge by a loser tree that knows common prefixes.

A run holds sorted keys; each is stored as the length of the prefix it shares
with the key before it, and the rest.  The tree keeps, for each run's next key,
the prefix it shares with the key last put out.  Of two keys the one that
shares more comes first; bytes are compared only if both share equally much,
and only beyond that prefix, so a prefix known to be common is never compared
again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def common(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the common prefix of ``a`` and ``b``, of which ``at`` bytes are known."""
    n = min(len(a), len(b))
    while at < n:
        x, y = a[at:min(at + 32, n)], b[at:min(at + 32, n)]
        if x != y:
            d = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
            return at + len(x) - (d.bit_length() + 7) // 8
        at += len(x)
    return n


def expand(shared: np.ndarray, size: np.ndarray, tails: bytes) -> list[bytes]:
    """Keys of a front-coded run."""
    out, key, at = [], b"", 0
    for k, n in zip(shared.tolist(), size.tolist()):
        key = key[:k] + tails[at:at + n]
        at += n
        out.append(key)
    return out


def merge(runs: list[tuple[list[bytes], list[int]]]) -> Iterator[tuple[int, int, int]]:
    """(run, place in it, prefix shared with the key before) in key order; equal keys in order of runs.

    A run is its keys and, for each, the prefix shared with the run's previous key.
    """
    runs_n = len(runs)
    if not runs_n:
        return
    width = 1
    while width < runs_n:
        width *= 2
    place = [0] * width
    key: list[bytes | None] = [runs[r][0][0] if r < runs_n and runs[r][0] else None for r in range(width)]
    known = [0] * width  # prefix shared with the last key put out

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser learns the prefix it shares with the winner."""
        x, y = key[a], key[b]
        if x is None:
            return b, a
        if y is None:
            return a, b
        ka, kb = known[a], known[b]
        if ka > kb:
            return a, b
        if kb > ka:
            return b, a
        k = common(x, y, ka)
        if k == len(x) and (k < len(y) or a < b):
            first = True
        elif k == len(y):
            first = False
        else:
            first = x[k] < y[k]
        if first:
            known[b] = k
            return a, b
        known[a] = k
        return b, a

    loser = [0] * width
    level = list(range(width))
    at = width
    while len(level) > 1:  # the first round, from the leaves up
        at //= 2
        nxt = []
        for i in range(0, len(level), 2):
            w, lost = play(level[i], level[i + 1])
            loser[at + i // 2] = lost
            nxt.append(w)
        level = nxt
    winner = level[0]
    while key[winner] is not None:
        i = place[winner]
        yield winner, i, known[winner]
        keys, shared = runs[winner]
        i += 1
        place[winner] = i
        if i < len(keys):
            key[winner], known[winner] = keys[i], shared[i]
        else:
            key[winner] = None
        node = (width + winner) // 2
        while node:
            winner, loser[node] = play(winner, loser[node])
            node //= 2
