"""Licence scan by a trained paragraph classifier.

A paragraph is a run of lines between blank ones, so a notice may be wrapped or
stand behind comment marks; one of more than ``WINDOW`` words is read in
windows that overlap by half, so a notice inside it is seen whole.  Its
features are the 1- to 3-grams of its words (A-Z lower-cased, cut at anything
but letters and digits) that occur in the templates: a sparse vocabulary of a
few thousand.  A multinomial logistic regression over the licence families and
the class ``unknown`` is fitted to template notices in random surroundings,
and to paragraphs of the corpus and reshuffled notices as ``unknown``.  Its
probabilities are calibrated on held-out examples: a temperature by least
log-loss, then for every family the least probability of it against unknown at
which at most ``FALSE_ALARM`` of the held-out unknown ones pass.

The classifier predicts the families of a window: those at their least
probability, the most probable first.  A prediction is confirmed by the
templates of that family alone: one of them must align with words of the
window in order with at most a fifth of its words inserted, deleted or
replaced (``SIMILAR``), and the family's name, where the template has it, must
stand there as it is (so the GPL's header is not the AGPL's).  The words of a
confirmed notice are blanked and the window is scored again, so it shows as
many families as it has notices; it is done when no prediction is confirmed.

The fit uses at most ``SAMPLE_DOCS`` documents (smallest hash of the id) and
``PER_DOC`` windows of each; the scan reads all paragraphs of all documents.

Defined results: a null or empty text has no paragraphs and no licence; a
document's families are listed once each, in order of name; repeated rows get
equal results; a very long text is read in blocks, with the same windows as in
one; rows without an id are read like others (only the fit leaves them out);
other columns are ignored, whatever their names; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadspark.llm import common as C
from leadspark.llm import textbytes as T

WINDOW = 64
SAMPLE_DOCS = 512
PER_DOC = 8
#: Notices of each family that the fit draws, besides its shuffled ones.
COPIES = 160
FALSE_ALARM = 0.001
SIMILAR = 0.8
SEED = 7

# fixed values: licence families and notices by which works are put under them
TEMPLATES = {
    "AGPL": ["Licensed under the GNU Affero General Public License, version 3.",
             "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
             "Affero General Public License as published by the Free Software Foundation"],
    "Apache": ["Licensed under the Apache License, Version 2.0.",
               "This work is licensed under the Apache License, Version 2.0.",
               "Released under the Apache License 2.0.",
               "you may not use this file except in compliance with the License. You may obtain a copy of the License "
               "at http://www.apache.org/licenses/LICENSE-2.0"],
    "BSD": ["Released under the BSD License.", "Licensed under the BSD 3-Clause License.",
            "Licensed under the BSD 2-Clause License.",
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met"],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 "
              "International License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0.",
                 "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International "
                 "License."],
    "CC-BY-ND": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons "
                 "Attribution-NoDerivatives 4.0 International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons "
                 "Attribution-ShareAlike 4.0 International License."],
    "CC0": ["Released under CC0 1.0 Universal.", "Dedicated to the public domain under CC0 1.0."],
    "EPL": ["Licensed under the Eclipse Public License, version 2.0.",
            "This program and the accompanying materials are made available under the terms of the Eclipse Public "
            "License 2.0"],
    "GPL": ["This work is licensed under the GNU General Public License, version 3.",
            "Licensed under the GNU General Public License, version 2.",
            "Released under the GNU General Public License.",
            "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
            "General Public License as published by the Free Software Foundation"],
    "ISC": ["Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for "
            "any purpose with or without fee is hereby granted"],
    "LGPL": ["Licensed under the GNU Lesser General Public License, version 2.1.",
             "Released under the GNU Lesser General Public License, version 3."],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.",
            "This work is licensed under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files"],
    "MPL": ["Licensed under the Mozilla Public License, version 2.0.",
            "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain.",
                  "Released under the Unlicense."],
}
# fixed values: how a notice begins, and the names and identifiers of the families
LEADS = ["Licensed under", "This work is licensed under", "Released under", "Distributed under",
         "Available under the terms of", "Licensed under the terms of", "You may use it under",
         "Subject to the terms of", "Covered by"]
NAMES = {
    "AGPL": ["GNU Affero General Public License", "GNU AGPL"],
    "Apache": ["Apache License", "Apache 2.0", "Apache Software License"],
    "BSD": ["BSD License", "BSD 2-Clause", "BSD 3-Clause"],
    "CC0": ["CC0 1.0", "Creative Commons Zero"],
    "EPL": ["Eclipse Public License"],
    "GPL": ["GNU General Public License", "GNU GPL"],
    "ISC": ["ISC License"],
    "LGPL": ["GNU Lesser General Public License", "GNU Library General Public License", "GNU LGPL"],
    "MIT": ["MIT License"],
    "MPL": ["Mozilla Public License"],
    "Unlicense": ["Unlicense"],
}
IDENTIFIERS = {"AGPL": ["AGPL-3.0"], "Apache": ["Apache-2.0"], "BSD": ["BSD-2-Clause", "BSD-3-Clause"],
               "CC0": ["CC0-1.0"], "EPL": ["EPL-1.0", "EPL-2.0"], "GPL": ["GPL-2.0", "GPL-3.0"], "ISC": ["ISC"],
               "LGPL": ["LGPL-2.1", "LGPL-3.0"], "MIT": ["MIT"], "MPL": ["MPL-2.0"], "Unlicense": ["Unlicense"]}
CC_TERMS = {"CC-BY": "", "CC-BY-NC": "-NonCommercial", "CC-BY-ND": "-NoDerivatives", "CC-BY-SA": "-ShareAlike"}
CC_VERSIONS = ["1.0", "2.0", "2.5", "3.0", "4.0"]
# fixed values: sentences about licences that put nothing under one
NEAR_MISSES = ["The driver showed a license at the border.", "A public license is required to sell food here.",
               "The general terms of the license were discussed in version 2 of the report.",
               "They met at the MIT to talk about the free software movement.",
               "The apache helicopter was released from service under the new law.",
               "Permission to use the hall is granted to any person without charge."]
FAMILIES = sorted(TEMPLATES)
UNKNOWN = len(FAMILIES)

_FOLD = np.full(256, 32, np.uint8)
_FOLD[48:58] = np.arange(48, 58)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_N2, _N3, _N5 = (np.uint64(x) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


def _grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams of a sequence of word hashes."""
    out = h[:max(0, len(h) - n + 1)].copy()
    for k in range(1, n):
        out = T.mix(out * _N2 + h[k:len(h) - n + 1 + k] + _N3)
    return out + np.uint64(n) * _N5


def _word_hashes(text: str) -> np.ndarray:
    buf = _FOLD[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    return T.word_table(T.Block(buf, np.zeros(1, np.int64), np.array([len(buf)]), np.zeros(1, np.int64))).hash


class Windows(NamedTuple):
    hash: np.ndarray   # of every word of a block, after the words carried over
    first: np.ndarray  # windows: first word, word after the last
    last: np.ndarray
    row: np.ndarray    # and the text


def _blank_lines(buf: np.ndarray, blank_so_far: bool) -> tuple[np.ndarray, bool]:
    """For each byte, how many lines of nothing but white space end before it or at it; whether the last line is such."""
    feed = np.flatnonzero(buf == 10)
    solid = np.cumsum(~T.IS_SPACE[buf])
    at = np.concatenate(([0 if blank_so_far else -1], solid[feed]))
    blank = np.zeros(len(buf), np.int64)
    blank[feed[at[1:] == at[:-1]]] = 1
    return np.cumsum(blank), bool(at[-1] == solid[-1])


def windows(col: pa.Array, size: int = WINDOW) -> Iterator[Windows]:
    """Windows of the paragraphs of a column's texts, block by block, the same for any block size.

    Of a paragraph that goes on in the next block, the words from the first
    window that is not yet full are carried over.
    """
    half = size // 2
    held, held_par, begun = np.zeros(0, np.uint64), 0, False  # the paragraph that goes on
    par, blank = 0, False                                     # blank lines of the text that goes on
    for b, w, more in T.whole_words(col, _FOLD):
        if not len(b.buf):
            continue
        lines, blank = _blank_lines(b.buf, blank)
        lines += par
        hashes = np.concatenate((held, w.hash))
        row = np.concatenate((np.full(len(held), b.row[0]), w.row))
        at = np.concatenate((np.full(len(held), held_par), lines[w.start]))
        par, blank = (int(lines[-1]), blank) if more else (0, False)
        if not len(hashes):
            continue
        new = np.ones(len(hashes), bool)  # words of one paragraph of one text stand together
        new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(new))
        count = np.maximum(1, -(-(last - first - half) // half))
        if begun:
            count[0] = max(0, -(-(last[0] - half) // half))
        held, begun = np.zeros(0, np.uint64), begun and len(first) == 1
        if more:
            count[-1] = max(0, (last[-1] - first[-1] - size) // half + 1)
            begun = begun or bool(count[-1])
            held, held_par = hashes[first[-1] + count[-1] * half:].copy(), at[-1]
        else:
            begun = False
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        start = np.repeat(first, count) + step * half
        if len(start):
            yield Windows(hashes, start, np.minimum(start + size, np.repeat(last, count)), row[start])


class Model(NamedTuple):
    vocabulary: np.ndarray  # sorted n-gram hashes
    weights: np.ndarray     # a row per n-gram, a column per class
    intercept: np.ndarray
    temperature: float
    least: np.ndarray       # of each family, the probability against unknown from which it is predicted


class Notice(NamedTuple):
    lead: np.ndarray  # word hashes before the name (all of a notice that has no name)
    name: np.ndarray
    tail: np.ndarray


def _names(family: str) -> list[tuple[str, list[str]]]:
    """(name, notices made of it by rule) of each name of a family."""
    out = [(n, [f"{lead} the {n}" for lead in LEADS]) for n in NAMES.get(family, [])]
    if family in CC_TERMS:
        for v in CC_VERSIONS:
            long, short = f"Creative Commons Attribution{CC_TERMS[family]} {v}", family.replace("-", " ", 1) + f" {v}"
            out += [(long, [f"{lead} a {long}" for lead in LEADS]), (short, [f"{lead} {short}" for lead in LEADS]),
                    (f"{family}-{v}", [f"SPDX-License-Identifier: {family}-{v}"])]
    return out + [(n, [f"SPDX-License-Identifier: {n}"]) for n in IDENTIFIERS.get(family, [])]


def _places(h: np.ndarray, name: np.ndarray) -> list[int]:
    """Where the words of a name stand."""
    at = np.flatnonzero(h[:max(0, len(h) - len(name) + 1)] == name[0])
    return [i for i in at.tolist() if np.array_equal(h[i:i + len(name)], name)]


@lru_cache(maxsize=1)
def notices() -> list[list[Notice]]:
    """Notices of each family, those in TEMPLATES first, parted at the longest name that they hold."""
    out = []
    for f in FAMILIES:
        named = _names(f)
        names = sorted((_word_hashes(n) for n, _ in named), key=len, reverse=True)
        own = [_word_hashes(t) for t in TEMPLATES[f] + [t for _, ts in named for t in ts]]
        parted = []
        for h in own:
            at = next(((p, n) for n in names for p in _places(h, n)), (len(h), h[:0]))
            parted.append(Notice(h[:at[0]], at[1], h[at[0] + len(at[1]):]))
        out.append(parted)
    return out


def _nearest(pattern: np.ndarray, words: np.ndarray) -> tuple[int, int]:
    """(edits, length) of the start of ``words`` that is nearest to the pattern."""
    n = len(pattern)
    words = words[:2 * n]  # a longer start takes more edits than dropping the pattern
    if np.array_equal(words[:n], pattern):
        return 0, n
    j = np.arange(len(words) + 1)
    d = _edits(pattern, words, j)
    return int(d.min()), int(d.argmin())


def _edits(pattern: np.ndarray, words: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Least edits of the pattern against words that end at each place; ``d`` is the cost to begin at a place."""
    j = np.arange(len(words) + 1)
    for x in pattern:
        t = d + 1
        t[1:] = np.minimum(d[:-1] + (words != x), t[1:])
        d = np.minimum.accumulate(t - j) + j
    return d


def confirmed(h: np.ndarray, family: list[Notice], similar: float = SIMILAR) -> tuple[int, int] | None:
    """The words [from, to) that agree best with a notice of the family (of equals, the longest), or None."""
    best, places = (similar - 1e-9, 0, None), {}
    for t in family:
        n = len(t.lead) + len(t.name) + len(t.tail)
        if not len(t.name):
            if 1 - np.count_nonzero(~np.isin(t.lead, h)) / n < best[0]:
                continue
            d = _edits(t.lead, h, np.zeros(len(h) + 1, np.int64))
            end = int(d.argmin())
            found_at = [(int(d[end]), end - _nearest(t.lead[::-1], h[:end][::-1])[1], end)]
        else:
            key = t.name.tobytes()
            if key not in places:
                places[key] = _places(h, t.name)
            found_at = []
            for p in places[key]:
                q = p + len(t.name)
                before, after = _nearest(t.lead[::-1], h[:p][::-1]), _nearest(t.tail, h[q:])
                found_at.append((before[0] + after[0], p - before[1], q + after[1]))
        for edits, lo, hi in found_at:
            best = max(best, (1 - edits / n, hi - lo, (lo, hi)), key=lambda x: x[:2])
    return best[2]


def _any_confirmed(h: np.ndarray) -> bool:
    return any(confirmed(h, family) for family in notices())


def template_vocabulary() -> np.ndarray:
    h = [np.concatenate(t) for family in notices() for t in family]
    return np.unique(np.concatenate([_grams(x, n) for x in h for n in (1, 2, 3)]))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _against_unknown(z: np.ndarray) -> np.ndarray:
    """Probability of each family against unknown."""
    return 1 / (1 + np.exp(np.clip(z[:, UNKNOWN:] - z[:, :UNKNOWN], -50, 50)))


def _presence(samples: list[np.ndarray], vocabulary: np.ndarray) -> np.ndarray:
    x = np.zeros((len(samples), len(vocabulary)), np.float32)
    for i, h in enumerate(samples):
        g = np.concatenate([_grams(h, n) for n in (1, 2, 3)])
        at = np.searchsorted(vocabulary, g).clip(max=len(vocabulary) - 1)
        x[i, at[vocabulary[at] == g]] = 1
    return x


def fit(background: list[np.ndarray], copies: int = COPIES, rounds: int = 250) -> Model:
    """Classifier of windows; ``background`` has word hashes of paragraphs of the corpus."""
    rng = np.random.default_rng(SEED)
    vocabulary = template_vocabulary()
    noise = [h for h in background if len(h) and not _any_confirmed(h)]
    pool = np.concatenate(noise) if noise else np.arange(1, 512, dtype=np.uint64) * _N2

    def around(h: np.ndarray) -> np.ndarray:
        a, b = rng.integers(0, max(1, WINDOW - len(h)) // 2 + 1, 2)
        return np.concatenate((rng.choice(pool, a), h, rng.choice(pool, b)))[:WINDOW]

    def worn(words: np.ndarray) -> np.ndarray:
        return words[rng.random(len(words)) > 0.1]
    samples, labels = [], []
    for k, f in enumerate(FAMILIES):
        own = notices()[k]
        for c in range(copies):  # half of them from the whole notices, half from those by rule
            t = own[rng.integers(len(TEMPLATES[f]) if c % 2 else len(own))]
            h = np.concatenate((worn(t.lead), t.name, worn(t.tail)) if c % 4 > 1 else t)
            samples.append(around(h) if c % 8 else h)
            labels.append(k)
            mixed = rng.permutation(np.concatenate(t))  # the words without their order
            if not _any_confirmed(mixed):
                samples.append(around(mixed))
                labels.append(UNKNOWN)
    for h in [*noise, *map(_word_hashes, NEAR_MISSES * (copies // 8))]:
        samples.append(h[:WINDOW])
        labels.append(UNKNOWN)
    x, y = _presence(samples, vocabulary), np.array(labels)
    held = np.zeros(len(y), bool)
    held[rng.permutation(len(y))[:len(y) // 5]] = True

    target = np.eye(UNKNOWN + 1, dtype=np.float32)[y[~held]]
    xt, n = x[~held], np.float32((~held).sum())
    w, b = np.zeros((x.shape[1], UNKNOWN + 1), np.float32), np.zeros(UNKNOWN + 1, np.float32)
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)]
    for t in range(1, rounds + 1):
        err = (_softmax(xt @ w + b) - target) / n
        for p, g, i in ((w, xt.T @ err + np.float32(1e-4) * w, 0), (b, err.sum(axis=0), 2)):
            state[i] = 0.9 * state[i] + 0.1 * g
            state[i + 1] = 0.99 * state[i + 1] + 0.01 * g * g
            p -= 0.1 * (state[i] / (1 - 0.9 ** t)) / (np.sqrt(state[i + 1] / (1 - 0.99 ** t)) + 1e-8)
    z = x[held] @ w + b
    yh = y[held]
    heat = min(np.geomspace(0.25, 8, 40), key=lambda s: -np.log(
        _softmax(z / s)[np.arange(len(yh)), yh] + 1e-12).mean())
    alarms = np.sort(_against_unknown(z[yh == UNKNOWN] / heat), axis=0)
    at = max(0, int(np.ceil(len(alarms) * (1 - FALSE_ALARM))) - 1)
    least = alarms[at] if len(alarms) else np.full(UNKNOWN, 0.5)
    return Model(vocabulary, w, b, float(heat), np.clip(least, 0.5, 0.99))


def _background(docs: DataFrame) -> list[np.ndarray]:
    """Word hashes of at most SAMPLE_DOCS * PER_DOC windows of the corpus."""
    picked = (docs.where("doc_id is not null").select("doc_id").distinct()
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS))

    def run(batches):
        for b in batches:
            ids, got = b.column(0).to_pylist(), [[] for _ in range(len(b))]
            for ws in windows(b.column(1)):
                for f, e, r in zip(ws.first.tolist(), ws.last.tolist(), ws.row.tolist()):
                    if len(got[r]) < PER_DOC:
                        got[r].append(ws.hash[f:e].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([[g.tolist() for g in x] for x in got],
                                                     pa.list_(pa.list_(pa.int64())))], ["doc_id", "words"])
    rows = _texts(docs).join(F.broadcast(picked), "doc_id").mapInArrow(run, "doc_id long, words array<array<long>>")
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("words")).limit(SAMPLE_DOCS).collect()
    return [np.array(w, np.int64).view(np.uint64) for r in rows for w in r["words"]]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def train(docs: DataFrame) -> Model:
    return fit(_background(docs))


def _scores(ws: Windows, m: Model) -> np.ndarray:
    """Probability of each family against unknown of each window; 0 if it has no n-gram of the templates."""
    # n-grams of the vocabulary: place of the first word, entry
    place, entry, width = [], [], []
    for k in (1, 2, 3):
        g = _grams(ws.hash, k)
        at = np.searchsorted(m.vocabulary, g).clip(max=len(m.vocabulary) - 1)
        hit = np.flatnonzero(m.vocabulary[at] == g)
        place.append(hit), entry.append(at[hit]), width.append(np.full(len(hit), k))
    place, entry, width = np.concatenate(place), np.concatenate(entry), np.concatenate(width)
    order = np.argsort(place, kind="stable")
    place, entry, width = place[order], entry[order], width[order]
    lo, hi = np.searchsorted(place, ws.first), np.searchsorted(place, ws.last)
    count = hi - lo
    win = np.repeat(np.arange(len(count)), count)
    idx = np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    inside = place[idx] + width[idx] <= ws.last[win]
    key = np.unique(win[inside] * len(m.vocabulary) + entry[idx[inside]])  # presence, not number
    win, ent = key // len(m.vocabulary), key % len(m.vocabulary)
    prob = np.zeros((len(count), UNKNOWN), np.float32)
    seen, start = np.unique(win, return_index=True)
    for a in range(0, len(seen), 4096):  # a bounded number of windows at a time
        some = seen[a:a + 4096]
        i, j = start[a], start[a + 4096] if a + 4096 < len(start) else len(win)
        z = np.add.reduceat(m.weights[ent[i:j]], start[a:a + 4096] - i, axis=0) + m.intercept
        prob[some] = _against_unknown(z / m.temperature)
    return prob


def shown(h: np.ndarray, prob: np.ndarray, m: Model) -> set[int]:
    """Families of a window: predicted by the classifier, confirmed by their own notices, one notice after another."""
    h, out = h.copy(), set()
    while True:
        predicted = np.flatnonzero(prob >= m.least)
        for k in predicted[np.argsort(-prob[predicted], kind="stable")].tolist():
            span = confirmed(h, notices()[k])
            if span:
                break
        else:
            return out
        out.add(k)
        h[span[0]:span[1]] = 0  # no word of any notice
        prob = _scores(Windows(h, np.array([0]), np.array([len(h)]), np.array([0])), m)[0]


def found(ws: Windows, m: Model) -> Iterator[tuple[int, int]]:
    """(window, family) of each family that a window shows."""
    prob = _scores(ws, m)
    for i in np.flatnonzero((prob >= m.least).any(axis=1)).tolist():
        for k in shown(ws.hash[ws.first[i]:ws.last[i]], prob[i], m):
            yield i, k


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_windows, licenses): the number of windows, and the families that any of them shows."""
    m = docs.sparkSession.sparkContext.broadcast(tuple(model))  # as large as the templates' vocabulary

    def run(batches):
        model = Model(*m.value)
        for b in batches:
            count, names = np.zeros(len(b), np.int64), [set() for _ in range(len(b))]
            for ws in windows(b.column(1)):
                count += np.bincount(ws.row, minlength=len(b))
                for i, k in found(ws, model):
                    names[ws.row[i]].add(FAMILIES[k])
            names = [sorted(x) for x in names]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(count), pa.array(names, pa.list_(pa.string()))],
                ["doc_id", "n_windows", "licenses"])
    return _texts(docs).mapInArrow(run, "doc_id long, n_windows long, licenses array<string>")


# -- query --------------------------------------------------------------------

def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the licence families that its paragraphs put it under."""
    docs = C.read(spark, sf_dir, "documents")
    out = scan(docs, train(docs))
    return out.select("doc_id", "n_windows", "licenses", (F.size("licenses") > 0).alias("licensed"))
