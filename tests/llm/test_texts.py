"""Operators 2, 4, 6, 7, 10: classifier, tokens, repeated passages, licences."""
import hashlib
import random
import textwrap

import numpy as np
import pyarrow as pa
import pytest

from leadspark.llm import licenses as L
from leadspark.llm import loser_tree as LT
from leadspark.llm import quality as Q
from leadspark.llm import sentencepiece_codec as S
from leadspark.llm import suffix_dedup as X
from leadspark.llm import textbytes as T
from leadspark.llm import token_count as N

from .conftest import ODD

R = random.Random(11)
WORDS = "the of and to in is that for it with one two seven river stone water green letter".split()


def _prose(n):
    return " ".join(R.choice(WORDS) + (R.choice([".", ",", "."]) if R.random() < 0.15 else "") for _ in range(n))


def _junk(n):
    kind = R.randrange(4)
    w = [R.choice(WORDS) for _ in range(n)]
    if kind == 0:
        return " ".join(x + R.choice(["###", "$$$", "%%%"]) for x in w)
    if kind == 1:
        return " ".join(x.upper() + "!!" for x in w)
    if kind == 2:
        return " | ".join(x + str(i) for i, x in enumerate(w))
    return " ".join([w[0]] * (n // 2) + [w[1]] * (n // 2))


# -- byte passes --------------------------------------------------------------

def test_word_table_in_any_blocks(monkeypatch):
    texts = ["the cat  the", None, "", "\n x the", "é" * 50, "a" * 3000 + " the"]
    for limit in (1 << 20, 16):
        found = []
        for b in T.blocks(pa.array(texts), limit):
            w = T.word_table(b)
            found += [(int(r), h) for r, h in zip(b.row[w.piece], w.hash)]
        assert [r for r, h in found if h == T.hash_of("the")] == [0, 0, 3, 5]
        assert {r for r, _ in found} == {0, 3, 4, 5}


def _long_texts():
    r = random.Random(4)

    def word():
        return "".join(r.choice("abcXY12é-,!#") for _ in range(r.choice([1, 2, 3, 5, 9, 40])))
    texts = ["a b", "", "! x", None]
    for _ in range(12):
        sep = r.choice([" ", "\n", "  \n \t\n"])
        texts.append("".join(word() + (r.choice([" ", " ", "\n", sep, "-"])) for _ in range(r.randrange(300))))
    p = " ".join(word() for _ in range(400))
    return texts + [p, p + " " + p, "y" * 1000, "\n\n" * 300 + "z " * 200, "same " * 400, "- " + "é" * 300 + " !"]


def _in_block_sizes(monkeypatch, f):
    out = []
    for size in (1 << 18, 200, 64, 33):
        monkeypatch.setattr(T, "BLOCK", size)
        out.append(f())
    assert all(x == out[0] for x in out[1:])


def test_words_and_windows_are_the_same_in_any_blocks(monkeypatch):
    col = pa.array(_long_texts())
    for fold in (None, L._FOLD):
        _in_block_sizes(monkeypatch, lambda: [
            tuple(map(int, x)) for _, w, _ in T.whole_words(col, fold) for x in zip(w.row, w.size, w.last, w.before, w.hash)])
    for size in (64, 8):
        _in_block_sizes(monkeypatch, lambda: sorted(
            (int(r), w.hash[f:e].tolist()) for w in L.windows(col, size) for f, e, r in zip(w.first, w.last, w.row)))


def test_votes_and_features_are_the_same_in_any_blocks(monkeypatch):
    col = pa.array(_long_texts())

    def votes():
        signals, words = Q._signals(col)
        return {k: v.tolist() for k, v in signals.items()}, words.tolist()

    def shares():
        out = {}
        for row, bucket, share, _ in Q.features(col):
            for k, v in zip(zip(row.tolist(), bucket.tolist()), share.tolist()):
                out[k] = out.get(k, 0) + v
        return {k: round(v, 9) for k, v in out.items()}
    _in_block_sizes(monkeypatch, votes)
    _in_block_sizes(monkeypatch, shares)
    monkeypatch.undo()
    signals, _ = Q._signals(pa.array([" ".join(f"w{i}" for i in range(50000)) + " " + " ".join(f"w{i}" for i in range(50000))]))
    assert signals["variety"][0] == 0.5  # 678 KB


# -- operator 2 ---------------------------------------------------------------

def test_label_model_finds_rates():
    rng = np.random.default_rng(0)
    counts = {}
    for _ in range(4000):
        good = rng.random() < 0.8
        v = "".join("0" if rng.random() < (0.004 if good else 0.5) else "1" for _ in Q.LABELLERS)
        counts[v] = counts.get(v, 0) + 1
    post, rate, share = Q.label_model(counts)
    assert abs(share - 0.8) < 0.03 and np.abs(rate[Q.BAD] - 0.5).max() < 0.08
    assert all(p > 0.99 if "0" not in v else p < 0.01 for v, p in post.items() if v.count("0") not in (1, 2))
    assert Q.label_model({})[0] == {}


def test_classifier_on_held_out_kinds(spark, docs):
    rows = [(i, _prose(R.randrange(30, 300))) for i in range(300)] + [(1000 + i, _junk(80)) for i in range(60)]
    got = {r.doc_id: r.score for r in Q.classify(docs(rows), sample=200).collect()}  # fitted on 200, judged on 360
    wrong = [i for i, s in got.items() if (s >= Q.KEEP_FROM) != (i < 1000)]
    assert len(got) == 360 and not [i for i in wrong if i < 1000] and len(wrong) <= 3


def test_classifier_judges_rows_by_their_own_text(docs):
    prose = [(i, _prose(60)) for i in range(60)]
    bad = "#$%& @@ || " * 60
    rows = [(None, prose[0][1]), (None, bad), (None, None), (7, bad), (None, prose[1][1])]
    d = docs(prose + [(100 + i, bad + str(i)) for i in range(20)] + rows)
    kept = [(r.doc_id, r.text) for r in Q.keep_good(d).collect()]
    assert sum(i is None for i, _ in kept) == 2 and bad not in {t for _, t in kept}
    assert {t for i, t in kept if i is None} == {prose[0][1], prose[1][1]} and (7, prose[7][1]) in kept


def test_classifier_odd_rows(docs, odd, empty):
    got = [(r.doc_id, r.score) for r in Q.classify(odd).collect()]
    assert len(got) == len(ODD) and {s for i, s in got if i in (1, 2, 3)} == {0.0}
    assert Q.classify(empty).count() == 0 and Q.keep_good(empty).count() == 0
    kept = Q.keep_good(docs([(i, _prose(60)) for i in range(50)] + [(60, None), (61, " ")]))
    assert "kept" in kept.columns and {r.doc_id for r in kept.collect()} == set(range(50))


# -- operators 4 and 6 --------------------------------------------------------

TEXTS = [t for _, t in ODD if t] + [
    "a  b\n\n c", "<s>hi</s> <unk> <|endoftext|>x<|startoftext|>", "日本語テキスト 🎉👩‍👩‍👧 مرحبا", "    if x:\n\t\treturn  ====",
    "abcabc" * 300, " ", "\n", "ﬁ①　x", "don't we'll I'M 12,345.67", "e\u0301 \u0301x", _prose(400)]


def test_pieces_equal_library():
    import public_tokenizers
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(S.MODEL))
    letters = "abcdetionhrs  \n.,é"
    more = ["".join(R.choice(letters) for _ in range(R.randint(0, 80))) for _ in range(800)]
    texts = TEXTS + more
    ids, count = S.pieces(S.MODEL).encode(texts)
    assert [g.tolist() for g in np.split(ids, np.cumsum(count)[:-1])] == sp.encode(texts)


def test_unigram_viterbi_equals_brute_force():
    p = S.pieces(S.MODEL)
    u = S.Pieces.__new__(S.Pieces)
    u.__dict__ |= p.__dict__ | {"is_bpe": False}

    def best(word):
        floor, top = float(u.score.min()) - 10, [(0.0, [])]
        ids = {p.text[i]: int(i) for i in p.sorted_id}
        for e in range(1, len(word) + 1):
            own = [(top[e - n][0] + u.score[ids[word[e - n:e]]], n) for n in range(1, min(e, p.max_len) + 1)
                   if word[e - n:e] in ids]
            if word[e - 1] not in ids:
                own.append((top[e - 1][0] + floor, 1))
            top.append((max(s for s, _ in own), None))
        return top[-1][0]
    for w in ["▁hello", "▁theations", "ing", "▁x①y", "aaaaaaa"]:
        last, back = u._best_lengths(np.frombuffer(w.encode("utf-32-le"), np.uint32)[None, :])
        got, at = 0.0, len(w)
        while at:
            got += u.score[last[0, at]] if last[0, at] >= 0 else float(u.score.min()) - 10
            at -= back[0, at]
        assert abs(got - best(w)) < 1e-6


def test_round_trip(odd, empty):
    rows = S.digest(S.decode(S.encode(odd))).collect()
    assert len(rows) == len(ODD) and all(r.round_trip for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2)} == {0}
    assert S.decode(S.encode(empty)).count() == 0 and S.round_trip(empty).count() == 0
    assert sorted(map(repr, S.digest(S.round_trip(odd)).collect())) == sorted(map(repr, rows))


def test_words_at_block_ends_and_marks(monkeypatch):
    import public_tokenizers
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(S.MODEL))
    r = random.Random(8)
    texts = ["".join(r.choices(["▁", " ", "  ", "\n", "\t", "a", "the", "â", "▀", "x" * 60, "é"], k=r.randrange(9)))
             for _ in range(1500)] + ["", "▁", " ▁ a"]
    exp = sp.encode(texts)
    for block in (1 << 20, 50):
        monkeypatch.setattr(S, "BLOCK", block)
        monkeypatch.setattr(S, "REMEMBER", block)
        ids, count = S.pieces(S.MODEL).encode(texts)
        assert [g.tolist() for g in np.split(ids, np.cumsum(count)[:-1])] == exp


def test_token_counts_equal_library(docs, odd, empty):
    t = N.tokenizer(N.MODEL)
    rows = [(i, x) for i, x in enumerate(TEXTS)]
    for chunk, overlap in ((N.CHUNK, N.OVERLAP), (64, 8)):
        got = {r.doc_id: r.n_tokens for r in N.count_tokens(docs(rows), N.MODEL, chunk, overlap).collect()}
        assert got == {i: len(t.encode(x, add_special_tokens=False)) for i, x in rows}
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in N.count_tokens(odd).collect()}
    assert got[1] == got[2] == (0, 0) and got[9][0] == 140000
    assert N.count_tokens(empty).count() == 0


def test_splice_refuses_what_differs():
    text = "ab cd ef gh"
    a = [(0, 1), (3, 2), (6, 3), (9, 4)]
    assert N.splice(a, a, text, 0, 11) in (3, 6)
    assert N.splice(a, [(3, 2), (6, 7), (9, 4)], text, 0, 11) is None
    assert N.splice(a, a, "abcdefghijk", 0, 11) is None


def test_a_tokenizer_that_keeps_white_space_is_refused(tmp_path):
    with pytest.raises(ValueError, match="white space is no boundary"):
        N.tokenizer("byte_bpe_50k.json")
    from tokenizers import AddedToken, Tokenizer
    t = Tokenizer.from_str(N.tokenizer(N.MODEL).to_str())
    assert N.parts_at_white_space(t)
    t.add_special_tokens([AddedToken("<two words>", normalized=False)])
    t.save(str(tmp_path / "spaced.json"))
    with pytest.raises(ValueError, match="white space is no boundary"):
        N.tokenizer(str(tmp_path / "spaced.json"))


# -- operator 7 ---------------------------------------------------------------

def test_loser_tree_merges_and_knows_prefixes():
    r = random.Random(3)
    for _ in range(200):
        runs = [sorted(bytes(r.choice(b"ab") for _ in range(r.randint(0, 6))) for _ in range(r.randint(0, 8)))
                for _ in range(r.randint(0, 6))]
        out = list(LT.merge([(k, [0] + [LT.common(a, b) for a, b in zip(k, k[1:])]) for k in runs]))
        keys = [runs[i][j] for i, j, _ in out]
        assert keys == sorted(sum(runs, []))
        assert [s for *_, s in out][1:] == [LT.common(a, b) for a, b in zip(keys, keys[1:])]


def _removed(rows, size=100):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda x: (x[0] is not None, x[0])):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - size + 1):
            w = b[p:p + size]
            if w in seen:
                gone[p:p + size] = b"\1" * size
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("dense, partitions", [(4096, 8), (1, 8), (4096, 60)])
def test_passages_equal_brute_force(spark, docs, dense, partitions, monkeypatch):
    monkeypatch.setattr(X, "WINDOWS", 500)
    monkeypatch.setattr(X.C, "shuffle_partitions", lambda s: partitions)  # many ranges cut many groups
    r = random.Random(8)

    def noise(n):
        return "".join(r.choice("abcde é") for _ in range(n))
    shared = [noise(r.randrange(60, 400)) for _ in range(4)]
    rows = [(i, noise(r.randrange(150)) + r.choice(shared)[r.randrange(30):] + noise(r.randrange(90)))
            for i in range(60)]
    rows += [(70 + i, "the quick " * r.randint(1, 60) + str(i % 3)) for i in range(15)]
    rows += [(90, "x" * 99), (91, "x" * 100), (92, "x" * 350), (93, shared[0] * 3), (94, rows[0][1]), (95, None), (96, "")]
    got = {x.doc_id: tuple(x)[1:] for x in X.removed_passages(docs(rows), dense_from=dense).collect()}
    assert got == _removed(rows)


def _boilerplate(n):
    r = random.Random(2)

    def noise(k):
        return "".join(r.choice("abcdefgh ") for _ in range(k))
    line, near = noise(70), noise(900)
    rows = [(i, noise(r.randrange(40, 120)) + line + noise(r.randrange(40, 120))) for i in range(n)]
    return rows + [(n + i, near[:i] + noise(9) + near[i:]) for i in range(0, n, 2)] + [(3 * n, "x" * 700), (3 * n + 1, near)]


def test_hot_anchors_are_told_by_their_places_at_any_partition_number():
    rows = _boilerplate(40)
    parts = [pa.table({"part": pa.array([p] * 21, pa.int32()), "text": [t.encode() for _, t in rows[20 * p:20 * p + 21]]})
             for p in (0, 1)]
    hashes = pa.concat_tables([X._hash_rows(1, 100, 40)(t) for t in parts])  # two parts, far fewer than places
    for limit, hot in ((10, True), (4096, False)):
        hits = X._repeated_rows(limit)(hashes).column("hits").to_pylist()
        assert any((np.frombuffer(h, np.uint64) & np.uint64(1)).any() for h in hits) == hot


@pytest.mark.parametrize("dense", [10, 30])
def test_hot_passages_equal_brute_force(docs, dense, monkeypatch):
    monkeypatch.setattr(X.C, "shuffle_partitions", lambda s: 3)
    monkeypatch.setattr(X, "WINDOWS", 2000)
    rows, kinds, sort = _boilerplate(40), [], X._splitters
    monkeypatch.setattr(X, "_splitters", lambda runs, kind, *a: kinds.append(
        (kind, runs.where(f"kind = {kind}").count())) or sort(runs, kind, *a))
    got = {x.doc_id: tuple(x)[1:] for x in X.removed_passages(docs(rows), dense_from=dense).collect()}
    assert got == _removed(rows) and dict(kinds)[X.DENSE] > 0


def test_a_task_holds_a_bounded_number_of_bytes_and_suffixes(docs, monkeypatch):
    monkeypatch.setattr(X.C, "shuffle_partitions", lambda s: 2)
    monkeypatch.setattr(X, "ENTRIES", 50)
    rows, runs, split, hash_rows = _boilerplate(40), [], X._splitters, X._hash_rows
    buckets = []
    monkeypatch.setattr(X, "_hash_rows", lambda n, *a: buckets.append(n) or hash_rows(n, *a))
    monkeypatch.setattr(X, "_splitters", lambda df, kind, *a: runs.append(df) or split(df, kind, *a))
    got = {x.doc_id: tuple(x)[1:] for x in X.removed_passages(docs(rows), dense_from=10, part_bytes=4000).collect()}
    assert got == _removed(rows)
    kept = [X.Run.unpack(bytes(r.run)) for r in runs[0].collect()]
    assert max(len(r.keys) for r in kept) <= 100 and runs[0].select("part").distinct().count() > 4  # 4 = twice the partitions
    assert buckets == [max(2, sum(len(t.encode()) for _, t in rows) // 32000)]


def test_passages_odd_rows(odd, empty):
    got = {x.doc_id: tuple(x)[1:] for x in X.removed_passages(odd).collect()}
    exp = _removed([x for x in ODD if x[0] not in (8, 9)])
    assert {k: got[k] for k in exp} == exp and X.removed_passages(odd).count() == len(ODD)
    assert got[8][0] == 150000 and got[8][1] == 149995 and got[9][1] == 139998
    assert X.removed_passages(empty).count() == 0


# -- operator 10 --------------------------------------------------------------

def test_licences_found_and_others_left(spark, docs):
    rows = [(i, "\n".join(_prose(R.randrange(5, 80)) for _ in range(6))) for i in range(120)]
    planted = {}
    for i in range(0, 60, 3):
        f = R.choice(L.FAMILIES)
        lines = rows[i][1].split("\n")
        notice = R.choice(L.TEMPLATES[f])
        lines.insert(3, notice if i % 2 else _prose(150) + " " + notice + " " + _prose(40))
        rows[i] = (i, "\n".join(lines))
        planted[i] = [f]
    rows += [(200 + i, t) for i, t in enumerate(L.NEAR_MISSES)]
    d = docs(rows)
    got = {r.doc_id: list(r.licenses) for r in L.scan(d, L.train(d)).collect()}
    assert got == {i: planted.get(i, []) for i, _ in rows}


def test_licences_odd_rows(odd, empty):
    got = L.scan(odd, L.train(odd)).collect()
    assert len(got) == len(ODD) and not any(r.licenses for r in got)
    assert {r.n_windows for r in got if r.doc_id in (1, 2, 3)} == {0}
    assert L.scan(empty, L.train(empty)).count() == 0


def _licences(docs, texts):
    d = docs([(1000 + i, "\n\n".join(_prose(R.randrange(5, 80)) for _ in range(4))) for i in range(60)]
             + list(enumerate(texts)))
    got = {r.doc_id: list(r.licenses) for r in L.scan(d, L.train(d)).collect()}
    assert not any(f for i, f in got.items() if i >= 1000)
    return [got[i] for i in range(len(texts))]


def test_licences_in_wrapped_lines(docs):
    families, texts = [], []
    for f in L.FAMILIES:
        for notice in L.TEMPLATES[f]:
            for k, mark in enumerate(("", "# ", " * ", "// ")):
                lines = textwrap.wrap(notice, (72, 40, 30, 25)[k])
                texts.append("\r\n".join([mark + x for x in [_prose(12), "", *lines, "", _prose(9)]])
                             if k else "\n".join([_prose(60), "", *lines, " \t", _prose(20)]))
                families.append([f])
    assert _licences(docs, texts) == families


def test_paragraphs_end_at_blank_lines():
    def sizes(text):
        return [int(n) for w in L.windows(pa.array([text])) for n in w.last - w.first]
    assert sizes("a b\nc\n\nd\n \t\r\ne f\n# \ng\n\n\n") == [3, 1, 3]


def test_licence_across_the_cut_of_a_long_text(docs, monkeypatch):
    f, g = L.FAMILIES[2], L.FAMILIES[11]
    texts = []
    for k in range(-20, 21, 8):  # the notice lies about the cut
        head = "river " * ((T.BLOCK - 100) // 6 + k)
        texts += [head + L.TEMPLATES[f][-1] + " " + "stone " * 40, head + L.TEMPLATES[g][-1].replace(" ", "\n") + " green"]
    assert _licences(docs, texts) == [[f], [g]] * (len(texts) // 2)


def test_two_licences_in_one_line(docs):
    notices = [(f, t) for f in L.FAMILIES for t in (L.TEMPLATES[f][0], L.TEMPLATES[f][-1])]
    texts = ["Licensed under the MIT License. Licensed under CC BY 4.0."]
    families = [["CC-BY", "MIT"]]
    for f, a in notices:
        for g, b in notices:
            if f != g:
                texts.append(a + " " + _prose(R.randrange(3)) + " " + b)
                families.append(sorted([f, g]))
    assert _licences(docs, texts) == families


#: Notices worded otherwise than any of the operator's own, and the family that they put a text under.
PARAPHRASES = [
    ("MIT", "The source code is licensed under the terms of the MIT license"),
    ("MIT", "This software is released under an MIT License, see the file beside it"),
    ("MIT", "// SPDX-License-Identifier: MIT"),
    ("MIT", "All examples are made available under the MIT License"),
    ("MIT", "Permission is hereby granted, without charge, to any person obtaining a copy of the software and "
            "associated documentation files"),
    ("Apache", "This project is distributed under the Apache License"),
    ("Apache", "The library is made available under the terms of the Apache 2.0 license"),
    ("Apache", "You may not use these files except in compliance with the License. You may obtain a copy of this "
               "License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD", "Distributed under the BSD license"),
    ("BSD", "Code released under the BSD 3-Clause terms"),
    ("BSD", "Redistribution and use in source or binary form, with or without modification, are permitted provided "
            "that the following conditions are met"),
    ("CC-BY", "This work is licensed under a Creative Commons Attribution 3.0 Unported License"),
    ("CC-BY-SA", "Text is available under the terms of a Creative Commons Attribution-ShareAlike 3.0 licence"),
    ("CC-BY-NC", "The pictures are licensed under the CC BY-NC 2.0 terms"),
    ("CC0", "The data set is released under the CC0 1.0 dedication"),
    ("EPL", "All content is made available under the terms of the Eclipse Public License Version 1.0"),
    ("GPL", "The program is distributed under the terms of the GNU General Public License as it stands"),
    ("GPL", "The tools are licensed under the GNU GPL, version 2 or later"),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
             "Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the "
             "License, or (at your option) any later version."),
    ("AGPL", "The server is released under the GNU Affero General Public License v3"),
    ("MPL", "Files are subject to the terms of the Mozilla Public License"),
    ("ISC", "Permission to use, copy, modify, and distribute this software for any purpose with or without a fee is "
            "hereby granted"),
    ("Unlicense", "All of it is released under the Unlicense"),
]
#: Sentences that speak of licences and put nothing under one.
TALK = [
    "The MIT License is short.", "Apache License and BSD License were compared in the talk.",
    "Many projects moved away from the GNU General Public License last year.",
    "He read the Mozilla Public License twice and put it down.", "The pub was licensed under the old act.",
    "Creative Commons Attribution was a theme of the meeting.", "This work is licensed under the Harbour Fisheries Act.",
    "Permission is hereby granted to the tenant to keep a dog.", "Redistribution of land was permitted by the council.",
    "Available under the counter of the shop.", "Released under a bright moon, the birds flew to the BSD server.",
    "The Eclipse Public License differs from others in its patent clause.",
    "Subject to the terms of the contract, the public may use the hall.", "The Apache people signed a treaty.",
]


def test_licences_of_paraphrases_and_talk(docs):
    got = _licences(docs, [t for _, t in PARAPHRASES] + TALK)
    hit = sum(g == [f] for g, (f, _) in zip(got, PARAPHRASES))
    alarms = sum(bool(g) for g in got[len(PARAPHRASES):])
    assert hit >= 0.9 * len(PARAPHRASES), [(g, p) for g, p in zip(got, PARAPHRASES) if g != [p[0]]]
    assert alarms <= 0.1 * len(TALK), [(g, t) for g, t in zip(got[len(PARAPHRASES):], TALK) if g]


def test_licence_families_are_the_classifiers(docs):
    """With its family columns moved on by one, the classifier predicts other families, and none is confirmed."""
    d = docs([(i, L.TEMPLATES[f][0]) for i, f in enumerate(L.FAMILIES)])
    model = L.train(d)
    turn = np.append(np.roll(np.arange(L.UNKNOWN), 1), L.UNKNOWN)
    turned = model._replace(weights=model.weights[:, turn], intercept=model.intercept[turn])
    assert {r.doc_id: list(r.licenses) for r in L.scan(d, model).collect()} == {
        i: [f] for i, f in enumerate(L.FAMILIES)}
    right = [r.doc_id for r in L.scan(d, turned).collect() if L.FAMILIES[r.doc_id] in r.licenses]
    assert len(right) <= len(L.FAMILIES) // 4


def test_licence_notices_align_with_a_fifth_of_edits():
    mit = L.notices()[L.FAMILIES.index("MIT")]

    def span(text):
        return L.confirmed(L._word_hashes(text), mit)
    assert span("so it is licensed under the MIT License of old") == (3, 8)
    assert span("licensed under MIT License") == (0, 4)  # one word of five is missing
    assert span("they spoke at length of the MIT License") is None
    assert span("licensed under the ISC License") is None  # the name must stand as it is
    assert span("") is None and span("MIT") is None
