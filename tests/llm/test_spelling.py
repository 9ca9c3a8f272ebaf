"""Operator 11: spelling variants against brute force."""
import random
import re
import zlib
from collections import Counter

import pandas as pd

from leadspark.llm import catalog
from leadspark.llm import common as C
from leadspark.llm import spelling as S

from .conftest import ODD

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans(C.UPPER, C.UPPER.lower())


def _counts(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def _near(words):
    out, by = {w: set() for w in words}, {}
    for w in words:
        for i in range(len(w)):
            by.setdefault((i, w[:i] + w[i + 1:]), set()).add(w)
            if w[:i] + w[i + 1:] in words:
                out[w].add(w[:i] + w[i + 1:])
                out[w[:i] + w[i + 1:]].add(w)
    for same in by.values():
        for w in same:
            out[w] |= same - {w}
    return out


def _variants(counts, ratio=10):
    near, forms = _near(set(counts)), {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        forms[w] = best if best is not None and counts[best] >= ratio * n else None
    out = set()
    for w, n in counts.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        out.add((w, forms[w], root, n, len(near[w]), counts[forms[w]] if forms[w] else None))
    return out


def _rows(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def _vocabulary(seed, letters, sizes, n):
    r = random.Random(seed)
    words = {"".join(r.choices(letters, k=r.choice(sizes))) for _ in range(n)}
    for w in sorted(words):
        w = list(w)
        for _ in range(3):
            i = r.randrange(len(w))
            edit = r.randrange(3)
            w[i:i + (edit != 0)] = r.choice(letters) if edit != 2 else ""
            if len(w) >= 7:
                words.add("".join(w))
    return {w: int(10 ** r.uniform(0.4, 5)) for w in words if len(w) >= 7}


def test_variants_equal_brute_force(spark):
    for seed, letters, sizes, n, levels in ((2, "abcé÷À", [7, 8, 9], 150, 32), (3, "ab", [7, 9, 10, 11, 14], 80, 9)):
        counts = _vocabulary(seed, letters, sizes, n)
        df = spark.createDataFrame(sorted(counts.items()), "word string, n long")
        got = S.variants(df, levels=levels).collect()
        assert len(got) == len(counts)
        assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == _variants(counts), seed


def test_words_of_any_length(spark):
    w = "xy" * 5000
    words = [w, w[:-1], w[:4000] + "z" + w[4001:], w[:4000] + "zz" + w[4002:], "x" * 8, "x" * 9, "x" * 10, "a short"]
    df = spark.createDataFrame([(x,) for x in words], "word string")
    got = {(r.word, r.near) for r in S.near_pairs(df, levels=8).collect()}
    exp = _near(set(words))
    assert got == {(a, b) for a, near in exp.items() for b in near} and len(got) >= 8


def test_counts_on_odd_rows(docs, odd, empty):
    rows = ODD + [(11, "Variants VARIANTS variants' naïveté naïveté"), (11, "variants"), (None, "variants"),
                  *[(i, "wordwordword Étranger×÷ étrangers") for i in range(100, 200)]]
    got = {r.word: r.n for r in S.word_counts(docs(rows)).collect()}
    assert got == _counts(rows)
    assert {r.word: r.n for r in S.word_counts(odd).collect()} == _counts(ODD)
    assert S.word_counts(empty).count() == 0 and S.variants(S.word_counts(empty)).count() == 0


def test_prefix_of_a_third_of_all_words(spark):
    r = random.Random(9)
    counts = {"content" + "".join(r.choices("abcdefgh", k=4)): 5 for _ in range(400)} | _vocabulary(5, "abcdefgh", [8], 200)
    df = spark.createDataFrame(sorted(counts.items()), "word string, n long")
    assert _rows(S.variants(df)) == _variants(counts)


def test_query_equals_brute_force(spark):
    table = pd.read_parquet(f"{SF}/documents.parquet")
    counts = _counts(zip(table.doc_id, table.text))
    got = catalog.QUERIES["op11_spelling_variants"](spark, SF).collect()
    assert len(got) == len(counts)
    assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == _variants(counts)
