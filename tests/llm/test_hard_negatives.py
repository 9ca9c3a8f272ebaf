"""Operator 12: hard negatives against brute force."""
import math
import random

import numpy as np
import pytest

from leadspark.llm import hard_negatives as H

SCHEMA = "vec_id long, label int, embedding array<float>, v string, range int, score int"


def _whole(rows):
    good = {(i, y, tuple(math.floor(256 * float(np.float32(x))) for x in e)) for i, y, e in rows
            if i is not None and y is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)}
    return [r for r in good if sum(x * x for x in r[2]) <= 1 << 60]


def _mined(rows, anchors, positives=5, negatives=10):
    out = []
    for i, y, v in anchors:
        scored = [(-sum(a * b for a, b in zip(v, w)), j, z) for j, z, w in rows if j != i]
        first = sorted((s, j) for s, j, z in scored if z == y)[:positives]
        for s, p in first:
            near = sorted((t, j) for t, j, z in scored if z != y and 30 * -s <= 100 * -t <= 90 * -s)
            out += [(i, p, k + 1, j, -s, -t) for k, (t, j) in enumerate(near[:negatives])]
    return sorted(out)


def _check(spark, rows, **ways):
    df = spark.createDataFrame([(i, y, e, "x", 1, 2) for i, y, e in rows], SCHEMA)
    own = H.vectors(df)
    got = sorted(tuple(r) for r in H.mine(own, own.where("vec_id % 5 = 0"), **ways).collect())
    whole = _whole(rows)
    exp = _mined(whole, [r for r in whole if r[0] % 5 == 0], **ways)
    assert got == exp
    return got


def _vectors(seed, n, d, labels, spread=1.0):
    r = random.Random(seed)
    base = [[r.gauss(0, 1) for _ in range(d)] for _ in range(6)]
    return [(i, r.randrange(labels), [x + spread * r.gauss(0, 1) for x in r.choice(base)]) for i in range(n)]


def test_mined_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(H, "ROWS", 16)
    monkeypatch.setattr(H, "ANCHORS", 4)
    assert _check(spark, _vectors(1, 150, 12, 3))
    assert _check(spark, _vectors(2, 120, 8, 2, 0.05))


def test_blocks_and_ranges(spark, monkeypatch):
    monkeypatch.setattr(H, "RANGE", 20)
    monkeypatch.setattr(H, "BLOCK", 6)
    monkeypatch.setattr(H, "RANGES", 2)
    assert _check(spark, _vectors(3, 110, 10, 3), positives=3, negatives=4)


def test_one_vector_in_a_third_of_the_rows(spark, monkeypatch):
    monkeypatch.setattr(H, "RANGES", 3)
    same = [0.4, 0.3, -0.2, 0.1]
    rows = [(i, i % 2, same if i % 3 == 0 else e) for i, _, e in _vectors(4, 120, 4, 2)]
    rows += [(i + 1000, 5, [0.8 * x for x in same]) for i in range(40)]  # ties
    assert _check(spark, rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [0.5, 0.5]), (1, 1, [0.5, 0.25]), (2, None, [0.5, 0.5]), (3, 2, None), (4, 2, [0.5, None]),
            (6, 2, [nan, 0.5]), (7, 2, [0.5, -inf]), (None, 2, [0.2, 0.2]), (8, 2, [0.3, 0.3]), (8, 2, [0.3, 0.3]),
            (9, 2, [0.0, 0.0]), (10, 2, [0.0, 0.0]), (11, 2, []), (12, 1, [0.1]), (13, 2, [0.2, 0.1, 9.0]),
            (14, 3, [1e30, 1.0]), (15, 1, [-0.5, -0.5]), (16, 2, [1e6, 1e6]), (17, 1, [1e6, 1e6]), (20, 7, [1.0, 1.0])]
    got = _check(spark, rows)
    assert {r[0] for r in got} == {0, 10}
    assert (10, 9, 1, 0, 0, 0) in got  # a positive of score zero has negatives of score zero


def test_empty_tables(spark):
    none = H.vectors(spark.createDataFrame([], SCHEMA))
    assert H.mine(none, none).collect() == []
    some = H.vectors(spark.createDataFrame([(1, 1, [1.0], "", 1, 1)], SCHEMA))
    assert H.mine(some, some.where("vec_id = 0")).collect() == [] and H.mine(some, some).collect() == []


def test_index_leaves_out_what_norms_cover():
    r = np.random.default_rng(1)
    m = r.integers(-200, 200, (300, 16))
    q = r.integers(-200, 200, (20, 16))
    exact = m @ q.T
    for least in (0, 20_000, 120_000, 10 ** 7):
        index = H.Index(m, 0.5 * least / np.linalg.norm(q, axis=1).max())
        row, anchor, score = index.search(q, np.full(20, least))
        want = exact >= least
        assert want.sum() == len(row) and want[row, anchor].all() and (exact[row, anchor] == score).all()
    listed = [sum(map(len, H.Index(m, least).lists)) for least in (0, 100, 300, 10 ** 6)]
    assert listed[0] == (m != 0).sum() and listed[0] > listed[1] > listed[2] > listed[3] == 0


def test_window_is_checked(spark):
    none = H.vectors(spark.createDataFrame([], SCHEMA))
    with pytest.raises(ValueError):
        H.mine(none, none, window=(90, 30))
