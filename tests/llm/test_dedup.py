"""Operators 8 and 9: exact and near copies."""
import hashlib
import random

import numpy as np
from xxhash import xxh64_intdigest

from leadspark.llm import common as C
from leadspark.llm import exact_dedup as E
from leadspark.llm import simhash as S
from leadspark.llm.components import components

from .conftest import ODD

LOWER = str.maketrans(C.UPPER, C.UPPER.lower())


def test_exact_flags(odd):
    got = {(r.doc_id, r.keep_id, r.kept) for r in E.dedup(odd).collect()}
    assert (7, 7, True) in got and (6, 7, False) in got and (5, 7, False) in got
    assert (1, 2, False) in got and (2, 2, True) in got  # null text is empty
    assert (None, None, True) in got and (3, 3, True) in got
    sizes = {r.doc_id: r.group_size for r in E.dedup(odd).collect()}
    assert sizes[7] == 4 and sizes[2] == 2 and sizes[8] == 1


def test_exact_digest_is_of_ascii_lowered_text(docs):
    r = E.dedup(docs([(1, "ÄB")])).first()
    assert bytes(r.digest) == hashlib.sha256("Äb".encode()).digest()


def test_exact_keeps_rows_and_columns(odd, empty):
    kept = E.keep_first(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == sorted(
        (i is None, i) for i in [None, 2, 3, 4, 7, 8, 9, 10])
    assert E.keep_first(empty).count() == 0 and E.dedup(empty).count() == 0


def test_exact_repeated_row_stays_once(docs):
    assert E.keep_first(docs([(1, "a"), (1, "a"), (0, "A")])).count() == 1


def test_exact_keeps_different_texts_of_one_id(docs):
    rows = [(None, "a"), (None, "b"), (None, "c"), (None, "C"), (1, "d"), (1, "e"), (2, "E"), (3, "f"), (3, "F")]
    kept = sorted((r.doc_id or 0, r.text.lower()) for r in E.keep_first(docs(rows)).collect())
    assert kept == [(0, "a"), (0, "b"), (0, "c"), (1, "d"), (2, "e"), (3, "f")]


def test_index_persists_over_batches(spark, docs):
    index = E.temporary_index(spark)
    index.ingest(E.digests(docs([(1, "a"), (2, "b"), (3, "A")])))
    index.ingest(E.digests(docs([(9, "a"), (4, "c"), (5, "c")])))
    rows = {(r.keep_id, r.group_size) for r in index.table().collect()}
    assert rows == {(3, 2), (2, 1), (5, 2)}  # what an earlier batch published stays
    plan = index.table()._jdf.queryExecution().toString()
    assert "Bucketed: true" in plan or "bucket" in plan.lower()


def test_small_batch_leaves_the_index_where_it_lies(spark, docs):
    index = E.temporary_index(spark)
    index.ingest(E.digests(docs([(i, f"text {i % 700}") for i in range(1400)])))
    batch = C.freeze(E.digests(docs([(5000, "text 3"), (5001, "new"), (5002, "TEXT 4"), (5003, "new")])), "batch")
    index.ingest(batch)
    out = index.flags(batch)
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in out.collect()} == {
        (5000, 703, 2, False), (5001, 5003, 2, False), (5002, 704, 2, False), (5003, 5003, 2, True)}
    plan = out._jdf.queryExecution().optimizedPlan()
    leaves, most = plan.collectLeaves(), 0
    for k in range(leaves.size()):
        files = spark.read.parquet(*[f for f in _files(leaves.apply(k))])
        most = max(most, files.count())
    assert index.table().count() == 701 and most <= 4  # no more rows than the batch has are joined, broadcast or not


def _files(leaf):
    return list(leaf.relation().location().inputFiles())


def test_hot_keys_join_apart(spark):
    rows = spark.createDataFrame([(i, "hot") for i in range(900)] + [(i, f"k{i}") for i in range(100)], "i int, key string")
    unique = rows.groupBy("key").count().withColumnRenamed("count", "n")
    assert sorted(C.spread_join(rows, unique, "key", "n", 1000).select("i", "key", "n").collect()) == sorted(
        rows.join(unique, "key").select("i", "key", "n").collect())


def _fp(text):
    w = (text or "").translate(LOWER).replace("\x00", "\x00").encode().split()
    grams = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(odd):
    exp = sorted((i is None, i, _fp(t)) for i, t in ODD)
    assert sorted((r.doc_id is None, r.doc_id, r.fp % (1 << 64)) for r in S.fingerprints(odd).collect()) == exp


def test_fingerprint_in_pieces(monkeypatch):
    text = " ".join(random.Random(1).choices(["a", "bb", "ccc", "dé"], k=500))
    whole = S.fingerprint(text)
    monkeypatch.setattr(S, "PIECE", 7)
    assert S.fingerprint(text) == whole == _fp(text)


def _classes(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in fps:
        for b in fps:
            if bin((a ^ b) % (1 << 64)).count("1") <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


def test_links_equal_brute_force_sparse_and_dense(spark):
    r = random.Random(5)
    seeds = [r.getrandbits(64) for _ in range(12)] + [0, (1 << 64) - 1]
    fps = set(seeds)
    for s in seeds:
        for _ in range(20):
            s ^= 1 << r.randrange(64)
            if r.random() < 0.7:
                s ^= 1 << r.randrange(64)
            if r.random() < 0.2:
                s ^= 1 << r.randrange(64) | 1 << r.randrange(64)
            fps.add(s)
    fps = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    exp = _classes(fps)
    for segments, dense in ((16, 64), (16, 1), (32, 2), (8, 64)):
        got = {f: f for f in fps}
        got |= {x.node: x.root for x in components(S.links(df, 2, segments, dense), "a", "b").collect()}
        assert got == exp, (segments, dense)


def test_segments_follow_the_number_of_fingerprints():
    r = random.Random(3)
    for segments in S.SEGMENTS[:1]:  # the computed share against pairs drawn at random
        width, near, n = 64 // segments, 0, 0
        for _ in range(4):
            fps = [r.getrandbits(64) for _ in range(2500)]
            c = np.array([[(f >> width * i & (1 << width) - 1).bit_count() for i in range(segments)] for f in fps])
            for i in range(len(c)):
                near += int((np.abs(c[i + 1:] - c[i]).sum(axis=1) <= 2).sum())
            n += len(c) * (len(c) - 1) // 2
        assert 0.3 < (near + 1) / (S.meeting_share(segments) * n + 1) < 3
    for n in (10 ** 5, 10 ** 7, 10 ** 8, 10 ** 9, 10 ** 11):
        assert S.meeting_share(S.segments_for(n)) * n <= S.MEETINGS
    assert S.segments_for(0) == 16 and S.segments_for(10 ** 9) == 32


def test_near_duplicates_odd_rows(odd, empty):
    got = {r.doc_id: r.component_id for r in S.near_duplicates(odd).collect()}
    assert got[5] == got[6] == got[7] == 5 and got[1] == got[2] == got[3] == 1 and got[None] is None
    assert S.near_duplicates(empty).count() == 0
    kept = S.keep_one(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {None, 1, 4, 5, 8, 9, 10}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(edges, "a", "b").collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}
    assert components(edges.where("a < 0"), "a", "b").count() == 0


def test_one_of_each_component_stays_whatever_the_ids(docs):
    a, b = "one two three four five", "six seven eight nine ten"
    rows = [(None, a), (None, a), (None, a), (None, b), (7, "red green blue and white"), (7, "up down left and right"),
            (7, "up down left and right"), (8, "up down left and right"), (9, "mu nu xi pi rho")]
    got = S.keep_one(docs(rows))
    assert got.columns == docs(rows).columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted(
        [(None, a), (None, b), (7, "red green blue and white"), (7, "up down left and right"), (9, "mu nu xi pi rho")],
        key=repr)
