"""Registered queries over the smallest data folder: SQL twins, libraries and brute force."""
import hashlib
import os

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from leadspark.llm import catalog, decontaminate, licenses, quality, token_count
from leadspark.llm import common as C

from .test_dedup import _classes, _fp
from .test_filters import _contained
from .test_texts import _removed

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table():
    return pd.read_parquet(f"{SF}/documents.parquet")


def _rows(df):
    cols = sorted(df.columns)
    own = df[cols].astype(object)
    return sorted(map(repr, own.where(own.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, exp = catalog.QUERIES[name](spark, SF).toPandas(), con.execute(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(exp.columns) and _rows(got) == _rows(exp)


def test_entry_lists_every_operator_once():
    import __spark_entry__ as E
    names = list(E.queries())
    for n in {int(x[2:].split("_")[0]) for x in catalog.QUERIES}:
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and set(E.oracle_sql()) <= set(names)


def test_op2_on_labels(spark, table):
    labels = pd.read_parquet(f"{SF}/labels.parquet").set_index("doc_id").quality
    got = catalog.QUERIES["op2_quality"](spark, SF).toPandas().set_index("doc_id")
    assert len(got) == len(table) and not got.index.duplicated().any()
    own = got.loc[labels.index]
    assert own.kept[labels == 1].all() and (own.kept[labels == 0]).mean() < 0.4


def test_op4_equals_library(spark, table):
    import public_tokenizers
    import sentencepiece
    from leadspark.llm import sentencepiece_codec as S
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(S.MODEL))
    coded = S.encode(C.read(spark, SF, "documents")).toPandas().set_index("doc_id").ids
    assert all(list(coded[i]) == sp.encode(t) for i, t in zip(table.doc_id, table.text))
    got = catalog.QUERIES["op4_sentencepiece"](spark, SF).toPandas()
    assert got.round_trip.all() and len(got) == len(table)
    assert dict(zip(got.doc_id, got.decoded_sha256)) == {
        i: hashlib.sha256(t.encode()).hexdigest() for i, t in zip(table.doc_id, table.text)}


def test_op6_equals_library(spark, table):
    t = token_count.tokenizer(token_count.MODEL)
    got = catalog.QUERIES["op6_token_counts"](spark, SF).toPandas()
    exp = {i: (len(x.encode()), len(t.encode(x, add_special_tokens=False))) for i, x in zip(table.doc_id, table.text)}
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in got.itertuples()} == exp
    assert (got.over_limit == (got.n_tokens > 2048)).all()


def test_op7_equals_brute_force(spark, table):
    got = catalog.QUERIES["op7_suffix_dedup"](spark, SF).toPandas()
    exp = _removed(list(zip(table.doc_id, table.text)))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.itertuples()} == exp


def test_op9_equals_brute_force(spark, table):
    fps = {i: _fp(t) for i, t in zip(table.doc_id, table.text)}
    roots = _classes(sorted(set(fps.values())))
    low = {}
    for i, f in fps.items():
        low[roots[f]] = min(i, low.get(roots[f], i))
    got = catalog.QUERIES["op9_simhash"](spark, SF).toPandas()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got.itertuples()} == {
        i: (f"{f:016x}", low[roots[f]]) for i, f in fps.items()}


def test_op10_finds_the_notices(spark, table):
    got = catalog.QUERIES["op10_licenses"](spark, SF).toPandas().set_index("doc_id").licenses
    notices = {n: f for f, ns in licenses.TEMPLATES.items() for n in ns}
    for i, t in zip(table.doc_id, table.text):
        assert set(got[i]) == {f for n, f in notices.items() if n in t.split("\n")}


def test_pipeline_equals_brute_force(spark, table, tmp_path):
    """Each stage against brute force on what the stage before it kept (the classifier: against its labels)."""
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "exact dedup", "SimHash near-dedup", "benchmark decontamination",
        "SentencePiece encoding and decoding"]
    bench = pd.read_parquet(f"{SF}/benchmark.parquet")
    labels = pd.read_parquet(f"{SF}/labels.parquet").set_index("doc_id").quality
    docs, text = C.read(spark, SF, "documents"), dict(zip(table.doc_id, table.text))
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < 4:
            assert out.columns == list(table.columns)
        path = os.path.join(str(tmp_path), str(k))
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert set(labels.index[labels == 1]) <= kept[0] < set(text)
    lower = {i: "".join(c.lower() if c.isascii() else c for c in text[i]) for i in kept[0]}
    best = {}
    for i, t in lower.items():
        best[t] = max(i, best.get(t, i))
    assert kept[1] == set(best.values())
    fps = {i: _fp(text[i]) for i in kept[1]}
    roots, low = _classes(sorted(set(fps.values()))), {}
    for i, f in fps.items():
        low[roots[f]] = min(i, low.get(roots[f], i))
    assert kept[2] == set(low.values())
    bad = {i for i, *_ in _contained([(i, text[i]) for i in kept[2]], list(zip(bench.item_id, bench.text)))}
    assert kept[3] == kept[2] - bad and kept[4] == kept[3]
    assert docs.filter("not round_trip or n_tokens != size(ids)").count() == 0
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == kept[4]


def test_pipeline_stages_on_odd_rows(spark, odd, empty, tmp_path):
    for docs in (odd, empty):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, SF)
            if k < 4:
                assert out.columns == docs.columns
            assert out.count() <= docs.count()


def test_quality_constants():
    assert quality.KEEP_FROM == 0.25 and decontaminate.SHINGLE == 5 and decontaminate.CONTAINMENT == 0.8
