"""Operator 13: byte-level BPE against the tokenizers library and a definition of BPE."""
import hashlib
import json
import random
import struct

import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from leadspark.llm import byte_bpe as B
from leadspark.llm import catalog

from .conftest import ODD

PATH = public_tokenizers.path(B.MODEL)
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def _ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def _coded(texts):
    own, ids, decoded = B.coder(B.MODEL), [], []
    for _, flat, n in own.encode(B._valid(pa.array(texts, pa.string()))):
        lists = B._lists(flat, n)
        ids += lists.to_pylist()
        decoded += own.decode(lists).to_pylist()
    return ids, decoded


def test_odd_strings_equal_the_library(library, monkeypatch):
    r = random.Random(3)
    pools = ["abst'rvelmd  \n\t\r .,!?019éñ中文😀́½Ⅷ  　\x85\x00\x1c\U000323af", "ab '", " \n\ta'",
             "'stredvelm x", ["<|endoftext|>", "<|endof", " a", "'s", "  ", "\n", "x"]]
    texts = ["".join(r.choices(pool, k=r.randrange(14))) for pool in pools for _ in range(800)]
    exp = [_ids(library, t) for t in texts]
    assert _coded(texts) == (exp, texts)
    monkeypatch.setattr(B, "BLOCK", 40)
    long = ["".join(r.choices(["a b", "the cat ", "don't ", "<|endoftext|>", " \n", "é"], k=300)) for _ in range(20)]
    long += ["a" * 500, "<|endoftext|>" * 30 + " a b c" * 30, "é" * 400]
    assert _coded(long) == ([_ids(library, t) for t in long], long)


def test_letters_of_the_library_count(library):
    """Code points over which versions of Unicode differ are split as the library splits them."""
    texts = [f"a{chr(c)}1{chr(c)}!{chr(c)}" for c in [1368, 2191, 7305, 42957, 0x323af, 0x1e030, 73184, *range(0x2000, 0x2070)]]
    assert _coded(texts) == ([_ids(library, t) for t in texts], texts)


def test_merging_by_its_definition():
    own = B.coder(B.MODEL)
    ranks = {k: v >> B.ID_BITS for k, v in own.merges.items()}
    r = random.Random(1)
    for _ in range(300):
        word = bytes(r.choices(b"thean ingor\xc3\xa9", k=r.randrange(1, 20)))
        parts = [own.byte_id[b] for b in word]
        while len(parts) > 1:
            rank, i = min((ranks.get(a << B.ID_BITS | b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[i:i + 2] = [own.merges[parts[i] << B.ID_BITS | parts[i + 1]] & B.IDS]
        assert own.merge(word) == parts
    assert len(own.merge(b"ab" * 100_000)) < 200_000


def test_worker_forgets_words(library, monkeypatch):
    monkeypatch.setattr(B, "REMEMBER", 3)
    monkeypatch.setattr(B, "BLOCK", 30)
    texts = [f"some words {i} and others" for i in range(40)]
    assert _coded(texts)[0] == [_ids(library, t) for t in texts]


def test_frames_on_odd_rows(spark, library, odd, empty):
    exp = sorted((i is None, i, tuple(_ids(library, t)), t or "") for i, t in ODD)
    coded = B.decode(B.encode(odd))
    assert sorted((r.doc_id is None, r.doc_id, tuple(r.ids), r.decoded) for r in coded.collect()) == exp
    packed = [(r.doc_id is None, r.doc_id, struct.unpack(f"<{len(r.packed) // 4}I", r.packed), r.decoded)
              for r in B.round_trip(odd).collect()]
    assert sorted(packed) == exp
    assert B.decode(B.encode(empty)).count() == B.round_trip(empty).count() == 0


def test_decoding_any_ids_equals_the_library(spark, library):
    lists = [[50256, 1, 2], [128, 200, 64], [99999, -1, 15], [], [220, 447, 247], [447]]
    rows = spark.createDataFrame([*enumerate(lists), (9, None)], "doc_id int, ids array<int>")
    got = {r.doc_id: r.decoded for r in B.decode(rows).collect()}
    assert got == {i: library.decode([x for x in ids if x >= 0], skip_special_tokens=False)
                   for i, ids in enumerate(lists)} | {9: ""}


def test_broken_characters_count_as_replaced(spark, library):
    row = spark.range(1).selectExpr("7L doc_id", "cast(x'6162ff63' as string) text")
    assert list(B.encode(row).first().ids) == _ids(library, "ab�c")


def test_other_models_are_refused(tmp_path):
    spec = json.load(open(PATH, encoding="utf-8"))
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}):
        path = tmp_path / "model.json"
        path.write_text(json.dumps(spec | change), encoding="utf-8")
        with pytest.raises(ValueError):
            B.ByteBpe(str(path))


def test_query_equals_the_library(spark, library):
    table = pd.read_parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: tuple(r) for r in catalog.QUERIES["op13_byte_bpe"](spark, SF).collect()}
    assert len(got) == len(table)
    for i, text in zip(table.doc_id, table.text):
        ids = _ids(library, text)
        assert got[i] == (i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(),
                          hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
