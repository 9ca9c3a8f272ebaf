"""Operator 5: archives written and read back."""
import base64
import gzip
import hashlib
import uuid

from leadspark.llm import common as C
from leadspark.llm import warc as A

PAGES = [(1, "http://a/", "x"), (2, "http://b/\r\nX: y", "x"), (3, "http://c", None), (4, None, ""),
         (5, "http://e", "é\r\n\r\nWARC/1.1\r\n" * 40), (6, "http://f", "z" * 5000), (None, "http://g", "n"),
         (7, "http://h", "rep"), (7, "http://h", "rep"), (8, "http://i", "line\nline\r\n\n"), (-4, "http://j", "m\r"),
         (9, "http://k", "z" * 5000)]


def _pages(spark, rows):
    return spark.createDataFrame([(*r, "d", 3) for r in rows], "page_id long, url string, html string, "
                                                               "digest string, n long")


def _path(spark):
    return f"{C.ensure_checkpoint_dir(spark)}/test_warc/{uuid.uuid4().hex}"


def _b32(t):
    return base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()


def _expected(rows):
    low = float("-inf")
    out, seen = [], set()
    best = {}
    for i, _, t in rows:
        k = t or ""
        best[k] = max(best.get(k, (low, None)), (low if i is None else i, i), key=lambda x: x[0])
    for i, _, t in rows:
        k = t or ""
        first = best[k][1] == i and k not in seen
        if first:
            seen.add(k)
        out.append((i, len(k.encode()), _b32(k), "response" if first else "revisit", None if first else best[k][1]))
    return sorted(out, key=repr)


def _read(spark, path):
    def page(urn):
        n = (urn or "").removeprefix("<urn:page:").split(":")[0].rstrip(">")
        return int(n) if n else None
    recs = A.resolved(A.records(A.read_chunks(spark, path, 256))).collect()
    assert all(r.verified for r in recs if r.type == "response")
    return sorted([(page(r.record_id), r.payload_bytes, r.payload_digest, r.type, page(r.refers_to)) for r in recs],
                  key=repr)


def test_round_trip_whole_and_segmented(spark):
    for segment in (1 << 16, 100):
        path = _path(spark)
        A.write(_pages(spark, PAGES), path, segment)
        assert _read(spark, path) == _expected(PAGES)


def test_chunks_give_the_payload_back(spark):
    path = _path(spark)
    A.write(_pages(spark, PAGES), path, 100)
    rows = A.read_chunks(spark, path, 64).where("type != 'revisit'").collect()
    assert max(len(r.data) for r in rows) <= 64
    got = {}
    for r in sorted(rows, key=lambda r: (r.record_id, r.segment, r.chunk_no)):
        got[r.record_id] = got.get(r.record_id, b"") + bytes(r.data)
    assert sorted(got.values()) == sorted({(t or "").encode() for _, _, t in PAGES})


def test_archives_are_records_one_after_the_other(spark):
    path = _path(spark)
    A.write(_pages(spark, [(6, "http://f", "z" * 250)]).coalesce(1), path, 100)
    files = [r[0] for r in spark.read.format("binaryFile").load(path).select("content").collect()]
    raw = b"".join(gzip.decompress(f) for f in files)
    heads, at = [], 0
    while at < len(raw):  # by the lengths alone
        end = raw.index(b"\r\n\r\n", at) + 4
        lines = raw[at:end].decode().split("\r\n")
        assert lines[0] == "WARC/1.1"
        head = dict(x.split(": ", 1) for x in lines[1:] if x)
        heads.append(head)
        at = end + int(head["Content-Length"]) + 4
        assert raw[at - 4:at] == b"\r\n\r\n"
    assert [h["WARC-Type"] for h in heads] == ["response", "continuation", "continuation"]
    assert heads[-1]["WARC-Segment-Total-Length"] == str(250 + len(A.HTTP))


def test_least_revisit_size_and_empty_table(spark):
    path = _path(spark)
    A.write(_pages(spark, PAGES), path, min_revisit=3)
    types = [(r[0], r[3]) for r in _read(spark, path)]
    assert types.count((7, "revisit")) == 1 and (1, "response") in types and (2, "response") in types
    assert (3, "response") in types and (4, "response") in types and (6, "revisit") in types
    path = _path(spark)
    A.write(_pages(spark, []), path)
    assert _read(spark, path) == []


def test_pages_without_an_id_or_of_one_id_stay_apart(spark):
    lost = [(None, "http://a", "one"), (None, "http://b", "two22"), (None, "http://c", "two22"),
            (1, "http://d", "one"), (2, None, None), (None, "http://e", "w" * 250), (None, "http://f", "v" * 270)]
    same = [(7, "http://a", "x"), (7, "http://a", "yy"), (7, "http://b", "zzz"), (7, "http://c", "w" * 250),
            (7, "http://c", "u" * 250), (7, "http://d", "yy")]
    for rows in (lost, same):
        for segment in (1 << 16, 100):
            path = _path(spark)
            A.write(_pages(spark, rows).coalesce(1), path, segment)
            assert _read(spark, path) == _expected(rows)


def test_small_pages_that_agree_in_all_are_records_of_their_own(spark):
    rows = [(None, "http://a", "ab" * 90)] * 3 + [(4, "http://b", "x")] * 2
    path = _path(spark)
    A.write(_pages(spark, rows).coalesce(1), path, 100, min_revisit=1000)
    assert [r[:4] for r in _read(spark, path)] == sorted(
        [(i, len(t), _b32(t), "response") for i, _, t in rows], key=repr)
