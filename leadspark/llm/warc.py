"""WARC archives written and read as a chunked record table.

A record's payload travels as rows (record identifier, chunk number, bytes):
no step after the source holds a whole payload.  An oversized payload becomes
several WARC segments (``WARC-Segment-Number``, ``continuation`` records), each
of at most ``SEGMENT`` payload bytes, so an archive is written and read in
bounded pieces as well.  Reading gives chunk rows back.  They stream through
one digest per record that carries its state from chunk to chunk: where they
are read if the record is whole, else dealt by record and sorted by segment
and chunk.

Archives are gzip files in any folder Spark can write.  A gzip file cannot be
split, so each is read by one task, front to back, line by line.  Lost
executors cost a rewrite of their files only (Spark's output commit).

Of equal payloads the page with the largest id is a ``response``; the others
are ``revisit`` records without a payload that refer to it.

A record is named by its page's id and its payload's digest (and a number, where
several pages agree in both), so pages without an id, or of one id, stay apart.

Defined results: a null payload is empty, and empty payloads are equal to each
other; a null URL is written empty, control characters in a URL are escaped;
a null ``page_id`` is smaller than any other; of rows equal in id and payload
one is the response and the others revisit it; an empty table gives an empty
archive; extra columns are ignored, whatever their names; a payload of any
length is written and read in segments.  A record read back whose payload has
not the declared digest has ``verified`` false; the query fails on it.  The response of a payload that a third of all pages share is found
by partial aggregation and joined to them without a shuffle (``spread_join``).
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadspark.llm import common as C

#: Payload bytes of a segment and of a chunk row, at most.
SEGMENT = 1 << 16
#: Payloads of fewer bytes are never revisited.
MIN_REVISIT = 0
DATE = "1970-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")

CHUNKS = ("record_id string, type string, target string, refers_to string, declared string, "
          "segment int, chunk_no int, data binary")
RECORDS = ("record_id string, type string, target string, refers_to string, payload_bytes long, "
           "payload_digest string, verified boolean")


def _b32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


# -- roles --------------------------------------------------------------------

def roles(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> tuple[DataFrame, DataFrame]:
    """Responses (with payload) and revisits (without) of pages (page_id, url, html)."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        payload.alias("payload"), F.sha1(payload).alias("digest"))
    light = C.freeze(rows.select("page_id", "url", "digest", F.length("payload").alias("n_bytes")), "llm_pages")
    big = light.where(F.col("n_bytes") >= min_revisit)
    groups = big.groupBy("digest").agg(F.max("page_id").alias("response_id"), F.count(F.lit(1)).alias("n"))
    groups = C.freeze(groups, "llm_payloads")

    # the response rows: an equi-join on (digest, id), in which no key is hot
    g = groups.select(F.col("digest").alias("__g"), F.col("response_id").alias("__r"))
    first = (F.col("digest") == F.col("__g")) & F.col("page_id").eqNullSafe(F.col("__r"))
    named = big.join(g, first, "left_semi")
    repeated = named.groupBy("digest", "page_id").agg(F.count(F.lit(1)).alias("n"), F.max("url").alias("url"))
    repeated = C.freeze(repeated.where("n > 1"), "llm_repeated")
    responses = rows.join(g, first, "left_semi").withColumn("copy", F.lit(None).cast("long"))
    if not repeated.isEmpty():  # the same page again: one of its rows is the response
        responses = responses.dropDuplicates(["digest", "page_id"])
    if min_revisit > 0:
        small = rows.where(F.length("payload") < min_revisit)
        responses = responses.unionByName(small.withColumn("copy", F.monotonically_increasing_id()))

    others = big.join(g, first, "left_anti").withColumn("copy", F.monotonically_increasing_id())
    again = repeated.select("page_id", "url", "digest", F.lit(None).cast("int").alias("n_bytes"),
                            F.explode(F.sequence(-F.col("n"), F.lit(-2).cast("long"))).alias("copy"))
    others = others.unionByName(again)
    revisits = C.spread_join(others, groups, "digest", "n", light.count())
    return responses, revisits.select("page_id", "url", "digest", "response_id", "copy")


# -- writing ------------------------------------------------------------------

def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A record without the last of the two line ends that close it: the text sink writes that one."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n"


def _urn(page_id: int | None, digest: str, *more) -> str:
    """Name of a record; ``more`` tells those apart that agree in page id and payload digest."""
    return "<" + ":".join(["urn:page", "" if page_id is None else str(page_id), _b32(digest), *map(str, more)]) + ">"


def _uri(url: str | None) -> str:
    return _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url or "")


def _response(page_id, url, payload: memoryview, digest: str, copy, segment: int) -> Iterator[bytes]:
    n = max(1, -(-len(payload) // segment))
    own = [] if copy is None else ["copy", copy]
    for k in range(n):
        part = bytes(payload[k * segment:(k + 1) * segment])
        rid = _urn(page_id, digest, *own, *(["segment", k + 1] if k else []))
        f = [("WARC-Type", "continuation" if k else "response"), ("WARC-Record-ID", rid), ("WARC-Date", DATE),
             ("WARC-Target-URI", _uri(url))]
        if not k:
            f += [("WARC-Payload-Digest", f"sha1:{_b32(digest)}"),
                  ("Content-Type", "application/http; msgtype=response")]
        if n > 1:
            f.append(("WARC-Segment-Number", str(k + 1)))
        if k:
            f.append(("WARC-Segment-Origin-ID", _urn(page_id, digest, *own)))
            if k == n - 1:
                f.append(("WARC-Segment-Total-Length", str(len(HTTP) + len(payload))))
        yield _record(f, part if k else HTTP + part)


def _revisit(page_id, url, digest: str, response_id, copy) -> bytes:
    return _record([("WARC-Type", "revisit"), ("WARC-Record-ID", _urn(page_id, digest, "revisit", copy)),
                    ("WARC-Date", DATE), ("WARC-Target-URI", _uri(url)),
                    ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                    ("WARC-Payload-Digest", f"sha1:{_b32(digest)}"), ("WARC-Refers-To", _urn(response_id, digest))], b"")


def write(pages: DataFrame, path: str, segment: int = SEGMENT, min_revisit: int = MIN_REVISIT) -> None:
    """Archive ``pages`` (page_id, url, html) under ``path``."""
    def put_responses(batches):
        recs, size = [], 0
        for b in batches:
            for page_id, url, payload, digest, copy in zip(*(b.column(i) for i in range(5))):
                view = memoryview(payload.as_buffer())
                for rec in _response(page_id.as_py(), url.as_py(), view, digest.as_py(), copy.as_py(), segment):
                    recs.append(rec)
                    size += len(rec)
                    if size >= 16 * segment:
                        yield pa.RecordBatch.from_arrays([pa.array(recs, pa.binary())], ["value"])
                        recs, size = [], 0
        if recs:
            yield pa.RecordBatch.from_arrays([pa.array(recs, pa.binary())], ["value"])

    def put_revisits(batches):
        for b in batches:
            recs = [_revisit(*row) for row in zip(*(b.column(i).to_pylist() for i in range(5)))]
            yield pa.RecordBatch.from_arrays([pa.array(recs, pa.binary())], ["value"])

    responses, revisits = roles(pages, min_revisit)
    a = responses.select("page_id", "url", "payload", "digest", "copy").mapInArrow(put_responses, "value binary")
    b = revisits.mapInArrow(put_revisits, "value binary")
    (a.unionByName(b).select(F.col("value").cast("string").alias("value"))
     .write.option("lineSep", "\r\n").option("compression", "gzip").text(path))


# -- reading ------------------------------------------------------------------

class _Parser:
    """Lines of one archive -> chunk rows.  Holds one line and at most one chunk of payload."""

    def __init__(self, chunk: int):
        self.chunk = chunk
        self.left = -1  # bytes of the block still to come; -1 outside a record
        self.head: dict[str, str] | None = None

    def _row(self, data: bytes) -> tuple:
        h = self.head
        origin = h.get("warc-segment-origin-id", h.get("warc-record-id", ""))
        declared = h.get("warc-payload-digest", "").removeprefix("sha1:")
        row = (origin, h.get("warc-type"), h.get("warc-target-uri"), h.get("warc-refers-to"), declared,
               int(h.get("warc-segment-number", 0)), self.no, data)
        self.no += 1
        return row

    def line(self, line: bytes) -> Iterator[tuple]:
        """``line`` came with a line feed after it."""
        if self.head is None:
            if line.startswith(b"WARC/"):
                self.head, self.left = {}, -1
            return
        if self.left < 0:  # in the record's header
            text = line.rstrip(b"\r")
            if text:
                k, _, v = text.decode("utf-8", "replace").partition(":")
                self.head[k.strip().lower()] = v.strip()
                return
            self.left, self.no, self.buf, self.size = int(self.head.get("content-length", 0)), 0, [], 0
            self.http = self.head.get("content-type", "").startswith("application/http")
        else:
            data = line + b"\n"
            data = data[:self.left]
            self.left -= len(data)
            if self.http:
                self.http = data not in (b"\r\n", b"\n")
            else:
                for at in range(0, len(data), self.chunk):
                    part = data[at:at + self.chunk]
                    if self.size + len(part) > self.chunk:
                        yield self._row(b"".join(self.buf))
                        self.buf, self.size = [], 0
                    self.buf.append(part)
                    self.size += len(part)
        if self.left == 0:
            if self.size or not self.no:
                yield self._row(b"".join(self.buf))
            self.head = None


def read_chunks(spark: SparkSession, path: str, chunk: int = SEGMENT) -> DataFrame:
    """Chunk rows of the archives under ``path``; an empty payload has one empty chunk."""
    names = [f.split()[0] for f in CHUNKS.split(", ")]
    kinds = [pa.string()] * 5 + [pa.int32()] * 2 + [pa.binary()]

    def run(batches):
        at, parser, rows, size = None, None, [], 0

        def out():
            cols = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)
        for b in batches:
            for file, line in zip(b.column(0).to_pylist(), b.column(1)):
                if file != at:
                    at, parser = file, _Parser(chunk)
                for row in parser.line(line.as_py()):
                    rows.append(row)
                    size += len(row[-1])
                    if size >= 64 * chunk or len(rows) >= 4096:
                        yield out()
                        rows, size = [], 0
        if rows:
            yield out()
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("line"))
    return lines.mapInArrow(run, CHUNKS)


class _Digest:
    """The record being read: its header fields, bytes so far and running digest."""

    def __init__(self, head: dict):
        self.head, self.n, self.h = head, 0, hashlib.sha1()

    def add(self, data: pa.Scalar) -> None:
        part = data.as_buffer()
        self.n += part.size
        self.h.update(part)

    def row(self) -> tuple:
        named = tuple(self.head[c] for c in ("record_id", "type", "target", "refers_to"))
        declared = self.head["declared"]
        if self.head["type"] == "revisit":
            return (*named, None, declared, None)
        found = base64.b32encode(self.h.digest()).decode()
        return (*named, self.n, found, found == declared)


_HEAD = ["record_id", "type", "target", "refers_to", "declared"]
_KINDS = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.bool_()]
_NAMES = [f.split()[0] for f in RECORDS.split(", ")]


def _table(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _KINDS)], _NAMES)


def records(chunks: DataFrame) -> DataFrame:
    """One row per record of ``chunks`` (as ``read_chunks`` gives them): payload size and digest.

    A record that is not segmented lies in one archive, so its chunks come one
    after the other and are digested where they are read; its first chunk ends
    the record before, whatever their names.  Only the chunks of segmented records, which may lie in several archives, are dealt by record
    and sorted; their digest runs over them in order.
    """
    own = [*_NAMES, "declared", "segment", "chunk_no", "data"]
    kinds = [*_KINDS, pa.string(), pa.int32(), pa.int32(), pa.binary()]

    def in_place(batches):
        state = None
        for b in batches:
            rows = []
            heads = b.select([*_HEAD, "segment", "chunk_no"]).to_pylist()
            for head, data in zip(heads, b.column("data")):
                if state and (head["chunk_no"] == 0 or state.head["record_id"] != head["record_id"]):
                    rows.append((*state.row(), None, None, None, None))
                    state = None
                if head["segment"]:
                    rows.append((*(head[c] for c in _HEAD[:4]), None, None, None, head["declared"],
                                 head["segment"], head["chunk_no"], data.as_py()))
                else:
                    state = state or _Digest(head)
                    state.add(data)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], own)
        if state:
            rows = [(*state.row(), None, None, None, None)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], own)

    def dealt(batches):
        state = None
        for b in batches:
            done = []
            for head, data in zip(b.select(_HEAD).to_pylist(), b.column("data")):
                if state is None or state.head["record_id"] != head["record_id"]:
                    if state:
                        done.append(state.row())
                    state = _Digest(head)
                state.add(data)
            if done:
                yield _table(done)
        if state:
            yield _table([state.row()])
    read = chunks.mapInArrow(in_place, RECORDS + ", declared string, segment int, chunk_no int, data binary")
    read = C.freeze(read, "llm_warc_read")
    n = C.shuffle_partitions(chunks.sparkSession)
    parts = read.where("segment is not null").select(*_HEAD, "segment", "chunk_no", "data")
    parts = parts.repartition(n, "record_id").sortWithinPartitions("record_id", "segment", "chunk_no")
    return read.where("segment is null").select(*_NAMES).unionByName(parts.mapInArrow(dealt, RECORDS))


def resolved(recs: DataFrame) -> DataFrame:
    """Records with each revisit's payload size taken from the response it refers to."""
    recs = C.freeze(recs, "llm_warc_records")
    revisits = recs.where("type = 'revisit'").drop("payload_bytes")
    refs = revisits.groupBy("refers_to").agg(F.count(F.lit(1)).alias("__n"))
    origin = recs.where("type = 'response'").select(F.col("record_id").alias("refers_to"), "payload_bytes")
    origin = C.freeze(refs.join(origin, "refers_to"), "llm_warc_origins")
    full = C.spread_join(revisits, origin, "refers_to", "__n", revisits.count()).drop("__n")
    return recs.where("type = 'response'").unionByName(full.select(*recs.columns))


# -- query --------------------------------------------------------------------

def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive every page, read the archives back, and list the records found."""
    path = f"{C.ensure_checkpoint_dir(spark).rstrip('/')}/llm_warc/{uuid.uuid4().hex}"
    write(C.read(spark, sf_dir, "pages"), path)
    out = resolved(records(read_chunks(spark, path)))

    def page(c: str):
        return F.regexp_extract(c, r"^<urn:page:(-?\d+)", 1)
    own, refers = page("record_id"), page("refers_to")
    broken = F.raise_error(F.concat(F.lit("payload of another digest than declared: "), "record_id")).cast("string")
    digest = F.when(F.col("verified") == F.lit(False), broken).otherwise(F.col("payload_digest"))
    return out.select(F.when(own != "", own.cast("long")).alias("page_id"), "payload_bytes", digest.alias("payload_digest"),
                      F.col("type").alias("record_type"),
                      F.when(refers != "", refers.cast("long")).alias("refers_to"))


SQL = """
with p as (select page_id, coalesce(html, '') as body from pages),
d as (select page_id, strlen(body) as payload_bytes, sha1(body) as hex from p),
g as (select hex, max(page_id) as keep from d group by hex)
select page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + cast((cast('0x' || substr(hex, 1 + 10 * (j // 8), 10) as bigint) >> (35 - 5 * (j % 8))) & 31
                    as int), 1)), '') as payload_digest,
       case when page_id = keep then 'response' else 'revisit' end as record_type,
       case when page_id = keep then null else keep end as refers_to
from d join g using (hex)
"""
