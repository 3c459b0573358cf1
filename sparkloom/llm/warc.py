"""WARC archives: writing, and reading back with reassembly of segments.

A page becomes an HTTP response in a record, long ones a first record and
continuation records that name its id; a page whose payload another record
holds becomes a revisit. Archives are gzip members in a binary column, one
row an archive, so that any store that Spark writes to can hold them; their
bytes are ordinary .warc.gz files. Reading parses the members, groups
continuation records by origin id, orders them by segment number, verifies
the total length and decodes chunked framing.

Defined cases: a null html is an empty payload; a null url is an empty target
URI; rows that repeat a page_id are a record each, and of equal payloads with
the same largest page_id one is the response; a null page_id comes before all
others; payloads of any length are cut and joined whole, in time that grows
with their length; an empty table gives no row; other columns are ignored. In
archives by others, records that are neither responses nor revisits nor their
continuations are passed over, a record without a digest gets one and one
without a page id has null; a revisit whose response lies elsewhere has
payload_bytes null.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_of, written

DIGEST = "sha1:"
HEADER = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
#: What a record's head takes, about.
HEAD_BYTES = 500
RECORD = "name string, number long, record_id string, kind string, page_id long, uri string, digest string, refers_to string, origin string, segment int, total long, body binary"


@dataclass(frozen=True)
class Writing:
    """min_revisit_bytes: smaller payloads are always responses. segment_bytes: of block in a record.
    chunk_bytes: of a chunk in the framing. archive_bytes: of an archive, about, before compression. date: of
    all records."""

    min_revisit_bytes: int = 0
    segment_bytes: int = 16 << 10
    chunk_bytes: int = 4 << 10
    archive_bytes: int = 4 << 20
    date: str = "2024-01-01T00:00:00Z"


def chunked(payload: bytes, size: int) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(c := payload[k : k + size]), c) for k in range(0, len(payload), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of chunked framing; extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        if len(out[-1]) != size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("chunk is shorter than its size")
        at = end + 4 + size


def http_payload(block: bytes) -> bytes:
    """The payload of an HTTP response, its transfer coding undone."""
    head, _, body = block.partition(b"\r\n\r\n")
    coded = any(line.lower().replace(b" ", b"") == b"transfer-encoding:chunked" for line in head.split(b"\r\n"))
    return unchunked(body) if coded else body


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """One WARC record as a gzip member."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))] if v is not None) + "\r\n"
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(head.encode() + block + b"\r\n\r\n") + z.flush()


def members(data: bytes, step: int = 4096) -> Iterator[bytes]:
    """What each gzip member of a file holds; no more than a step of the file is looked at twice."""
    view, at = memoryview(data), 0
    while at < len(view):
        z, parts = zlib.decompressobj(31), []
        while not z.eof and at < len(view):
            part = view[at : at + step]
            parts.append(z.decompress(part))
            at += len(part) - len(z.unused_data)
        yield b"".join(parts) + z.flush()


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of a .warc.gz file."""
    for plain in members(data):
        at = 0
        while at < len(plain):
            end = plain.find(b"\r\n\r\n", at)
            first, *lines = plain[at : end if end >= 0 else None].decode().split("\r\n")
            if not first.startswith("WARC/"):
                raise ValueError("not a WARC record")
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
            n, start = int(fields["content-length"]), end + 4
            if end < 0 or len(plain) - start < n:
                raise ValueError("record is shorter than its length")
            yield fields, plain[start : start + n]
            at = start + n + 4


def _id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '/'.join(map(str, parts)))}>"


def write_archives(pages: DataFrame, how: Writing = Writing()) -> DataFrame:
    """Archives of a record for each page: name, data. Which page of equal payloads is the response is decided
    by their digests and lengths, before any payload moves."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), html.alias("html"), F.monotonically_increasing_id().alias("row"))
    rows = written(rows, "warc-rows")  # so that a row keeps its number
    keyed = rows.select("page_id", "row", F.unhex(F.sha1(F.encode("html", "UTF-8"))).alias("digest"), F.octet_length("html").cast("long").alias("size"))
    large = written(keyed.where(F.col("size") >= how.min_revisit_bytes), "warc-digests")
    firsts = large.groupBy("digest", "size").agg(F.max(F.struct("page_id", "row")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # few pages are revisits; those that are learn of their response here
    revisits = large.join(firsts, ["digest", "size"]).where(F.col("row") != F.col("first.row")).select("row", F.col("first.page_id").alias("refers_to"), F.col("first.row").alias("refers_row"))
    decided = rows.join(written(revisits, "warc-revisits"), "row", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[bytes] = []
        held, name = 0, None

        def archive() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"name": [f"pages-{name}.warc.gz"], "data": pa.array([b"".join(made)], pa.binary())})

        for batch in batches:
            for page, url, html, row, refers, refers_row in zip(*columns_of(batch, "page_id", "url", "html", "row", "refers_to", "refers_row"), strict=True):
                payload = html.encode()
                digest = DIGEST + base64.b32encode(hashlib.sha1(payload).digest()).decode()
                me, uri = _id(row), url.replace("\r", "%0D").replace("\n", "%0A").strip()
                common = [("WARC-Date", how.date), ("WARC-Target-URI", uri), ("WARC-Page-ID", page), ("WARC-Payload-Digest", digest)]
                name = row if name is None else name
                if refers_row is not None:
                    made.append(record([("WARC-Type", "revisit"), ("WARC-Record-ID", me), *common, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _id(refers_row)), ("WARC-Refers-To-Page-ID", refers)], HEADER))
                else:
                    block = HEADER + chunked(payload, how.chunk_bytes)
                    parts = [block[k : k + how.segment_bytes] for k in range(0, len(block), how.segment_bytes)]
                    more = [("WARC-Segment-Number", 1)] if len(parts) > 1 else []
                    made.append(record([("WARC-Type", "response"), ("WARC-Record-ID", me), *common, *more], parts[0]))
                    for k, part in enumerate(parts[1:], 2):
                        last = [("WARC-Segment-Total-Length", len(block))] if k == len(parts) else []
                        made.append(record([("WARC-Type", "continuation"), ("WARC-Record-ID", _id(row, k)), ("WARC-Date", how.date), ("WARC-Target-URI", uri), ("WARC-Segment-Origin-ID", me), ("WARC-Segment-Number", k), *last], part))
                held += len(payload) + HEAD_BYTES
                if held >= how.archive_bytes:
                    yield archive()
                    made, held, name = [], 0, None
        if made:
            yield archive()

    return decided.mapInArrow(run, "name string, data binary")


def parse(archives: DataFrame) -> DataFrame:
    """The records of archives (columns name, data), blocks as they stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("name", pa.string()), ("number", pa.int64()), ("record_id", pa.string()), ("kind", pa.string()), ("page_id", pa.int64()), ("uri", pa.string()), ("digest", pa.string()), ("refers_to", pa.string()), ("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("body", pa.binary())])
        number = lambda x: None if x in (None, "None") else int(x)
        for batch in batches:
            for name, data in zip(*columns_of(batch, "name", "data"), strict=True):
                rows = []
                for k, (f, block) in enumerate(records(data)):
                    rows.append((name, k, f.get("warc-record-id"), f["warc-type"], number(f.get("warc-page-id")), f.get("warc-target-uri"), f.get("warc-payload-digest"), f.get("warc-refers-to"), f.get("warc-segment-origin-id"), number(f.get("warc-segment-number")), number(f.get("warc-segment-total-length")), block))
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)
                        rows = []
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)

    return archives.select("name", "data").mapInArrow(run, RECORD)


def reassemble(found: DataFrame) -> DataFrame:
    """Whole responses and revisits: record_id, kind, page_id, uri, digest, refers_to, block. Continuation
    records meet their first record by its id; a record's own length bounds its group."""
    whole = found.where("kind <> 'continuation' AND segment IS NULL").select("record_id", "kind", "page_id", "uri", "digest", "refers_to", F.col("body").alias("block"))
    parts = found.where("kind = 'continuation' OR segment IS NOT NULL").select("*", F.coalesce("origin", "record_id").alias("of"))
    first = lambda c: F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c)
    joined = parts.groupBy("of").agg(
        *(first(c) for c in ("kind", "page_id", "uri", "digest", "refers_to")),
        F.max("total").alias("total"),
        F.array_sort(F.collect_list(F.struct("segment", "body"))).alias("parts"),
    )
    schema = "record_id string, kind string, page_id long, uri string, digest string, refers_to string, block binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 100):
                some, blocks = batch.slice(k, 100), []
                for of, total, parts in zip(*columns_of(some, "record_id", "total", "parts"), strict=True):
                    blocks.append(b"".join(p["body"] for p in parts))
                    if len(blocks[-1]) != total or [p["segment"] for p in parts] != list(range(1, len(parts) + 1)):
                        raise ValueError(f"segments of {of} don't make up its total length")
                head = some.select(["record_id", "kind", "page_id", "uri", "digest", "refers_to"])
                yield head.append_column("block", pa.array(blocks, pa.binary()))

    named = joined.select(F.col("of").alias("record_id"), "kind", "page_id", "uri", "digest", "refers_to", "total", "parts")
    return whole.unionByName(named.mapInArrow(run, schema))


def read_pages(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """A row per response or revisit: record_id, page_id, payload_bytes, payload_digest, record_type, refers_to
    (a page_id) and, if asked for, payload (null for revisits). Payloads are held against their digests."""
    schema = "record_id string, page_id long, kind string, refers_id string, payload_bytes long, payload_digest string" + ", payload binary" * with_payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [], [], [])
            for me, page, kind, refers, digest, block in zip(*columns_of(batch, "record_id", "page_id", "kind", "refers_to", "digest", "block"), strict=True):
                payload = http_payload(block) if kind == "response" else None
                found = None if payload is None else base64.b32encode(hashlib.sha1(payload).digest()).decode()
                own = found if digest is None else digest.removeprefix(DIGEST)
                if found is not None and found != own and (digest or "").startswith(DIGEST):
                    raise ValueError(f"payload of {me} differs from its digest")
                for column, x in zip(rows, (me, page, kind, refers, None if payload is None else len(payload), own, payload), strict=True):
                    column.append(x)
            types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())[: 6 + with_payload]
            names = ["record_id", "page_id", "kind", "refers_id", "payload_bytes", "payload_digest", "payload"][: 6 + with_payload]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=False)], names=names)

    rows = written(reassemble(parse(archives)).where("kind IN ('response', 'revisit')").mapInArrow(run, schema), "warc-pages")
    also = ["payload"] * with_payload
    responses = rows.where("kind = 'response'")
    sizes = responses.select(F.col("record_id").alias("refers_id"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("n"))
    revisits = rows.where("kind = 'revisit'").join(sizes, "refers_id", "left").select("record_id", "page_id", F.col("n").alias("payload_bytes"), "payload_digest", F.col("kind").alias("record_type"), "refers_to", *also)
    return responses.select("record_id", "page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), *also).unionByName(revisits)


def round_trip(pages: DataFrame, how: Writing = Writing()) -> DataFrame:
    """Pages written to archives in the shared folder and read back."""
    return read_pages(written(write_archives(pages, how), "warc-archives")).drop("record_id")


#: The digest's base 32 has no DuckDB function: 8 groups of 20 hexadecimal digits' bits, 32 of 5.
ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages),
     h AS (SELECT page_id, octet_length(b) AS payload_bytes, top, CAST('0x' || substr(sha1(b), 1, 10) AS BIGINT) AS a, CAST('0x' || substr(sha1(b), 11, 10) AS BIGINT) AS b2,
                  CAST('0x' || substr(sha1(b), 21, 10) AS BIGINT) AS c, CAST('0x' || substr(sha1(b), 31, 10) AS BIGINT) AS d FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(flatten([list_transform(range(7, -1, -1), lambda s: (x >> (5 * s)) & 31) for x in [a, b2, c, d]]), lambda v: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(v AS INTEGER) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM h
"""
