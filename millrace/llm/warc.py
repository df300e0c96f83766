"""WARC archives: segmented records, revisit records and chunked transfer framing.

A record holds an HTTP response whose body is framed in chunks. A block longer than the segment limit is written as a
first segment and continuation records that name it as their origin. Reading groups segments by origin
identifier, orders them by segment number, verifies numbers and total length, joins the blocks and undoes the framing.
"""

from __future__ import annotations

import base64
import hashlib
import secrets
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed_join, scratch, written

VERSION = b"WARC/1.1"
SEGMENT_BYTES = 32 << 10
CHUNK_BYTES = 8 << 10
#: Records of one archive file, at most; with SEGMENT_BYTES this bounds the file.
FILE_RECORDS = 4096
URN = "urn:x-millrace:page"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
READ_SIZE = 1 << 20


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: object, segment: int = 1, copy: str = "") -> str:
    """The identifier of a page's record, or of one of its later segments; copy tells rows with one page_id apart."""
    return f"<{URN}:{'' if page is None else page}{':' + copy if copy else ''}{f'#{segment}' if segment > 1 else ''}>"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(piece), piece) for i in range(0, len(payload), size) if (piece := payload[i : i + size])]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body. Chunk extensions and trailers are skipped; anything else out of form is an error."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("a chunk's size line has no end")
        size = int(body[at:end].split(b";", 1)[0].strip(), 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if len(body) < at + size + 2 or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is cut short")
        out.append(body[at : at + size])
        at += size + 2


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))])
    return VERSION + b"\r\n" + head.encode() + b"\r\n" + block


def _line(text: str | None) -> str:
    """A header value of one line."""
    return " ".join((text or "").split()) or "about:blank"


def records(page: int | None, url: str | None, payload: bytes, refers_to: int | None, segment: int = SEGMENT_BYTES, copy: str = "") -> Iterator[bytes]:
    """The records of a page, without the blank lines behind each: a revisit record, or a response in one or more segments."""
    digest = payload_digest(payload)
    about = [("WARC-Date", DATE), ("WARC-Target-URI", _line(url)), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    if refers_to is not None:
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", record_id(page, 1, copy)), ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to)), *about], head)
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    pieces = [block[i : i + segment] for i in range(0, len(block), segment)]
    for n, piece in enumerate(pieces, 1):
        place = [] if len(pieces) == 1 else [("WARC-Segment-Number", n)]
        if n > 1:
            place.append(("WARC-Segment-Origin-ID", record_id(page, 1, copy)))
        if n == len(pieces) and n > 1:
            place.append(("WARC-Segment-Total-Length", len(block)))
        kind = "response" if n == 1 else "continuation"
        yield _record([("WARC-Type", kind), ("WARC-Record-ID", record_id(page, n, copy)), *place, *about], piece)


def parsed(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields in lower case, block) of the records in an archive's bytes, which come in pieces; holds a record at a time."""
    held, ended = bytearray(), False

    def need(n: int) -> bool:
        nonlocal ended
        while len(held) < n and not ended:
            more = next(pieces, None)
            if more is None:
                ended = True
            else:
                held.extend(more)
        return len(held) >= n

    while True:
        while need(2) and held[:2] == b"\r\n":
            del held[:2]
        if not held:
            return
        at = -1
        while at < 0:
            at = held.find(b"\r\n\r\n")
            if at < 0 and not need(len(held) + 1):
                raise ValueError("a record's header has no end")
        first, *lines = bytes(held[:at]).decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError("a record does not begin with its version")
        fields = {k.strip().lower(): v.strip() for k, v in (line.split(":", 1) for line in lines)}
        size = int(fields["content-length"])
        if not need(at + 4 + size):
            raise ValueError("a record's block is cut short")
        block = bytes(held[at + 4 : at + 4 + size])
        del held[: at + 4 + size]
        yield fields, block


def inflated(content: bytes) -> Iterator[bytes]:
    """The bytes of an archive that may be compressed as one or more gzip members, piece by piece."""
    if content[:2] != b"\x1f\x8b":
        for i in range(0, len(content), READ_SIZE):
            yield content[i : i + READ_SIZE]
        return
    at = 0
    while at < len(content):
        member = zlib.decompressobj(31)
        while not member.eof:
            piece = content[at : at + READ_SIZE]
            if not piece:
                raise ValueError("an archive is cut short")
            out = member.decompress(piece)
            at += len(piece) - len(member.unused_data)
            if out:
                yield out


def http_payload(block: bytes) -> bytes:
    """The body of an HTTP message, its chunked framing undone where the header names it."""
    head, _, body = block.partition(b"\r\n\r\n")
    lines = [line.split(b":", 1) for line in head.split(b"\r\n")[1:] if b":" in line]
    coding = {k.strip().lower(): v.strip().lower() for k, v in lines}.get(b"transfer-encoding", b"")
    return dechunked(body) if coding.endswith(b"chunked") else body


def reassembled(segments: list[tuple[int, int | None, bytes]]) -> bytes:
    """The block of a record from its (number, total length or None, block) segments, in any order, repeats allowed."""
    by_number = {}
    for number, total, block in segments:
        if by_number.setdefault(number, (total, block)) != (total, block):
            raise ValueError(f"two segments have number {number} and differ")
    if sorted(by_number) != list(range(1, len(by_number) + 1)):
        raise ValueError("a segment is missing")
    ordered = [by_number[n] for n in sorted(by_number)]
    whole = b"".join(block for _, block in ordered)
    if ordered[-1][0] != len(whole):
        raise ValueError(f"the segments have {len(whole)} bytes, the total length is {ordered[-1][0]}")
    return whole


def decided(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) with refers_to: the largest page_id of those with an equal payload, or null for that page itself.

    Only payloads that occur twice or more are looked up. Those held by many pages are served by a broadcast of
    fewer than 1,000 rows, so no task gets the pages of one common payload. Null page_ids never are the largest;
    of repeated rows with the largest page_id all are responses.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    counted = rows.groupBy("digest").agg(F.max("page_id").alias("largest"), F.count(F.lit(1)).alias("n"))
    facts = written(counted.where("n > 1"), "payloads")
    n_facts, total = facts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    out = keyed_join(rows, facts, "digest", "n", int(total), int(n_facts))
    other = ~F.col("largest").eqNullSafe(F.col("page_id"))
    return out.select("page_id", "url", "html", F.when(other, F.col("largest")).alias("refers_to"))


def _repeated(pages: DataFrame) -> DataFrame:
    """The page_ids, null apart, that several rows have."""
    return written(pages.where("page_id IS NOT NULL").groupBy(F.col("page_id").cast("long").alias("page_id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "repeated")


def write_archives(pages: DataFrame, path: str, segment: int = SEGMENT_BYTES) -> None:
    """A record per row of pages(page_id, url, html) into gzip archives under path, by Spark's writer: a folder any executor can reach.

    Each record is a line of the text sink with the format's blank lines as separator. Long payloads are cut into segments.
    Null html: the empty payload. Null url: about:blank. Null page_id, and rows that share one: records with identifiers of their own. Very long
    texts: as many segments as they take. Empty pages: archives without records. Other columns are ignored.
    """

    def run(batches):
        for batch in batches:
            out, held = [], 0
            for page, url, html, refers_to, several in zip(*(batch.column(k).to_pylist() for k in range(5))):
                copy = secrets.token_hex(8) if several or page is None else ""
                for record in records(page, url, (html or "").encode(), refers_to, segment, copy):
                    out.append(record)
                    held += len(record)
                if held >= 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    rows, repeated = decided(pages), _repeated(pages)
    n, held = repeated.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    several = F.lit(False)
    if n:
        rows, several = keyed_join(rows, repeated.withColumn("several", F.lit(True)), "page_id", "n", int(held), int(n)), F.coalesce("several", F.lit(False))
    framed = rows.select("page_id", "url", "html", "refers_to", several.alias("several")).mapInArrow(run, "record binary")
    framed = framed.select(F.col("record").cast("string").alias("value"))
    framed.write.option("compression", "gzip").option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of the archives under path, whole again: record_id, record_type, uri, refers_to, digest, payload_bytes, payload, valid, error.

    Records in one piece are judged where they are read; only segments are shuffled, by origin identifier. A response is
    valid if its segments are complete, its framing is sound and its payload has the digest of its header. A
    revisit has no payload; its length and digest are those its header states. Archives may be plain or gzip of one or many members. A repeated segment counts
    once; a missing, differing or overlong one makes its record invalid, with the reason as error; an archive that is cut short or has no records' form fails the read. No records: no rows.
    Each archive is read once, into a table of its records; payloads=False leaves the payload out of it where it is not wanted.
    """
    schema = "record_id string, record_type string, uri string, refers_to string, digest string, payload_bytes long, payload binary, error string"
    partial = "origin string, number int, total long, block binary"

    def finished(fields: dict, block: bytes | None, error: str | None = None) -> tuple:
        digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
        common = fields["warc-record-id"], fields["warc-type"], fields.get("warc-target-uri"), fields.get("warc-refers-to")
        if fields["warc-type"] == "revisit":
            head = dict(line.split(":", 1) for line in block.decode().split("\r\n")[1:] if ":" in line)
            return *common, digest, int(head["Content-Length"]), None, None
        try:
            if error:
                raise ValueError(error)
            payload = http_payload(block)
            if digest and payload_digest(payload) != digest:
                raise ValueError("the payload does not have its digest")
            return *common, payload_digest(payload), len(payload), payload if payloads else None, None
        except ValueError as e:
            return *common, digest, None, None, str(e)

    def batch(rows: list[tuple], names: str) -> pa.RecordBatch:
        kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
        columns = [c.split() for c in names.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[kind]) for k, (_, kind) in enumerate(columns)], [name for name, _ in columns])

    def scan(batches):
        for files in batches:
            for content in files.column(0):
                rows, held = [], 0
                for fields, block in parsed(inflated(content.as_py())):
                    number = int(fields.get("warc-segment-number", 0))
                    if fields["warc-type"] not in ("response", "revisit", "continuation"):
                        continue
                    if number:
                        total = fields.get("warc-segment-total-length")
                        header = None if number > 1 else "\n".join(f"{k}:{v}" for k, v in fields.items())
                        rows.append((*[None] * 8, fields.get("warc-segment-origin-id", fields["warc-record-id"]), number, total and int(total), block, header))
                    else:
                        rows.append((*finished(fields, block), *[None] * 5))
                    held += len(block)
                    if held >= 4 << 20:
                        yield batch(rows, f"{schema}, {partial}, header string")
                        rows, held = [], 0
                if rows:
                    yield batch(rows, f"{schema}, {partial}, header string")

    def join(batches):
        for groups in batches:
            rows = []
            for origin, segments in zip(groups.column(0).to_pylist(), groups.column(1).to_pylist()):
                header = next((s["header"] for s in segments if s["header"]), None)
                if header is None:
                    rows.append((origin, "response", None, None, None, None, None, "the first segment is missing"))
                    continue
                fields = dict(line.split(":", 1) for line in header.split("\n"))
                try:
                    rows.append(finished(fields, reassembled([(s["number"], s["total"], s["block"]) for s in segments])))
                except ValueError as e:
                    rows.append(finished(fields, None, str(e)))
            yield batch(rows, schema)

    files = spark.read.format("binaryFile").load(path).select("content")
    found = written(files.mapInArrow(scan, f"{schema}, {partial}, header string"), "records")
    whole = found.where("origin IS NULL").select(*[c.split()[0] for c in schema.split(", ")])
    segments = found.where("origin IS NOT NULL").groupBy("origin").agg(F.collect_list(F.struct("number", "total", "block", "header")).alias("segments"))
    return whole.unionByName(segments.mapInArrow(join, schema)).withColumn("valid", F.col("error").isNull())


def archive_report(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Pages written as archives and read back: page_id, payload_bytes, payload_digest, record_type, refers_to, valid.

    Null html: the empty payload. Null url: about:blank. Equal payloads: the largest page_id's record is the response,
    the others revisit it. Repeated rows: a record each, told apart by their identifiers. Null page_id: a record of its own, which
    reads back with page_id null. Empty input: no rows. Other columns of pages are ignored.
    """
    spark = pages.sparkSession
    path = path or scratch(spark, "warc")
    write_archives(pages, path)
    if pages.limit(1).count() == 0:
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, valid boolean")
    page = lambda name: F.expr(f"try_cast(regexp_extract({name}, '<{URN}:(-?[0-9]+)', 1) AS BIGINT)")
    return read_archives(spark, path, payloads=False).select(
        page("record_id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", page("refers_to").alias("refers_to"), "valid"
    )
