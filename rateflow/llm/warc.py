"""WARC archives: written and read by Spark's text files, segments put together again.

A record ends with two line breaks, so a text file whose values are records and whose line separator
is CRLF CRLF is a WARC file. Files are compressed as a whole, hence never split: a task reads a
file's records in order and holds one at a time. Reading splits at CRLF CRLF WARC/1.1 CRLF; a block
that holds this sequence itself comes in several lines, which Content-Length puts together again.

A response longer than ``segment_bytes`` is written as a first segment and continuation records,
dealt over the files. The reader groups them by origin identifier, orders them by segment number,
checks that none is missing and that the lengths add up to WARC-Segment-Total-Length, takes the
chunked transfer framing off, and checks length and digest of the payload.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rateflow.llm import common
from rateflow.session import scratch_dir

# The archive and transfer formats.
VERSION = b"WARC/1.1\r\n"
BREAK = "\r\n\r\n"
BETWEEN = BREAK + "WARC/1.1\r\n"
SAME_PAYLOAD = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# End of fixed values.

RECORDS = "value BINARY"
PARSED = (
    "kind STRING, record_id STRING, uri STRING, refers_to STRING, digest STRING, origin STRING, "
    "segment INT, total BIGINT, block BINARY, error STRING"
)
READ = "record_id STRING, kind STRING, uri STRING, refers_to STRING, payload BINARY, payload_bytes BIGINT, payload_digest STRING, segments INT, error STRING"


def chunked(body: bytes, size: int) -> bytes:
    """Chunked transfer framing in chunks of ``size`` bytes, with the empty last chunk."""
    parts = []
    for a in range(0, len(body), size):
        piece = body[a : a + size]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(framed: bytes) -> bytes:
    """The body of chunked framing: sizes in hex, extensions ignored, trailers after the last chunk.

    Raises ValueError where the framing does not hold (a size that is none, a chunk cut short).
    """
    parts, at = [], 0
    while True:
        end = framed.find(b"\r\n", at)
        size = framed[at:end].split(b";", 1)[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]+", size):
            raise ValueError("chunk size missing")
        n, at = int(size, 16), end + 2
        if n == 0:
            return b"".join(parts)
        if framed[at + n : at + n + 2] != b"\r\n":
            raise ValueError("chunk cut short")
        parts.append(framed[at : at + n])
        at += n + 2


def http_payload(block: bytes) -> tuple[bytes, dict[bytes, bytes]]:
    """(payload, header fields in lower case) of an HTTP response; chunked framing is taken off."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("no end of the response header")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        fields[name.strip().lower()] = value.strip()
    if fields.get(b"transfer-encoding", b"").lower() == b"chunked":
        body = unchunked(body)
    return body, fields


def _record(kind: bytes, fields: list[tuple[bytes, bytes | None]], block: bytes) -> bytes:
    lines = [b"WARC-Type: " + kind] + [name + b": " + value for name, value in fields if value is not None]
    lines.append(b"Content-Length: %d" % len(block))
    return VERSION + b"\r\n".join(lines) + b"\r\n\r\n" + block


def response_records(record_id: str, uri: str, date: str, digest: str, payload: bytes, refers_to: str | None, segment_bytes: int, chunk_bytes: int) -> list[bytes]:
    """The records of one capture: a revisit, a response, or a response and its continuations."""
    rid = record_id.encode()
    # white space and controls have no place in an address or a header line
    address = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri).encode() or None
    shared = [(b"WARC-Target-URI", address), (b"WARC-Date", date.encode())]
    typed = (b"Content-Type", b"application/http; msgtype=response")
    named = (b"WARC-Payload-Digest", b"sha256:" + digest.encode())
    if refers_to is not None:
        head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        fields = [(b"WARC-Record-ID", rid), *shared, typed, named, (b"WARC-Profile", SAME_PAYLOAD), (b"WARC-Refers-To", refers_to.encode())]
        return [_record(b"revisit", fields, head)]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk_bytes)
    cuts = range(0, len(block), segment_bytes)
    first = [(b"WARC-Record-ID", rid), *shared, typed, named]
    if len(cuts) == 1:
        return [_record(b"response", first, block)]
    out = []
    for i, a in enumerate(cuts, 1):
        piece, number = block[a : a + segment_bytes], (b"WARC-Segment-Number", b"%d" % i)
        if i == 1:
            out.append(_record(b"response", [*first, number], piece))
            continue
        own = rid[:-1] + b".%d>" % i
        total = b"%d" % len(block) if i == len(cuts) else None
        fields = [(b"WARC-Record-ID", own), *shared, (b"WARC-Segment-Origin-ID", rid), number, (b"WARC-Segment-Total-Length", total)]
        out.append(_record(b"continuation", fields, piece))
    return out


def write(captures: DataFrame, path: str, segment_bytes: int = 1 << 14, chunk_bytes: int = 4096, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write (record_id, uri, payload BINARY, digest, refers_to) as gzip WARC files under ``path``.

    record_id and refers_to are written as they are, in angle brackets; equal ids stand for equal
    captures. A row with refers_to becomes a revisit without body. Null uri: no address; null
    payload: empty.
    """

    def run(batches):
        for batch in common.pieces(batches, "payload", 8 << 20):
            out, held = [], 0
            for rid, uri, body, digest, target in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                for record in response_records(rid, uri or "", date, digest, body or b"", target, segment_bytes, chunk_bytes):
                    out.append(record)
                    held += len(record)
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    columns = ["record_id", "uri", "payload", "digest", "refers_to"]
    records = captures.select(*columns).mapInArrow(run, RECORDS)
    # bytes stay as they are: Spark strings are not checked when cast or written
    records.select(F.col("value").cast("string")).write.option("lineSep", BREAK).option("compression", "gzip").text(path)


def parse_record(record: bytes) -> tuple[dict[bytes, bytes], bytes]:
    """(header fields in lower case, block) of a record that starts after its version line."""
    head, _, block = record.partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n"):
        name, _, value = line.partition(b":")
        fields[name.strip().lower()] = value.strip()
    return fields, block


def _short(line: bytes) -> int:
    """How many bytes a line lacks of its record, by Content-Length (0 where none is named)."""
    fields, block = parse_record(line)
    length = fields.get(b"content-length", b"")
    # a line without the end of the header lacks that blank line too
    return int(length) - len(block) + (0 if b"\r\n\r\n" in line else 4) if length.isdigit() else 0


def records(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under ``path`` (columns ``PARSED``), one row each.

    ``error`` tells why a record is none (no length, a block cut short); such rows are kept.
    """
    names = [f.split(" ")[0] for f in PARSED.split(", ")]
    schema = common.arrow_schema(PARSED)

    def parsed(line: bytes) -> tuple[tuple, bytes]:
        """(row, what follows the block)"""
        fields, block = parse_record(line)
        text = lambda name: fields[name].decode("utf-8", "replace") if name in fields else None
        number = lambda name: int(fields[name]) if fields.get(name, b"").isdigit() else None
        length, rest, error = number(b"content-length"), b"", None
        if length is None:
            error = "no content length"
        else:
            block, rest = block[:length], block[length:]
            if len(block) < length:
                error = "block cut short"
            elif rest.removeprefix(BREAK.encode()) and not rest.startswith(between):
                error = "block longer than its length"
        digest = text(b"warc-payload-digest")
        row = (
            text(b"warc-type"), text(b"warc-record-id"), text(b"warc-target-uri"), text(b"warc-refers-to"),
            digest.removeprefix("sha256:") if digest else None, text(b"warc-segment-origin-id"),
            number(b"warc-segment-number"), number(b"warc-segment-total-length"), block, error,
        )
        return row, rest

    between = BETWEEN.encode()

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], names=names)

    def run(batches):
        file, open_, lack = None, [], 0
        out, held = [], 0
        for batch in common.pieces(batches, "value", 8 << 20):
            for name, line in zip(batch.column("file").to_pylist(), batch.column("value").to_pylist(), strict=True):
                if name != file:
                    if open_:  # the file before ends inside a record
                        out.append(parsed(between.join(open_))[0])
                    file, open_, line = name, [], line.removeprefix(VERSION)
                if open_:  # the separator stood inside the block
                    open_.append(line)
                    lack -= len(between) + len(line)
                else:
                    open_, lack = [line], _short(line)
                while open_ and lack <= 0:
                    row, rest = parsed(between.join(open_))
                    out.append(row)
                    held += len(row[-2])
                    # the end of a block may overlap the separator; then the next record stands in the same line
                    open_ = [rest.removeprefix(between)] if rest.startswith(between) else []
                    lack = _short(open_[0]) if open_ else 0
            if held > 8 << 20:
                yield batch_of(out)
                out, held = [], 0
        if open_:
            out.append(parsed(between.join(open_))[0])
        if out:
            yield batch_of(out)

    lines = spark.read.option("lineSep", BETWEEN).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value")).mapInArrow(run, PARSED)


def read(spark: SparkSession, path: str, want_payload: bool = True) -> DataFrame:
    """One row per response or revisit of the archives (columns ``READ``).

    Whole records need no shuffle. Segments meet by origin identifier: a group is one record, as
    large as its payload was in one value; where a record was archived several times, so many rows
    are returned. A revisit's length is the one that its HTTP header names. ``error`` tells what
    does not hold (a missing segment, a wrong total, framing, length or digest); such a row is kept,
    its payload is null if it cannot be decoded. ``want_payload`` False leaves all payloads null.
    """
    all_ = records(spark, path)
    shared = ["kind", "record_id", "uri", "refers_to", "digest"]
    whole = all_.where("segment IS NULL AND kind IN ('response', 'revisit')").select(*shared, "block", F.lit(1).alias("segments"), "error")
    parts = all_.where("segment IS NOT NULL").withColumn("origin", F.coalesce("origin", "record_id"))
    once = parts.groupBy("origin", *shared, "segment", "total", "block", "error").agg(F.count("*").alias("copies"))
    first = F.col("segment") == 1
    grouped = once.groupBy("origin").agg(
        F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("found"),
        *[F.max(F.when(first, F.col(c))).alias(c) for c in shared],
        F.max("total").alias("total"),
        F.max("error").alias("error"),
        F.max("copies").cast("int").alias("copies"),
    )
    length = F.aggregate("found", F.lit(0).cast("bigint"), lambda n, s: n + F.octet_length(s["block"]))
    in_order = F.transform("found", lambda s: s["segment"]) == F.sequence(F.lit(1), F.size("found"))
    checked = (
        F.when(~in_order, F.lit("segment missing"))
        .when(F.col("total").isNull(), F.lit("no total length"))
        .when(length != F.col("total"), F.lit("wrong total length"))
    )
    block = F.array_join(F.transform("found", lambda s: s["block"].cast("string")), "").cast("binary")
    joined = grouped.select(
        F.coalesce("kind", F.lit("response")).alias("kind"), F.coalesce("record_id", "origin").alias("record_id"), "uri", "refers_to", "digest",
        block.alias("block"), F.size("found").alias("segments"), F.coalesce("error", checked).alias("error"), "copies",
    )
    schema = common.arrow_schema(READ + ", copies INT")

    def decode(kind, block, digest, error):
        """(payload, length, digest, error)"""
        if error:
            return None, None, digest, error
        try:
            payload, fields = http_payload(block)
        except ValueError as exc:
            return None, None, digest, str(exc)
        if kind == "revisit":
            stated = fields.get(b"content-length", b"")
            return None, int(stated) if stated.isdigit() else None, digest, None
        found = hashlib.sha256(payload).hexdigest()
        return payload if want_payload else None, len(payload), found, "wrong digest" if digest and digest != found else None

    def run(batches):
        for batch in common.pieces(batches, "block", 8 << 20):
            rows = [decode(*r) for r in zip(*(batch.column(c).to_pylist() for c in ("kind", "block", "digest", "error")), strict=True)]
            new = dict(zip(("payload", "payload_bytes", "payload_digest", "error"), zip(*rows, strict=True), strict=True)) if rows else {}
            yield pa.RecordBatch.from_arrays(
                [pa.array(new.get(f.name, []), f.type) if f.name in ("payload", "payload_bytes", "payload_digest", "error") else batch.column(f.name).cast(f.type) for f in schema],
                schema=schema,
            )

    columns = [*shared, "block", "segments", "error"]
    names = [f.split(" ")[0] for f in READ.split(", ")]
    ones = whole.select(*columns, F.lit(1).alias("copies")).mapInArrow(run, READ + ", copies INT").select(*names)
    several = joined.select(*columns, "copies").mapInArrow(run, READ + ", copies INT")
    return ones.union(several.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*names))


#: Most rows of repeated payloads that are broadcast (under 100 bytes a row); beyond, a shuffle join.
BROADCAST_ROWS = 200_000


def _record_id(page_id: Column, uri: Column, digest: Column) -> Column:
    mark = F.substring(F.sha2(F.concat_ws(" ", F.coalesce(uri, F.lit("")), digest).cast("binary"), 256), 1, 16)
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(":"), mark, F.lit(">"))


def captures(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """Rows of ``write`` for (page_id, url, html): a record id names page, address and payload.

    Of rows with equal payloads of ``least_bytes`` or more, those of the smallest page_id are
    responses (also a repeated row of that id) and the others revisit them. A null page_id is the
    smallest only where a payload has no other; then all its rows are responses. Payloads are
    found equal by digest, with partial counts before the shuffle; only the digests that repeat
    are joined back, broadcast while they are few, else with adaptive splitting of a hot digest.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("uri"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    first = F.min(F.struct(F.col("page_id").isNull().alias("no"), "page_id", "uri")).alias("first")
    groups = rows.where(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(first, F.count("*").alias("n"))
    shared = common.stored(
        groups.where("n > 1 AND NOT first.no").select("digest", F.col("first.page_id").alias("first_id"), F.col("first.uri").alias("first_uri")), "warc-shared"
    )
    few = shared.count() <= BROADCAST_ROWS
    found = rows.join(F.broadcast(shared) if few else shared, "digest", "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return found.select(
        _record_id(F.col("page_id"), F.col("uri"), F.col("digest")).alias("record_id"), "uri", "payload", "digest",
        F.when(revisit, _record_id(F.col("first_id"), F.col("first_uri"), F.col("digest"))).alias("refers_to"),
    )


def page_of(record_id: str) -> Column:
    """The page_id in a record id of ``captures`` (null page: null)."""
    return F.nullif(F.regexp_extract(record_id, r"^<urn:page:(-?\d+):", 1), F.lit("")).cast("bigint")


def op12_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC files (segments of 16 KiB) and read back: length, digest, kind, original."""
    path = scratch_dir(spark, "warc")
    write(captures(common.table(spark, sf_dir, "pages")), path)
    found = read(spark, path, want_payload=False)
    failed = F.raise_error(F.concat(F.lit("archive record "), F.coalesce("record_id", F.lit("")), F.lit(": "), F.col("error")))
    return found.select(
        page_of("record_id").alias("page_id"), F.when(F.col("error").isNotNull(), failed.cast("bigint")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        "payload_digest", F.col("kind").alias("record_type"), page_of("refers_to").alias("refers_to"),
    )


ORACLE = """
WITH p AS (
    SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), g AS (
    SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM g
"""
