"""Directly addressable codes: token ids with random access, without decoding blocks.

An id is split into chunks of ``bits`` bits, lowest first. Level 0 holds the first chunk of every
id; a continuation bit says whether the id goes on, and its next chunk stands on the next level at
the rank of that bit. A rank directory (ones before each 512-bit superblock, and before each
64-bit word inside it) makes one access cost one look-up per level.

A file holds some documents: a directory of (doc_id, length) and the codes of all their ids.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rateflow.llm import common, tokens

MAGIC = b"DACS"
_HEAD = struct.Struct("<4sBBHQQ")


def _level(chunks: np.ndarray, more: np.ndarray) -> bytes:
    words = -(-len(more) // 64)
    bits = np.zeros(words * 8, dtype=np.uint8)
    packed = np.packbits(more, bitorder="little")
    bits[: len(packed)] = packed
    ones = np.bitwise_count(bits.view("<u8")).astype(np.int64)
    before = np.concatenate([[0], np.cumsum(ones)[:-1]]) if words else ones
    supers = before[::8]
    inside = (before - np.repeat(supers, 8)[:words]).astype("<u2")
    return b"".join(
        [struct.pack("<Q", len(chunks)), chunks.tobytes(), bits.tobytes(), supers.astype("<u8").tobytes(), inside.tobytes()]
    )


def pack(ids: np.ndarray, bits: int = 8) -> bytes:
    """The levels of ``ids`` (unsigned 32-bit), chunks of 8 or 16 bits."""
    rest, out = np.asarray(ids, dtype=np.uint32), []
    kind = {8: np.dtype("u1"), 16: np.dtype("<u2")}[bits]
    while True:
        chunks = (rest & ((1 << bits) - 1)).astype(kind)
        rest = rest >> bits
        more = rest > 0
        out.append(_level(chunks, more))
        rest = rest[more]
        if not len(rest):
            break
    return struct.pack("<BB", bits, len(out)) + b"".join(out)


class Codes:
    """Reads packed ids in place; ``get`` fetches any positions."""

    def __init__(self, data: bytes | memoryview):
        self.bits, n = struct.unpack_from("<BB", data)
        kind = {8: np.dtype("u1"), 16: np.dtype("<u2")}[self.bits]
        at, self.levels = 2, []
        for _ in range(n):
            (m,) = struct.unpack_from("<Q", data, at)
            at += 8
            words = -(-m // 64)
            parts = []
            for dtype, size in ((kind, m), (np.dtype("<u8"), words), (np.dtype("<u8"), -(-words // 8)), (np.dtype("<u2"), words)):
                parts.append(np.frombuffer(data, dtype=dtype, count=size, offset=at))
                at += dtype.itemsize * size
            self.levels.append(parts)
        self.size = len(self.levels[0][0])

    def __len__(self) -> int:
        return self.size

    def get(self, positions) -> np.ndarray:
        """Ids at ``positions`` (any order, repeats allowed)."""
        at = np.asarray(positions, dtype=np.int64)
        out = np.zeros(len(at), dtype=np.uint32)
        where = slice(None)
        for depth, (chunks, bits, supers, inside) in enumerate(self.levels):
            out[where] |= chunks[at].astype(np.uint32) << np.uint32(self.bits * depth)
            word, shift = at >> 6, (at & 63).astype(np.uint64)
            held = bits[word]
            goes = ((held >> shift) & np.uint64(1)).astype(bool)
            if not goes.any():
                break
            where = np.flatnonzero(goes) if isinstance(where, slice) else where[goes]
            word, low = word[goes], held[goes] & ((np.uint64(1) << shift[goes]) - np.uint64(1))
            at = supers[word >> 3].astype(np.int64) + inside[word] + np.bitwise_count(low)
        return out


def pack_file(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, bits: int = 8) -> bytes:
    known = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    keys = np.array([d or 0 for d in doc_ids], dtype="<i8")
    head = _HEAD.pack(MAGIC, 1, bits, 0, len(doc_ids), len(ids))
    body = keys.tobytes() + known.tobytes() + np.asarray(lengths, dtype="<u8").tobytes() + pack(ids, bits)
    return head + body + struct.pack("<I", zlib.crc32(head + body))


def open_file(data: bytes) -> tuple[list[int | None], np.ndarray, Codes]:
    """(doc ids, document lengths, codes) of a file; raises ValueError if it is damaged."""
    magic, version, _, _, n, _ = _HEAD.unpack_from(data)
    if magic != MAGIC or version != 1 or zlib.crc32(memoryview(data)[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError("not an undamaged code file")
    at = _HEAD.size
    keys = np.frombuffer(data, "<i8", n, at)
    known = np.frombuffer(data, "u1", n, at + 8 * n)
    lengths = np.frombuffer(data, "<u8", n, at + 9 * n).astype(np.int64)
    ids = [int(k) if ok else None for k, ok in zip(keys, known, strict=True)]
    return ids, lengths, Codes(memoryview(data)[at + 17 * n : -4])


def places_of(data: memoryview) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc ids, which of them are null, document lengths) of a file, from its head alone."""
    n = _HEAD.unpack_from(data)[4]
    at = _HEAD.size
    return np.frombuffer(data, "<i8", n, at), np.frombuffer(data, "u1", n, at + 8 * n) == 0, np.frombuffer(data, "<u8", n, at + 9 * n).astype(np.int64)


def codes_of(data: memoryview) -> Codes:
    """The codes of a file, in place: neither its directory nor its checksum is read."""
    return Codes(data[_HEAD.size + 17 * _HEAD.unpack_from(data)[4] : -4])


FILES = "part INT, file INT, before BIGINT, n_docs BIGINT, n_tokens BIGINT, content BINARY"


def write_codes(docs: DataFrame, path: str, tokenizer: str, cut: str | None, end_id: int, file_tokens: int = 1_000_000, bits: int = 8) -> None:
    """Encode every text (null: empty), append ``end_id``, and write code files in ascending doc_id order.

    Documents are range-partitioned by (doc_id, hash of the text), so a repeated doc_id is no hot
    partition; rows equal in both are equal. Null ids come first. A task holds one file
    (``file_tokens`` ids and at most one more document) at a time. ``path`` gets a Parquet table of
    files: part and file give the order, ``before`` the ids of the part's earlier files.
    """
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    d = d.repartitionByRange(*order).sortWithinPartitions(*order)

    def encode(batches):
        enc = tokens.encoder(tokenizer, cut)
        part = TaskContext.get().partitionId()
        end = np.array([end_id], dtype="<u4").tobytes()
        names = [f.split(" ")[0] for f in FILES.split(", ")]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        schema = pa.schema(list(zip(names, kinds, strict=True)))
        keys, held, count, before, no = [], [], 0, 0, 0

        def flush():
            ids = np.frombuffer(b"".join(held), dtype="<u4")
            content = pack_file(keys, [len(h) // 4 for h in held], ids, bits)
            row = [part, no, before, len(keys), len(ids), content]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], schema=schema)

        for batch in batches:
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = enc.encode(text) + end
                keys.append(key)
                held.append(ids)
                count += len(ids) // 4
                if count >= file_tokens:
                    yield flush()
                    keys, held, before, count, no = [], [], before + count, 0, no + 1
        if keys:
            yield flush()

    d.mapInArrow(encode, FILES).write.parquet(path)


def read_codes(spark, path: str) -> DataFrame:
    """One row per document from the files at ``path``, with the ids before it in the whole table.

    Files of a part carry their own offset, so only one total per part is summed in one task
    (as many rows as the write had tasks) and broadcast.
    """
    files = spark.read.schema(FILES).parquet(path)
    totals = files.groupBy("part").agg(F.max(F.col("before") + F.col("n_tokens")).alias("ids"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("offset"))
    placed = files.join(F.broadcast(offsets), "part").select((F.col("offset") + F.col("before")).alias("start"), "content")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def decode(batches):
        for batch in batches:
            for start, content in zip(batch.column("start").to_pylist(), batch.column("content"), strict=True):
                keys, lengths, codes = open_file(content.as_py())
                ends = np.cumsum(lengths)
                data = memoryview(codes.get(np.arange(len(codes))).astype("<u4").tobytes())
                crc = [zlib.crc32(data[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                cols = [pa.array(keys, pa.int64()), pa.array(start + ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return placed.mapInArrow(decode, "doc_id BIGINT, start BIGINT, n_tokens BIGINT, ids_crc32 BIGINT")


def directory(spark, path: str) -> DataFrame:
    """(doc_id, part, file, first, n_tokens): where each document of the files at ``path`` stands.

    Reads the heads of the files, no code. Store it to answer many look-ups.
    """
    out = "doc_id BIGINT, part INT, file INT, first BIGINT, n_tokens BIGINT"

    def run(batches):
        schema = common.arrow_schema(out)
        for batch in batches:
            for part, file, content in zip(batch.column("part").to_pylist(), batch.column("file").to_pylist(), batch.column("content"), strict=True):
                keys, unknown, lengths = places_of(memoryview(content.as_buffer()))
                where = [pa.array(np.full(len(keys), x, np.int32)) for x in (part, file)]
                cols = [pa.array(keys, mask=unknown), *where, pa.array(np.cumsum(lengths) - lengths), pa.array(lengths)]
                yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return spark.read.schema(FILES).parquet(path).select("part", "file", "content").mapInArrow(run, out)


def lookup(spark, path: str, wanted: DataFrame, places: DataFrame | None = None, chunk: int = 1 << 16) -> DataFrame:
    """(doc_id, position, token): the ids at ``wanted`` (doc_id, position), and no other id is decoded.

    ``places`` is a stored ``directory`` (None: read from the files). Repeated wishes are answered
    once. A doc_id with several documents is answered once for each; a null doc_id asks for those
    without id. An unknown doc_id, or a position that is null or outside its document, has a null
    token. Wishes meet their file in groups of at most ``chunk`` positions, each position once, so
    a file that all wishes go to is several rows and none grows with the wishes.
    """
    asked = wanted.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("position").cast("bigint").alias("position")).distinct()
    held = (directory(spark, path) if places is None else places).select(F.col("doc_id").alias("known"), "part", "file", "first", "n_tokens")
    here = F.col("doc_id").eqNullSafe(F.col("known")) & F.col("position").between(0, F.col("n_tokens") - 1)
    placed = asked.join(held, here, "left").select("doc_id", "position", "part", "file", (F.col("first") + F.col("position")).alias("at"))
    groups = placed.where("at IS NOT NULL").groupBy("part", "file", F.floor(F.col("at") / chunk).alias("chunk")).agg(F.collect_set("at").alias("ats"))
    files = spark.read.schema(FILES).parquet(path).select("part", "file", "content")
    out = "part INT, file INT, at BIGINT, token BIGINT"

    def fetch(batches):
        schema = common.arrow_schema(out)
        for batch in batches:
            for part, file, ats, content in zip(*(batch.column(c) for c in ("part", "file", "ats", "content")), strict=True):
                codes = codes_of(memoryview(content.as_buffer()))
                at = ats.values.to_numpy(zero_copy_only=False)
                cols = [pa.array(np.full(len(at), x.as_py(), np.int32)) for x in (part, file)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(at), pa.array(codes.get(at).astype(np.int64))], schema=schema)

    found = groups.join(files, ["part", "file"]).select("part", "file", "ats", "content").mapInArrow(fetch, out)
    return placed.join(found, ["part", "file", "at"], "left").select("doc_id", "position", "token")


def op4_direct_codes(spark, sf_dir: str) -> DataFrame:
    """Round trip of all documents through code files (see the contract columns in ``read_codes``)."""
    from rateflow.session import scratch_dir

    path = scratch_dir(spark, "direct-codes")
    write_codes(common.table(spark, sf_dir, "documents"), path, "word_bpe_49k.json", tokens.WORDS, 2)
    return read_codes(spark, path)
