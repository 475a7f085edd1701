"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rateflow.session import scratch_dir, ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One given table, read by Spark only (the folder may be in any store)."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to a new folder under the shared scratch folder and read it back.

    Cuts lineage: what follows reads files that survive the loss of an executor, and a costly
    Python pass runs once although several jobs use its result.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remainder(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as decimal text, modulo ``modulus`` (null id: null)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % modulus


def is_held_out(doc_id: str, modulus: int, value: int) -> Column:
    """True where the remainder is ``value``; a null id is never held out."""
    return F.coalesce(remainder(doc_id, modulus) == value, F.lit(False))


def utf8(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column as UTF-8 bytes, null as empty."""
    return [b or b"" for b in batch.column(name).cast(pa.binary()).to_pylist()]


def strings(batch: pa.RecordBatch, name: str) -> list[str]:
    return [s or "" for s in batch.column(name).to_pylist()]


def pieces(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 4 << 20, max_rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``max_bytes`` of ``column`` (one row at least)."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if i > start and (held + n > max_bytes or i - start >= max_rows):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


_KINDS = {"BIGINT": pa.int64(), "INT": pa.int32(), "DOUBLE": pa.float64(), "STRING": pa.string(), "BINARY": pa.binary(), "BOOLEAN": pa.bool_()}


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a flat DDL string (types as in ``_KINDS`` or ``ARRAY<...>`` of them)."""

    def kind(t: str) -> pa.DataType:
        return pa.list_(kind(t[6:-1])) if t.startswith("ARRAY<") else _KINDS[t]

    return pa.schema([(n, kind(t)) for n, t in (f.strip().split(" ", 1) for f in ddl.split(","))])


def per_batch(schema: str, names: list[str], fn: Callable[[pa.RecordBatch], dict[str, list]], max_bytes: int = 4 << 20):
    """A ``mapInArrow`` function: ``fn`` gets a bounded batch and returns the new columns.

    ``names`` are the input columns passed through unchanged, before the new ones.
    """
    out_schema = arrow_schema(schema)

    def run(batches):
        for batch in pieces(batches, "text", max_bytes):
            new = fn(batch)
            cols = [batch.column(f.name) if f.name in names else pa.array(new[f.name], f.type) for f in out_schema]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, out_schema, strict=True)], schema=out_schema)

    return run
