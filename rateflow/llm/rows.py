"""Add columns computed from texts in Python while every given column passes through unchanged."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from rateflow.llm import common


def annotate(df: DataFrame, inputs: dict[str, Column], ddl: str, fn: Callable[[pa.RecordBatch], dict], max_bytes: int = 4 << 20) -> DataFrame:
    """(row STRUCT<all columns of df>, new columns): ``fn`` sees batches of ``inputs`` only.

    ``inputs`` names a column "text". The given row is one struct, so its names may clash with
    anything; ``row.*`` restores it.
    """
    kept = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[c.alias(n) for n, c in inputs.items()])
    schema = StructType([StructField("row", kept.schema["row"].dataType), *_parse_datatype_string(ddl).fields])
    new = common.arrow_schema(ddl)

    def run(batches):
        for batch in common.pieces(batches, "text", max_bytes):
            made = fn(batch)
            cols = [batch.column("row"), *(pa.array(made[f.name], f.type) for f in new)]
            yield pa.RecordBatch.from_arrays(cols, names=["row", *new.names])

    return kept.mapInArrow(run, schema)


def sample(df: DataFrame, limit: int, seed: int = 7) -> DataFrame:
    """About ``limit`` rows at most, chosen by a hash of doc_id (the same rows on every run).

    A threshold on the hash keeps the text of other rows from being touched; the exact bound is
    the ``limit`` smallest hashes.
    """
    n = df.count()
    h = F.xxhash64("doc_id", F.lit(seed))
    if n > limit:
        share = 1.2 * limit / n
        df = df.where(F.pmod(h, F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    return df.orderBy(F.pmod(h, F.lit(1 << 20)), h).limit(limit)
