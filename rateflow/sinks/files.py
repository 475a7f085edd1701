"""Sinks (G1-G4, G6, A8): rate tables as CSV / XML, the process log and the ledger.

Two layouts:
  * ``dataset`` (default, for scale): one dataset keyed by ``message_id, table_idx, row_idx``;
    files are sized by Spark, optionally partitioned by a low-cardinality column (batch).
  * ``per_table``: one directory per ``message_id/table_idx`` holding that table's rows in
    canonical column order, like one file per table. Directory count grows with the number
    of tables, so it is meant for small batches (one mailbox sweep), not bulk loads.
Values are written as strings rendered like pandas (``35.0``, ``10000000.0``; null -> empty).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rateflow import dims
from rateflow.functions.text import render_number

FORMATS = ("csv", "xml")


def _rendered(rate_rows: DataFrame, key: str) -> DataFrame:
    return rate_rows.select(
        key,
        "table_idx",
        "row_idx",
        F.col("name").alias(dims.NAME),
        render_number("rate").alias(dims.RATE),
        render_number("entry").alias(dims.ENTRY),
    )


def write_rate_tables(
    rate_rows: DataFrame,
    path: str,
    fmt: str = "csv",
    layout: str = "dataset",
    key: str = "message_id",
    mode: str = "overwrite",
    partition_by: list[str] | None = None,
) -> None:
    """G1/G2 (+G3: messages without rate rows write nothing; G4: Spark creates folders)."""
    fmt = fmt.lower()
    if fmt not in FORMATS:
        raise ValueError(f"unknown export format {fmt!r}; expected one of {FORMATS}")
    out = _rendered(rate_rows, key)
    if layout == "per_table":
        writer = (
            out.sortWithinPartitions(key, "table_idx", "row_idx")
            .drop("row_idx")
            .write.mode(mode)
            .partitionBy(key, "table_idx")
        )
    elif layout == "dataset":
        writer = out.write.mode(mode)
        if partition_by:
            writer = writer.partitionBy(*partition_by)
    else:
        raise ValueError(f"unknown layout {layout!r}")
    if fmt == "csv":
        writer.option("header", True).option("encoding", "UTF-8").option("nullValue", "").option(
            "emptyValue", ""
        ).csv(path)
    else:
        writer.format("xml").option("rootTag", "data").option("rowTag", "row").option(
            "nullValue", ""
        ).save(path)


def read_rate_tables(
    spark, path: str, fmt: str = "csv", key: str = "message_id", key_type: str = "BIGINT"
) -> DataFrame:
    """Read a ``dataset`` export back as typed ``rate_rows`` (``key_type``: STRING for path keys)."""
    cols = (
        f"`{key}` {key_type}, table_idx INT, row_idx INT, "
        f"`{dims.NAME}` STRING, `{dims.RATE}` STRING, `{dims.ENTRY}` STRING"
    )
    if fmt == "csv":
        df = spark.read.schema(cols).option("header", True).option("encoding", "UTF-8").csv(path)
    else:
        df = spark.read.format("xml").option("rowTag", "row").schema(cols).load(path)
    return df.select(
        key,
        "table_idx",
        "row_idx",
        F.col(dims.NAME).alias("name"),
        F.nullif(F.col(dims.RATE), F.lit("")).cast("double").alias("rate"),
        F.nullif(F.col(dims.ENTRY), F.lit("")).cast("double").alias("entry"),
    )


def write_process_log(log: DataFrame, path: str, mode: str = "append") -> None:
    """The process log as a table, partitioned by batch."""
    log.write.mode(mode).partitionBy("batch_id").parquet(path)


def _write_table_files(detected, path, key, mode, lines_of) -> None:
    """One folder per ``key/table_idx`` with the lines that ``lines_of`` renders for its table.

    Lines are rendered inside the message row and exploded with their index; the write keeps
    that order (the required sort by folder is a prefix of it). Only accepted messages (F2)
    write files. Directory count grows with the number of tables: meant for small sweeps.
    """
    from rateflow.plans.pipeline import keep_where

    accepted = keep_where(detected, ~F.col("message_failed"), key, "rate_tables")
    tables = accepted.select(key, F.explode("rate_tables").alias("t"))
    lines = tables.select(
        key, F.col("t.table_idx").alias("table_idx"), F.posexplode(lines_of(F.col("t"))).alias("line_idx", "value")
    )
    (
        lines.sortWithinPartitions(key, "table_idx", "line_idx")
        .drop("line_idx")
        .write.mode(mode)
        .partitionBy(key, "table_idx")
        .text(path)
    )


def write_table_csv_files(detected: DataFrame, path: str, key: str = "message_id", mode: str = "overwrite",
                          keywords=dims.SERVICE_KEYWORDS, stopwords=dims.STOPWORDS) -> None:
    """G1 with the source's file content: each table's CSV in its own source column order
    (header line, rows, pandas number format)."""
    from rateflow.operators.render import table_csv_lines

    _write_table_files(detected, path, key, mode, lambda t: table_csv_lines(t, keywords, stopwords))


def write_table_xml_files(detected: DataFrame, path: str, key: str = "message_id", mode: str = "overwrite",
                          keywords=dims.SERVICE_KEYWORDS, stopwords=dims.STOPWORDS) -> None:
    """G2 with the source's file content: each table's XML in its own source column order; the
    keys stand in the path only."""
    from rateflow.operators.render import table_xml_lines

    _write_table_files(detected, path, key, mode, lambda t: table_xml_lines(t, keywords, stopwords))
