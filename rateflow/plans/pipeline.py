"""The per-message processor (F4) as one Spark plan: parse -> cut -> detect -> F2 -> explode.

``extract_rates(emails)`` is the flagship: from a table of messages with an html column to
``rate_rows``. Up to the explode there is one row per message and no shuffle; the Python
markup pass is the only non-JVM stage.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rateflow import dims
from rateflow.operators import rates
from rateflow.operators.markup import markup_pass, parse_html
from rateflow.operators.thread import cut_thread
from rateflow.sources.messages import PARSE_FAILED


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Deal rows over ``partitions`` (default: twice the cluster's cores), at the caller's choice.

    The MIME and markup passes cost CPU per message, so a few large input splits (one small
    file, one unsplittable archive) leave cores idle: spread such input *before* the first Python
    pass, while rows are raw. Inputs with a fair number of splits, the normal case at scale, need
    none of it; nothing here decides that by itself, as asking for the number of splits may run
    jobs. Round-robin, not by key: copies of one message (same key) may be a third of the input.
    Spark sorts rows before a round-robin repartition, so a retried task gets the same rows.
    """
    if df.isStreaming:
        return df
    if partitions is None:
        from rateflow.session import cores

        partitions = 2 * cores(df.sparkSession)
    return df.repartition(partitions)


def keep_where(df: DataFrame, condition, *cols) -> DataFrame:
    """``df.where(condition).select(*cols)`` for a condition derived from the array columns.

    A plain Filter on such a column is pushed below the projections with the whole
    higher-order expression chain inlined, so detection would run twice per message. A
    conditional one-element array fed to a generator selects the same rows and cannot be
    pushed down.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in cols]
    return df.select(F.inline(F.when(condition, F.array(F.struct(*cols)))))


def detect_rate_tables(
    emails: DataFrame,
    key: str = "message_id",
    html_col: str = "html",
    strict: bool = False,
    field_aliases=dims.FIELD_ALIASES,
    stopwords: Sequence[str] = dims.STOPWORDS,
    carry: Sequence[str] = (),
    th_as_td: bool = False,
) -> DataFrame:
    """One row per message with ``segments``, ``tables``, ``table_info``, ``rate_tables``,
    ``message_failed``; ``carry`` columns pass through. Only html is parsed (D5), only up to
    the newest message where provable, and table segments carry grids but not their html
    (use ``parse_html`` directly for full-document views).
    ``th_as_td`` reads ``<th>`` cells like ``<td>`` (off by default, as in the source)."""
    parsed = parse_html(
        emails.select(key, html_col, *carry),
        html_col,
        newest_only=True,
        th_as_td=th_as_td,
        keep_table_html=False,
    )
    return rates.detect(cut_thread(parsed, strict), field_aliases, stopwords)


def detect_in_mail(raw: DataFrame, key: str = "message_id", content_col: str = "content", carry: Sequence[str] = ()) -> DataFrame:
    """``detect_rate_tables`` of ``emails_from_raw`` with ``failed_content``, mail and markup read in one Python
    pass: neither the html nor the bytes of a refused message go to Python a second time.

    ``carry`` columns are those of ``raw``, of ``emails`` or ``failed_content``."""
    from rateflow.session import ship_package
    from rateflow.sources.messages import mail_pass

    ship_package(raw.sparkSession)
    read, emails = mail_pass(raw.schema, content_col, want_text=False, failed_col="failed_content", decode=True)
    names = [key, "html", *carry]
    parse, parsed = markup_pass(T.StructType([emails[n] for n in names]), newest_only=True, keep_table_html=False)

    def run(batches):
        return parse(batch.select(names) for batch in read(batches))

    return rates.detect(cut_thread(raw.mapInArrow(run, parsed)))


def rate_rows_from_detected(
    detected: DataFrame,
    key: str = "message_id",
    keywords: Sequence[tuple[str, str]] = dims.SERVICE_KEYWORDS,
    stopwords: Sequence[str] = dims.STOPWORDS,
    keep_col_order: bool = False,
) -> DataFrame:
    out = rates.normalise(rates.candidate_rows(detected, key), keywords, stopwords)
    return out if keep_col_order else out.drop("col_order")


def extract_rates(
    emails: DataFrame,
    key: str = "message_id",
    html_col: str = "html",
    strict: bool = False,
    field_aliases=dims.FIELD_ALIASES,
    keywords: Sequence[tuple[str, str]] = dims.SERVICE_KEYWORDS,
    stopwords: Sequence[str] = dims.STOPWORDS,
    keep_col_order: bool = False,
) -> DataFrame:
    """``rate_rows (key, table_idx, row_idx, name, rate, entry)`` of accepted messages.

    ``row_idx`` counts the data rows of each table from 1; ``table_idx`` numbers the top-level
    tables of the newest message from 0.
    """
    # only messages with a table start tag give rows: the others never cross to Python
    # (a plain filter would be pushed below the projection that decodes the html, which would then run twice)
    emails = keep_where(emails, F.col(html_col).rlike("(?i)<table"), key, html_col)
    parsed = parse_html(emails, html_col, newest_only=True, keep_table_html=False)
    detected = rates.detect_rows(cut_thread(parsed, strict), field_aliases, stopwords)
    return rate_rows_from_detected(detected, key, keywords, stopwords, keep_col_order)


# Log lines of the per-message processor ({n} = number of rate tables).
LOG_OK = "Успешно обработано <{n}> таблиц ставок."
LOG_FAILED = "ОШИБКА! Одну из таблиц ставок не удалось обработать. Письмо не будет обработано."
LOG_NOTHING_TO_EXPORT = "No rate tables were extracted."
# End of fixed values.


def process_log(
    detected: DataFrame, key: str = "message_id", batch_id: int | None = None, error_col: str | None = None
) -> DataFrame:
    """One row per message: tables found, status and detail (no shuffle).

    ``error_col`` names a carried MIME error: a message whose bytes could not be parsed gets the
    status ``mime_error``; other notes of that column do not change the status.
    """
    n_tables = F.when(F.col("rate_tables").isNull(), F.lit(0)).otherwise(F.size("rate_tables"))
    mime = F.col(error_col) if error_col else F.lit(None).cast("string")
    unreadable = F.coalesce(mime.startswith(PARSE_FAILED), F.lit(False))
    status = (
        F.when(unreadable, F.lit("mime_error"))
        .when(F.col("parse_error").isNotNull(), F.lit("parse_error"))
        .when(~F.col("has_html"), F.lit("no_html"))
        .when(F.col("message_failed"), F.lit("error"))
        .when(n_tables == 0, F.lit("no_tables"))
        .otherwise(F.lit("ok"))
    )
    ok_line = F.replace(F.lit(LOG_OK), F.lit("{n}"), n_tables.cast("string"))
    detail = (
        F.when(unreadable, mime)
        .when(F.col("parse_error").isNotNull(), F.col("parse_error"))
        .when(~F.col("has_html"), F.lit(LOG_NOTHING_TO_EXPORT))
        .when(F.col("message_failed"), F.concat_ws("\n", F.lit(LOG_FAILED), F.lit(LOG_NOTHING_TO_EXPORT)))
        .when(n_tables == 0, F.concat_ws("\n", ok_line, F.lit(LOG_NOTHING_TO_EXPORT)))
        .otherwise(ok_line)
    )
    return detected.select(
        key,
        F.lit(batch_id).cast("bigint").alias("batch_id"),
        F.when(F.col("message_failed"), F.lit(0)).otherwise(n_tables).cast("int").alias("n_tables"),
        status.alias("status"),
        detail.alias("detail"),
        F.current_timestamp().alias("processed_at"),
    )


def process_messages(
    raw: DataFrame, out_dir: str, account: str, run_id: str | None = None, key: str = "message_id", **options
) -> str:
    """Batch run over raw messages (``key``, ``content``): the same per-batch writer as the
    stream. Every call is a run of its own; pass the ``run_id`` it returned (or your own) to
    repeat a run that failed. ``options`` go to ``run_batch`` (``retry``, ``max_attempts``).
    Returns the run id."""
    import uuid

    from rateflow.streaming.stream import run_batch

    run_id = run_id or uuid.uuid4().hex
    run_batch(raw, 0, out_dir, account, run_id, key, **options)
    return run_id
