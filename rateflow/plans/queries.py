"""Registered queries: one per operator group of SURVEY §2 (keys of SURVEY §7).

Each takes ``(spark, sf_dir)``, reads the given tables (``orders``) and derives its input
from them with Spark, so the work grows with the data. Every query runs over the whole table.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rateflow import dims
from rateflow.functions import charset as cs
from rateflow.functions import text as tx
from rateflow.operators import rates, render, thread
from rateflow.operators.markup import parse_html
from rateflow.plans import pipeline
from rateflow.session import scratch_dir, ship_package
from rateflow.sinks import files, named_files
from rateflow.sources import messages, synth


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order keys, spread over the cores before any message is rendered (cheap rows)."""
    ship_package(spark)
    o = spark.read.parquet(os.path.join(sf_dir, "orders.parquet")).select(
        "o_orderkey", "o_custkey", "o_orderdate"
    )
    return pipeline.spread(o)


# ------------------------------------------------------------------------- row functions

def q_first_number(spark, sf_dir):
    c = synth.candidate_rows(_orders(spark, sf_dir))
    return c.select("message_id", "row_idx", tx.first_number("rate_raw").alias("rate"))


def q_entry_number(spark, sf_dir):
    c = synth.candidate_rows(_orders(spark, sf_dir))
    return c.select("message_id", "row_idx", tx.entry_number("entry_raw").alias("entry"))


def q_service_map(spark, sf_dir):
    c = synth.candidate_rows(_orders(spark, sf_dir))
    return c.select("message_id", "row_idx", tx.service_name("name_raw").alias("name"))


def q_service_map_dim(spark, sf_dir):
    c = synth.candidate_rows(_orders(spark, sf_dir)).select("message_id", "row_idx", "name_raw")
    return tx.with_services(c, "name_raw", dims.service_keyword_frame(spark)).drop("name_raw")


def q_stopword_filter(spark, sf_dir):
    c = synth.candidate_rows(_orders(spark, sf_dir))
    return c.where(tx.keeps_row("name_raw")).select("message_id", "row_idx", "name_raw")


def q_stopword_filter_dim(spark, sf_dir):
    """D3 with the stop-words as a table."""
    c = synth.candidate_rows(_orders(spark, sf_dir)).select("message_id", "row_idx", "name_raw")
    return tx.without_stopwords(c, "name_raw", dims.stopword_frame(spark))


def q_drop_unmapped(spark, sf_dir):
    c = synth.candidate_rows(_orders(spark, sf_dir))
    named = c.select("message_id", "row_idx", tx.service_name("name_raw").alias("name"))
    return named.where(F.col("name") != "")


# Header variants derived from the order key (FIXTURES.md §3 "Headers").
_HEADERS = [
    ["Наименование", "Ставка", "Вход"],
    ["Наименование услуги", "ставка", "вход"],
    ["\tСтавка", synth.NBSP + "Наименование услуги ", "ВхОд\n"],
    ["ВХОД", "Примечание", "Ставка", "Наименование"],
    ["Перевозка", "вход", "Ставка"],
    ["ставка", "ставка", "вход"],
    ["наименование", "наименование услуги", "ставка"],
    ["Наименование", None, "Вход"],
]


def _headers(spark, sf_dir):
    o = _orders(spark, sf_dir)
    variant = (F.col("o_orderkey") % len(_HEADERS)).cast("int")
    header = F.element_at(
        F.array(*[F.array(*[F.lit(h).cast("string") for h in hs]) for hs in _HEADERS]), variant + 1
    )
    return o.select(F.col("o_orderkey").alias("message_id"), header.alias("header"))


#: Fields beyond the rate table's: one of its own name, one that shares an alias with another field.
MORE_FIELDS = {"примечание": ["комментарий", "примечание"], "услуга": ["наименование услуги"]}


def q_header_match_dim(spark, sf_dir):
    """E2/D2 with five fields as an alias table, for headers of any width."""
    aliases = dims.field_alias_frame(spark, dims.FIELD_ALIASES | MORE_FIELDS)
    t = rates.consume_fields(_headers(spark, sf_dir), aliases)
    found = F.transform("found", lambda f: F.concat(f["field"], F.lit(":"), f["pos"].cast("string")))
    return t.select("message_id", F.array_join(found, ";").alias("found"), "is_rate_table")


def q_header_match(spark, sf_dir):
    t = _headers(spark, sf_dir)
    fields = rates.header_fields(F.col("header"))
    width = F.size("header")
    return t.select("message_id", width.alias("width"), rates.is_rate_header(fields, width).alias("is_rate_table"))


# --------------------------------------------------------------------- table transforms

def q_normalised_rates(spark, sf_dir):
    c = synth.candidate_rows(_orders(spark, sf_dir))
    return rates.normalise(c.select("message_id", "table_idx", "row_idx", "name_raw", "rate_raw", "entry_raw"))


def q_all_or_nothing(spark, sf_dir):
    """F2 on tables built from the order rows, with a ragged row (no entry cell) injected in
    row 2 of every 7th message: the message is rejected unless D3 drops that row."""
    n = synth.nested_rows(_orders(spark, sf_dir))
    k = F.col("message_id")
    header = F.array(*[F.lit(h) for h in ("Наименование", "Ставка", "Вход")])

    def cells(r):
        full = F.array(r["name_raw"], r["rate_raw"], r["entry_raw"])
        return F.when((k % 7 == 3) & (r["row_idx"] == 2), F.slice(full, 1, 2)).otherwise(full)

    def table(t):
        mine = F.filter("rows", lambda r: r["table_idx"] == t)
        return F.struct(t.alias("table_idx"), F.concat(F.array(header), F.transform(mine, cells)).alias("rows"))

    tables = F.filter(F.transform(F.array(F.lit(0), F.lit(1)), table), lambda t: F.size(t["rows"]) > 1)
    detected = rates.detect(n.select("message_id", tables.alias("tables")))
    out = rates.normalise(rates.candidate_rows(detected)).drop("col_order")
    return out.withColumn("row_idx", F.col("row_idx") + 3 * F.col("table_idx"))


def q_all_or_nothing_exploded(spark, sf_dir):
    """F2 for input that is already one row per cell row (same injected ragged rows)."""
    c = synth.candidate_rows(_orders(spark, sf_dir))
    k = F.col("message_id")
    c = c.withColumn("entry_raw", F.when((k % 7 == 3) & (F.col("row_idx") == 2), None).otherwise(F.col("entry_raw")))
    kept = rates.all_or_nothing_rows(c)
    return rates.normalise(kept.select("message_id", "table_idx", "row_idx", "name_raw", "rate_raw", "entry_raw"))


# ------------------------------------------------------------------------ html pipeline

def _html(spark, sf_dir):
    return synth.html_messages(_orders(spark, sf_dir))


def q_extract_rates(spark, sf_dir):
    return pipeline.extract_rates(_html(spark, sf_dir))


def q_table_headers(spark, sf_dir):
    """C8 + D1/D2 per top-level table of the newest message (``table_headers`` view)."""
    d = pipeline.detect_rate_tables(_html(spark, sf_dir))
    return rates.table_headers(d).select("message_id", "table_idx", "width", "n_rows", "is_rate_table")


def q_rate_table_count(spark, sf_dir):
    d = pipeline.detect_rate_tables(_html(spark, sf_dir))
    return pipeline.keep_where(d, ~F.col("message_failed"), "message_id", F.size("rate_tables").alias("n_tables"))


def q_html_cells_roundtrip(spark, sf_dir):
    d = pipeline.detect_rate_tables(_html(spark, sf_dir))
    c = rates.candidate_rows(d, accepted_only=False)
    return c.select("message_id", "table_idx", "row_idx", "name_raw", "rate_raw", "entry_raw")


def q_thread_cut(spark, sf_dir):
    p = thread.cut_thread(parse_html(_html(spark, sf_dir)))
    return p.select(
        "message_id",
        F.size(F.filter("segments", lambda s: s["kind"] == "table")).alias("n_tables_total"),
        F.size("tables").alias("n_tables_newest"),
    )


def q_thread_parts(spark, sf_dir):
    """C4: number of parts of each thread (split at every quoted-reply header, tables masked)."""
    p = parse_html(_html(spark, sf_dir))
    parts = thread.thread_parts(thread.masked_html(F.col("segments")))
    return p.select("message_id", F.size(parts).alias("n_parts"))


def q_table_cells(spark, sf_dir):
    """C1 + C7 long form: every cell of every top-level table (header rows, decoy and quoted
    tables included), ``row_idx`` 0 = first row."""
    from rateflow.operators.markup import table_cells

    return table_cells(parse_html(_html(spark, sf_dir)))


def q_restore_html(spark, sf_dir):
    p = parse_html(_html(spark, sf_dir))
    restored = thread.restore_html(F.col("segments"))
    return p.select(
        "message_id", F.md5(restored).alias("restored_md5"), F.length(restored).cast("bigint").alias("restored_len")
    )


def q_html_reply(spark, sf_dir):
    o = _orders(spark, sf_dir)
    n = synth.nested_rows(o)
    emails = n.select(
        "message_id",
        synth.html_column(F.col("message_id"), F.col("o_custkey"), F.col("rows")).alias("html"),
        F.concat(F.lit("client"), F.col("o_custkey").cast("string"), F.lit("@example.com")).alias("sender_address"),
    )
    d = pipeline.detect_rate_tables(emails, carry=["sender_address"])
    return render.outbox(d, account="rates@example.com")


def q_table_csv(spark, sf_dir):
    """G1 file content per accepted rate table (what ``write_table_csv_files`` writes)."""
    d = pipeline.detect_rate_tables(_html(spark, sf_dir))
    t = pipeline.keep_where(d, ~F.col("message_failed"), "message_id", "rate_tables")
    t = t.select("message_id", F.explode("rate_tables").alias("t"))
    csv = F.concat(F.array_join(render.table_csv_lines(F.col("t")), "\n"), F.lit("\n"))
    return t.select("message_id", F.col("t.table_idx").alias("table_idx"), csv.alias("csv"))


def q_rate_table_status(spark, sf_dir):
    d = pipeline.detect_rate_tables(_html(spark, sf_dir))
    return rates.message_status(d).select("message_id", "table_idx", "n_rows", "table_failed", "message_failed")


def q_process_log(spark, sf_dir):
    """G6 with every status of readable mail: no html, no tables, a ragged rate table, fine."""
    h = _html(spark, sf_dir)
    k = F.col("message_id") % 11
    ragged = F.lit("<table><tr><td>Наименование</td><td>Ставка</td><td>Вход</td></tr><tr><td>Фрахт</td><td>1</td></tr></table>")
    html = F.when(k == 1, F.lit("<p>no tables</p>")).when(k == 2, F.concat(ragged, F.col("html"))).when(k != 0, F.col("html"))
    h = h.withColumn("html", html)
    d = pipeline.detect_rate_tables(h)
    return pipeline.process_log(d).select("message_id", "n_tables", "status")


# ------------------------------------------------------------------------------ sources

def q_unseen_messages(spark, sf_dir):
    o = _orders(spark, sf_dir)
    msgs = o.select(F.col("o_orderkey").alias("message_id"))
    ledger = o.where(F.col("o_orderdate") < F.lit("1995-01-01").cast("timestamp_ntz")).select(
        F.col("o_orderkey").alias("message_id"), F.lit(0).cast("bigint").alias("batch_id")
    )
    return messages.unseen(msgs, ledger)


def q_mime_project(spark, sf_dir):
    raw = synth.mime_messages(_orders(spark, sf_dir))
    e = messages.emails_from_raw(raw)
    return e.select(
        "message_id", "subject", "sender", "sender_address", "date_raw",
        F.md5("text").alias("text_md5"), F.md5("html").alias("html_md5"),
    )


def q_mail_rates(spark, sf_dir):
    """Entry 1 lifecycle in batch: RFC 822 bytes -> emails -> rate rows (no html: no rows)."""
    emails = messages.emails_from_raw(synth.mime_messages(_orders(spark, sf_dir)), want_text=False)
    return pipeline.extract_rates(emails)


def q_structured_rates(spark, sf_dir):
    """Entries 2/3 lifecycle: structured messages -> emails -> rate rows."""
    emails = messages.from_structured(synth.structured_messages(_orders(spark, sf_dir)))
    return pipeline.extract_rates(emails)


def q_charset_cascade(spark, sf_dir):
    o = _orders(spark, sf_dir)
    k = F.col("o_orderkey")
    ru = F.concat(F.lit("Заявка "), k.cast("string"), F.lit(": фрахт, НДС 20%"))
    latin = F.concat(F.lit("Commande "), k.cast("string"), F.lit(" \u0098 prix é"))
    body = (
        F.when(k % 3 == 0, F.encode(ru, "UTF-8"))
        .when(k % 3 == 1, cs.encode_cp1251(ru))
        .otherwise(F.encode(latin, "ISO-8859-1"))
    )
    b = o.select(k.alias("message_id"), body.alias("body"))
    return b.select("message_id", cs.decode_cascade(F.col("body")).alias("text"),
                    cs.detected_charset(F.col("body")).alias("charset"))


def q_charset_evidence(spark, sf_dir):
    """B8 by evidence: mail without a usable charset name in six charsets."""
    k = F.col("o_orderkey")
    ru = F.concat(F.lit("Заявка "), k.cast("string"), F.lit(": ставка за фрахт и перевозку, НДС 20%"))
    fr = F.concat(F.lit("Commande "), k.cast("string"), F.lit(" : prix révisé, délai à préciser"))
    bodies = [
        F.encode(ru, "UTF-8"), cs.encode_as(ru, "windows-1251"), cs.encode_as(F.upper(ru), "koi8-r"),
        cs.encode_as(ru, "ibm866"), cs.encode_as(ru, "iso-8859-5"), F.encode(fr, "ISO-8859-1"),
        cs.encode_as(F.concat(fr, F.lit(" – 5 €")), "windows-1252"), cs.encode_as(ru, "koi8-r"),
    ]
    body = F.get(F.array(*bodies), (k % len(bodies)).cast("int"))
    b = _orders(spark, sf_dir).select(k.alias("message_id"), body.alias("body"))
    return b.select("message_id", cs.decode_by_evidence(F.col("body")).alias("text"),
                    cs.charset_by_evidence(F.col("body")).alias("charset"))


def q_structured_project(spark, sf_dir):
    s = synth.structured_messages(_orders(spark, sf_dir))
    e = messages.from_structured(s)
    return e.select(
        "message_id", "subject", "sender", "sender_address", "date_raw", "text", F.md5("html").alias("html_md5")
    )


# -------------------------------------------------------------------------------- sinks

def _roundtrip(spark, sf_dir, fmt):
    rows = pipeline.extract_rates(_html(spark, sf_dir))
    path = scratch_dir(spark, f"rates-{fmt}")
    files.write_rate_tables(rows, path, fmt=fmt)
    return files.read_rate_tables(spark, path, fmt=fmt)


def q_csv_roundtrip(spark, sf_dir):
    return _roundtrip(spark, sf_dir, "csv")


def q_xml_roundtrip(spark, sf_dir):
    return _roundtrip(spark, sf_dir, "xml")


def q_table_files(spark, sf_dir):
    """One file ``{stem}_{i}`` per rate table, read back. Every third message's path has the
    same stem; odd messages ask for XML."""
    k = F.col("message_id")
    h = _html(spark, sf_dir)
    name = F.when(k % 3 == 0, F.concat(F.lit("mail."), k.cast("string"), F.lit(".eml"))).when(
        k % 3 == 1, F.concat(k.cast("string"), F.lit(".msg"))).otherwise(F.lit("mail.msg"))
    h = h.withColumn("stem", tx.source_stem(F.concat(F.lit("/landing/box."), (k % 7).cast("string"), F.lit("/"), name)))
    d = pipeline.detect_rate_tables(named_files.unique_stems(h, "stem"), carry=["stem"])
    fmt = F.when(k % 2 == 0, F.lit("csv")).otherwise(F.lit("xml"))
    path = scratch_dir(spark, "table-files")
    report = named_files.write_named_files(named_files.rate_table_files(d, F.col("stem"), fmt), path, f"{path}-report")
    return named_files.read_named_files(report, path)


def q_stream_rates(spark, sf_dir):
    from rateflow.streaming.stream import run_available_now

    raw = synth.mime_messages(_orders(spark, sf_dir))
    landing = scratch_dir(spark, "landing")
    raw.write.mode("overwrite").parquet(landing)
    out = scratch_dir(spark, "stream-out")
    run_available_now(spark, landing, out, scratch_dir(spark, "stream-ckpt"), source_format="parquet")
    return spark.read.parquet(out).select("message_id", "table_idx", "row_idx", "name", "rate", "entry")


# ------------------------------------------------------- single operators and the lifecycle

def q_after_last_equal(spark, sf_dir):
    """E4 on the raw entry cells."""
    c = synth.candidate_rows(_orders(spark, sf_dir))
    return c.select("message_id", "row_idx", tx.after_last_equal("entry_raw").alias("formula"))


def q_source_stem(spark, sf_dir):
    """E8 on message paths derived from the order key (dots inside the name, no extension)."""
    k = F.col("o_orderkey")
    name = F.concat(F.lit("mail."), k.cast("string"), F.when(k % 3 == 0, F.lit(".eml")).when(k % 3 == 1, F.lit(".msg")).otherwise(F.lit("")))
    path = F.concat(F.lit("/landing/box."), (k % 7).cast("string"), F.lit("/"), name)
    return _orders(spark, sf_dir).select(k.alias("message_id"), tx.source_stem(path).alias("stem"))


def q_number_rendering(spark, sf_dir):
    """F5/G1 number text over magnitudes from 1e-300 to 1e300 and many decimals."""
    k = F.col("o_orderkey").cast("double")
    power = F.element_at(F.array(*[F.lit(p) for p in NUMBER_POWERS]), (F.col("o_orderkey") % len(NUMBER_POWERS) + 1).cast("int"))
    values = _orders(spark, sf_dir).select(F.col("o_orderkey").alias("message_id"), (k / 7.0 * power).alias("value"))
    return values.select("message_id", tx.render_number("value").alias("text"))


#: Factors of the numbers above.
NUMBER_POWERS = [1.0, 1e-3, 1e-5, 1e-12, 1e-300, 1e5, 1e11, 1e16, 1e100, 1e295, -1.0, -1e-7]


def q_new_message_count(spark, sf_dir):
    """number of messages that no batch has processed."""
    return q_unseen_messages(spark, sf_dir).agg(F.count("*").alias("n_new"))


def q_table_xml(spark, sf_dir):
    """G2 file content per accepted rate table (what ``write_table_xml_files`` writes)."""
    d = pipeline.detect_rate_tables(_html(spark, sf_dir))
    t = pipeline.keep_where(d, ~F.col("message_failed"), "message_id", "rate_tables")
    t = t.select("message_id", F.explode("rate_tables").alias("t"))
    xml = F.concat(F.array_join(render.table_xml_lines(F.col("t")), "\n"), F.lit("\n"))
    return t.select("message_id", F.col("t.table_idx").alias("table_idx"), xml.alias("xml"))


def q_reply_no_tables(spark, sf_dir):
    """Html messages without tables still get a reply, with an empty body and a subject."""
    o = _orders(spark, sf_dir)
    k = F.col("o_orderkey")
    html = F.when(k % 3 == 0, F.lit("<p>no tables</p>")).when(k % 3 == 1, F.lit(""))
    emails = o.select(k.alias("message_id"), html.alias("html"), F.when(k % 2 == 0, F.lit("a@example.com")).alias("sender_address"))
    d = pipeline.detect_rate_tables(emails, carry=["sender_address"])
    return render.outbox(d, account="rates@example.com")


def _with_unreadable(raw):
    """Every 13th message becomes bytes that the parser refuses (nested far too deep)."""
    deep = F.repeat(F.lit("Content-Type: message/rfc822\r\n\r\n"), 2000).cast("binary")
    return raw.withColumn("content", F.when(F.col("message_id") % 13 == 5, deep).otherwise(F.col("content")))


def q_quarantine(spark, sf_dir):
    """Unreadable messages are set apart, the others go on."""
    emails = messages.emails_from_raw(_with_unreadable(synth.mime_messages(_orders(spark, sf_dir))))
    return messages.quarantine(emails).select("message_id", "stage")


def q_batch_lifecycle(spark, sf_dir):
    """Every output of two sweeps, the second with old and new mail.

    The first sweep gets the even orders, the second all of them, some twice. Per message: its
    rate rows, log status, replies, ledger rows and quarantine rows.
    """
    raw = _with_unreadable(synth.mime_messages(_orders(spark, sf_dir)))
    out = scratch_dir(spark, "lifecycle")
    pipeline.process_messages(raw.where("message_id % 2 = 0"), out, "rates@example.com", "first")
    again = raw.unionByName(raw.where("message_id % 5 = 1"))
    pipeline.process_messages(again, out, "rates@example.com", "second")

    def count(table, name):
        rows = spark.read.parquet(f"{out}/{table}").groupBy("message_id")
        return rows.agg(F.count("*").alias(name), F.max("run_id").alias(f"{name}_run")).drop(*([] if name == "n_log" else [f"{name}_run"]))

    logs = spark.read.parquet(f"{out}/process_log").groupBy("message_id").agg(
        F.count("*").alias("n_log"), F.max("run_id").alias("run_id"), F.max("status").alias("status")
    )
    for table in ("rate_rows", "outbox", "ledger", "quarantine"):
        logs = logs.join(count(table, f"n_{table}"), "message_id", "left")
    return logs.na.fill(0)


def q_html_table_function(spark, sf_dir):
    """The SQL table function over message html, laterally joined."""
    from rateflow.operators.markup import register_udtfs

    register_udtfs(spark)
    _html(spark, sf_dir).select("message_id", "html").createOrReplaceTempView("rateflow_html")
    return spark.sql("SELECT message_id, c.table_idx, c.row_idx, c.col_idx, c.text FROM rateflow_html, LATERAL html_table_cells(html) c")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "extract_rates": q_extract_rates,
    "normalised_rates": q_normalised_rates,
    "first_number": q_first_number,
    "entry_number": q_entry_number,
    "service_map": q_service_map,
    "service_map_dim": q_service_map_dim,
    "stopword_filter": q_stopword_filter,
    "drop_unmapped": q_drop_unmapped,
    "header_match": q_header_match,
    "all_or_nothing": q_all_or_nothing,
    "all_or_nothing_exploded": q_all_or_nothing_exploded,
    "table_headers": q_table_headers,
    "rate_table_count": q_rate_table_count,
    "html_cells_roundtrip": q_html_cells_roundtrip,
    "thread_cut": q_thread_cut,
    "thread_parts": q_thread_parts,
    "table_cells": q_table_cells,
    "restore_html": q_restore_html,
    "html_reply": q_html_reply,
    "table_csv": q_table_csv,
    "rate_table_status": q_rate_table_status,
    "unseen_messages": q_unseen_messages,
    "process_log": q_process_log,
    "mime_project": q_mime_project,
    "charset_cascade": q_charset_cascade,
    "mail_rates": q_mail_rates,
    "structured_rates": q_structured_rates,
    "structured_project": q_structured_project,
    "csv_roundtrip": q_csv_roundtrip,
    "xml_roundtrip": q_xml_roundtrip,
    "stream_rates": q_stream_rates,
    "after_last_equal": q_after_last_equal,
    "source_stem": q_source_stem,
    "number_rendering": q_number_rendering,
    "new_message_count": q_new_message_count,
    "table_xml": q_table_xml,
    "reply_no_tables": q_reply_no_tables,
    "quarantine": q_quarantine,
    "batch_lifecycle": q_batch_lifecycle,
    "html_table_function": q_html_table_function,
    "header_match_dim": q_header_match_dim,
    "charset_evidence": q_charset_evidence,
    "table_files": q_table_files,
    "stopword_filter_dim": q_stopword_filter_dim,
}
