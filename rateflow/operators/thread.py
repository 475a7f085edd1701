"""Thread cut (C2-C6) as native array/string expressions on the parsed row.

The tables are masked by a deterministic placeholder so a quoted-reply header can only match
in the text between tables; the newest message is the text before the first header, and its
tables are the top-level tables whose placeholder lies in it. No second parse, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rateflow.functions.text import let
from rateflow.operators.markup import SEGMENTS_TYPE

# The quoted-reply header, English or Russian, on consecutive lines
# (sent / to / optional cc / subject), matched case-insensitively per line.
REPLY_HEADER_EN = r"(?:.*sent:.*$\s)(?:.*to:.*$\s)(?:.*cc:.*$\s)?(?:.*subject:.*$)"
REPLY_HEADER_RU = r"(?:.*отправлено:.*$\s)(?:.*кому:.*$\s)(?:.*копия:.*$\s)?(?:.*тема:.*$)"
# End of fixed values.

# Java flags: i+U = Unicode case folding and classes, m = per-line anchors, d = only '\n'
# ends a line (so '.' also takes '\r', as Python's '.' does on CRLF text).
_FLAGS = "(?imdU)"
# Anchored: every alternative ends at a line end, so a match always starts at a line start, and
# the anchor avoids retrying '.*' at every character of long minified lines.
REPLY_SPLIT = _FLAGS + "^(?:" + REPLY_HEADER_EN + "|" + REPLY_HEADER_RU + ")"

MARK = "\u0001"


def placeholder(table_idx: Column) -> Column:
    """``\\n\\x01T<idx>\\x01\\n`` (deterministic, unlike a random id, so retries agree)."""
    return F.concat(F.lit("\n" + MARK + "T"), table_idx.cast("string"), F.lit(MARK + "\n"))


def masked_html(segments: Column) -> Column:
    """Text with every top-level table replaced by its placeholder."""
    return F.array_join(
        F.transform(
            segments,
            lambda s: F.when(s["kind"] == "table", placeholder(s["table_idx"])).otherwise(
                F.replace(s["html"], F.lit(MARK), F.lit(""))
            ),
        ),
        "",
    )


def restore_html(segments: Column) -> Column:
    """The html with each table back in place, framed by newlines as after masking."""
    return F.array_join(
        F.transform(
            segments,
            lambda s: F.when(
                s["kind"] == "table", F.concat(F.lit("\n"), s["html"], F.lit("\n"))
            ).otherwise(s["html"]),
        ),
        "",
    )


def _may_have_header(masked: Column) -> Column:
    """True for every text that has a quoted-reply header (and some others): without the first word of
    one the pattern, which goes back over each line twice, need not be tried."""
    upper = F.upper(masked)  # every letter that (?iU) takes for one of these has it as its upper case
    return let(upper, lambda u: u.contains("SENT:") | u.contains("ОТПРАВЛЕНО:"))


def thread_parts(masked: Column) -> Column:
    """C4: all parts of the thread split at quoted-reply headers."""
    return let(masked, lambda m: F.when(~_may_have_header(m), F.array(m)).otherwise(F.split(m, REPLY_SPLIT)))


def newest_part(masked: Column) -> Column:
    """The newest message = text before the first quoted-reply header."""
    return let(
        masked, lambda m: F.when(~_may_have_header(m), m).otherwise(F.element_at(F.split(m, REPLY_SPLIT, 2), 1))
    )


def count_placeholders(text: Column) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(MARK), F.lit("")))) / 2).cast("int")


def newest_tables(segments: Column, newest: Column, strict: bool = False) -> Column:
    """Top-level tables of the newest message, in document order.

    A table without any row cannot be read; by default only that table is skipped, with
    ``strict=True`` the message keeps no tables at all (the source's behaviour).
    """
    # tables are numbered in order: the first ones, as many as there are placeholders (counted once)
    tables = F.slice(F.filter(segments, lambda s: s["kind"] == "table"), F.lit(1), count_placeholders(newest))
    if strict:
        return F.when(
            F.exists(tables, lambda t: F.size(t["rows"]) == 0), F.array().cast(SEGMENTS_TYPE)
        ).otherwise(tables)
    return F.filter(tables, lambda t: F.size(t["rows"]) > 0)


def cut_thread(parsed: DataFrame, strict: bool = False) -> DataFrame:
    """Adds ``newest`` (masked newest message) and ``tables`` (its readable top-level tables)."""
    return parsed.withColumn("newest", newest_part(masked_html(F.col("segments")))).withColumn(
        "tables", newest_tables(F.col("segments"), F.col("newest"), strict)
    )
