"""Rate-table detection and normalisation.

Per message the tables stay an array inside the row until the all-or-nothing decision (F2) is
made, so that decision needs no shuffle and works on a stream; only then are rows exploded,
and the row-level functions (E3, E5, E6, D3, D4) run as codegen'd column expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rateflow import dims
from rateflow.functions import text as tx


def _alias_lookup(key: Column, field_aliases) -> Column:
    # one map lookup: the key expression is evaluated once (lambdas get no CSE)
    pairs = [F.lit(x) for kv in dims.alias_map(field_aliases).items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def header_fields(header: Column, field_aliases=dims.FIELD_ALIASES) -> Column:
    """E1 + E2: canonical field of each header name (null when the name is no alias)."""
    return F.transform(header, lambda h: _alias_lookup(tx.header_key(h), field_aliases))


def is_rate_header(fields: Column, width: Column, field_aliases=dims.FIELD_ALIASES) -> Column:
    """D1 + D2: width equals the number of fields and every field is named exactly once.

    Matching each field with its first present alias and requiring that nothing is left over
    is the same as: the canonical names of the header are a permutation of the fields, that is,
    as many names as fields and every field among them.
    """
    wanted = sorted(field_aliases)
    rate = (width == len(wanted)) & (F.size(fields) == len(wanted))
    for w in wanted:
        rate = rate & F.array_contains(fields, w)
    return F.coalesce(rate, F.lit(False))


def unpacked(array: Column) -> Column:
    """``explode`` of a derived array. For a plain column Spark adds a filter on the array's size, pushes
    it below the projections with the whole expression inlined, and so evaluates it twice and more."""
    return F.explode(F.when(array.isNotNull(), array))


def consume_fields(headers: DataFrame, aliases: DataFrame, width: int | None = None, header: str = "header") -> DataFrame:
    """E2 + D1/D2 with the aliases as a table (``alias, field, prio, field_no``) of any size.

    In the order of ``field_no`` every field takes the first of its aliases, by ``prio``, that a header
    cell not taken before has (the leftmost such cell). Adds ``found``, an array of (field, pos) by
    field, and ``is_rate_table``: no cell is left over and, unless ``width`` is None, the header has
    that many cells. Null cells are always left over; null headers give null and false, null or empty
    aliases match nothing, equal alias rows count once.

    Headers repeat from message to message, so the distinct ones are taken apart, matched by an
    equi-join on the header name and put together again; nothing is collected to the driver.
    """
    known = aliases.where("alias <> ''").select(tx.header_key("alias").alias("__alias"), "field_no", "prio", "field").distinct()
    distinct = headers.where(F.col(header).isNotNull()).select(F.col(header).alias("__header")).distinct()
    cells = distinct.select("__header", F.posexplode("__header").alias("pos", "cell"))
    named = cells.where("cell IS NOT NULL").select("__header", "pos", tx.header_key("cell").alias("__alias"))
    hits = named.join(known, "__alias").groupBy("__header").agg(
        F.sort_array(F.collect_list(F.struct("field_no", "prio", "pos", "field"))).alias("hits")
    )

    def take(taken: Column, hit: Column) -> Column:
        spent = F.exists(taken, lambda t: (t["field"] == hit["field"]) | (t["pos"] == hit["pos"]))
        return F.when(spent, taken).otherwise(F.concat(taken, F.array(F.struct(hit["field"].alias("field"), hit["pos"].alias("pos")))))

    nothing = F.array().cast("array<struct<field:string,pos:int>>")
    matched = hits.select("__header", F.aggregate("hits", nothing, take).alias("found"))
    cols = [c for c in headers.columns if c not in ("found", "is_rate_table")]
    joined = headers.select(*cols).join(matched, F.col(header) == F.col("__header"), "left").drop("__header")
    found = F.when(F.col(header).isNotNull(), F.coalesce("found", nothing))
    fits = F.lit(True) if width is None else F.size(header) == width
    return joined.select(
        *cols, found.alias("found"), F.coalesce((F.size(found) == F.size(header)) & fits, F.lit(False)).alias("is_rate_table")
    )


def _position(fields: Column, field: str) -> Column:
    return (F.array_position(fields, field) - 1).cast("int")


def describe_tables(tables: Column, field_aliases=dims.FIELD_ALIASES) -> Column:
    """C8 + D1/D2 per table: header = first row, width = longest row, data rows after it.

    Built in stages (one ``transform`` each) because lambdas get no common-subexpression
    elimination: every value is computed once and read back from the struct.
    """

    def shape(t):
        rows = t["rows"]
        width = F.coalesce(F.array_max(F.transform(rows, lambda r: F.size(r))), F.lit(0))
        return F.struct(
            t["table_idx"].alias("table_idx"),
            rows.alias("rows"),
            width.alias("width"),
        )

    def header(t):
        # a short header row is padded with nulls up to the width
        first = F.get(t["rows"], 0)
        padded = F.when(F.size(first) == t["width"], first).when(
            t["width"] > 0, F.transform(F.sequence(F.lit(0), t["width"] - 1), lambda i: F.get(first, i))
        ).otherwise(F.array().cast("array<string>"))
        return F.struct(
            t["table_idx"].alias("table_idx"), t["rows"].alias("rows"), t["width"].alias("width"),
            padded.alias("header"),
        )

    def fields(t):
        return t.withField("fields", header_fields(t["header"], field_aliases))

    def judged(t):
        return t.withField("is_rate_table", is_rate_header(t["fields"], t["width"], field_aliases))

    def verdict(t):
        rows, rate = t["rows"], t["is_rate_table"]
        return F.struct(
            t["table_idx"].alias("table_idx"),
            t["header"].alias("header"),
            t["width"].alias("width"),
            (F.size(rows) - 1).alias("n_rows"),
            rate.alias("is_rate_table"),
            t["fields"].alias("fields"),
            F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(1))).alias("data"),
            F.when(rate, F.lit("rate table"))
            .when(t["width"] != len(field_aliases), F.lit("width"))
            .when(F.exists(t["header"], lambda h: h.isNull()), F.lit("header has empty cells"))
            .otherwise(F.lit("header names"))
            .alias("reason"),
        )

    for stage in (shape, header, fields, judged, verdict):
        tables = F.transform(tables, stage)
    return tables


def row_cells(t: Column) -> Column:
    """Data rows of a rate table as ``struct(row_idx, name_raw, rate_raw, entry_raw)``.

    Each cell is resolved once per row here (source column order -> canonical field), so the
    failure test and the filters after exploding read plain struct fields.
    """
    pos = {f: _position(t["fields"], f) for f in dims.CANONICAL_FIELDS}
    return F.transform(
        t["data"],
        lambda r, i: F.struct(
            (i + 1).alias("row_idx"),
            F.get(r, pos[dims.NAME]).alias("name_raw"),
            F.get(r, pos[dims.RATE]).alias("rate_raw"),
            F.get(r, pos[dims.ENTRY]).alias("entry_raw"),
        ),
    )


def table_failed(t: Column, stopwords: Sequence[str] = dims.STOPWORDS) -> Column:
    """F1 failure: a row kept by D3 has no rate or no entry cell (a ragged row)."""
    return F.exists(
        t["cells"],
        lambda c: (c["rate_raw"].isNull() | c["entry_raw"].isNull()) & tx.keeps_row(c["name_raw"], stopwords),
    )


def detect(df: DataFrame, field_aliases=dims.FIELD_ALIASES, stopwords=dims.STOPWORDS) -> DataFrame:
    """Adds ``table_info`` (all newest tables), ``rate_tables``, ``message_failed`` (F2)."""
    info = describe_tables(F.col("tables"), field_aliases)
    return (
        df.withColumn("table_info", info)
        .withColumn(
            "rate_tables",
            F.transform(
                F.filter("table_info", lambda t: t["is_rate_table"]),
                lambda t: t.withField("cells", row_cells(t)),
            ),
        )
        .withColumn(
            "rate_tables",
            F.transform("rate_tables", lambda t: t.withField("failed", table_failed(t, stopwords))),
        )
        .withColumn(
            "message_failed",
            F.coalesce(F.exists("rate_tables", lambda t: t["failed"]), F.lit(False)),
        )
    )


def detect_rows(df: DataFrame, field_aliases=dims.FIELD_ALIASES, stopwords=dims.STOPWORDS) -> DataFrame:
    """``detect`` for the extraction: ``rate_tables`` (table_idx, fields, cells) and ``message_failed`` only.

    Tables of another width, or with a shorter header (its last names are missing), are left out before
    any name is looked up.
    """
    wanted = sorted(field_aliases)

    def fits(t):
        width = F.array_max(F.transform(t["rows"], lambda r: F.size(r)))
        return (F.size(F.get(t["rows"], 0)) == len(wanted)) & (width == len(wanted))

    def named(t):
        rows = t["rows"]
        fields = header_fields(F.get(rows, 0), field_aliases)
        return F.struct(t["table_idx"].alias("table_idx"), fields.alias("fields"), F.slice(rows, 2, F.size(rows)).alias("data"))

    def judged(t):
        return is_rate_header(t["fields"], F.lit(len(wanted)), field_aliases)

    def with_cells(t):
        return F.struct(t["table_idx"].alias("table_idx"), t["fields"].alias("fields"), row_cells(t).alias("cells"))

    tables = F.filter(F.transform(F.filter("tables", fits), named), judged)
    df = df.withColumn("rate_tables", F.transform(tables, with_cells))
    failed = F.exists("rate_tables", lambda t: table_failed(t, stopwords))
    return df.withColumn("message_failed", F.coalesce(failed, F.lit(False)))


def table_headers(detected: DataFrame, key: str = "message_id") -> DataFrame:
    """``table_headers`` view: one row per newest top-level table."""
    return detected.select(key, unpacked(F.col("table_info")).alias("t")).select(
        key,
        F.col("t.table_idx").alias("table_idx"),
        F.col("t.header").alias("header"),
        F.col("t.width").alias("width"),
        F.col("t.n_rows").alias("n_rows"),
        F.col("t.is_rate_table").alias("is_rate_table"),
    )


def candidate_rows(detected: DataFrame, key: str = "message_id", accepted_only: bool = True) -> DataFrame:
    """Rows of rate tables as ``(key, table_idx, row_idx, name_raw, rate_raw, entry_raw)``.

    ``row_idx`` counts data rows of a table from 1 (0 is the header). With
    ``accepted_only`` the rows of failed messages (F2) are left out before exploding.
    """
    # Exploding a conditional array instead of filtering: a Filter on this derived column
    # would be pushed down with the whole array expression inlined and evaluated twice.
    tables = F.col("rate_tables")
    src = F.explode(F.when(~F.col("message_failed"), tables)) if accepted_only else unpacked(tables)

    tables = detected.select(key, "message_failed", src.alias("t")).select(
        key,
        "message_failed",
        F.col("t.table_idx").alias("table_idx"),
        F.col("t.fields").alias("col_order"),
        F.col("t.cells").alias("cells"),
    )
    rows = tables.select(key, "message_failed", "table_idx", "col_order", F.explode("cells").alias("r"))
    return rows.select(
        key,
        "table_idx",
        F.col("r.row_idx").alias("row_idx"),
        F.col("r.name_raw").alias("name_raw"),
        F.col("r.rate_raw").alias("rate_raw"),
        F.col("r.entry_raw").alias("entry_raw"),
        "col_order",
        "message_failed",
    )


def normalise(
    candidates: DataFrame,
    keywords: Sequence[tuple[str, str]] = dims.SERVICE_KEYWORDS,
    stopwords: Sequence[str] = dims.STOPWORDS,
) -> DataFrame:
    """F1 on rows: D3 -> E3 (rate) -> E5 (entry) -> E6 (service) -> D4. Narrow, no shuffle."""
    kept = candidates.where(tx.keeps_row("name_raw", stopwords))
    extra = [c for c in candidates.columns if c not in ("name_raw", "rate_raw", "entry_raw", "message_failed")]
    head = [c for c in extra if c not in ("col_order",)]
    tail = ["col_order"] if "col_order" in extra else []
    # one projection each for the lower-cased and the mapped name: expressions inside a generator are
    # interpreted, and would lower-case the text once for every keyword
    low = kept.select(*extra, "rate_raw", "entry_raw", F.lower("name_raw").alias("low"))
    mapped = low.select(*extra, "rate_raw", "entry_raw", tx.service_name("low", keywords, lowered=True).alias("name"))
    # the generator reads the mapped name; a plain filter would be pushed below the projection with
    # the whole keyword chain inlined and evaluated twice
    row = F.struct(*head, "name", "rate_raw", "entry_raw", *tail)
    named = mapped.select(F.inline(F.when(F.col("name") != "", F.array(row))))
    return named.select(*head, "name", tx.first_number("rate_raw").alias("rate"), tx.entry_number("entry_raw").alias("entry"), *tail)


def row_failed(candidates: DataFrame, stopwords: Sequence[str] = dims.STOPWORDS) -> Column:
    """F1 failure of one exploded row."""
    return tx.keeps_row("name_raw", stopwords) & (
        F.col("rate_raw").isNull() | F.col("entry_raw").isNull()
    )


def all_or_nothing_rows(candidates: DataFrame, key: str = "message_id", stopwords=dims.STOPWORDS) -> DataFrame:
    """F2 for input that is already one row per cell row: drop every row of a message that
    has a failing row. (The extraction path decides this in the row, before exploding.)

    The failing keys are de-duplicated with map-side partial aggregation, so a hot key (copies
    of one message) collapses before the shuffle; the anti join is then broadcast by AQE when
    the measured key set is small, or split by AQE's skew handling when it is not.
    """
    failing = candidates.where(row_failed(candidates, stopwords)).select(key).distinct()
    return candidates.join(failing, on=key, how="left_anti")


def message_status(detected: DataFrame, key: str = "message_id", stopwords=dims.STOPWORDS,
                   keywords=dims.SERVICE_KEYWORDS) -> DataFrame:
    """``rate_table_status``: one row per rate table with its kept row count."""
    t = detected.select(key, "message_failed", unpacked(F.col("rate_tables")).alias("t"))

    def kept(low):
        return tx.keeps_row(low, stopwords, lowered=True) & (tx.service_name(low, keywords, lowered=True) != "")

    names = F.transform("t.cells", lambda c: F.lower(c["name_raw"]))  # lower once per row

    return t.select(
        key,
        F.col("t.table_idx").alias("table_idx"),
        F.when(F.col("message_failed"), F.lit(0))
        .otherwise(F.size(F.filter(names, kept)))
        .alias("n_rows"),
        F.col("t.failed").alias("table_failed"),
        F.col("message_failed"),
        F.when(F.col("t.failed"), F.lit("row without rate or entry cell"))
        .when(F.col("message_failed"), F.lit("another rate table of the message failed"))
        .otherwise(F.lit("ok"))
        .alias("reason"),
    )
