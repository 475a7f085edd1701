"""Synthetic rate mail derived from ``orders`` (FIXTURES.md §2).

The given tables hold no mail, so messages are rendered from ``orders``: one message per
order, 1-5 rate rows, one or two rate tables, header variants, a decoy table carrying a reply
header in its cells, and quoted threads (Russian CRLF / English LF) carrying a rate table
that must not be extracted. Rendering is per order row with array functions: narrow, no
shuffle, grows linearly with ``orders``.

The cell formulas are portable SQL, shared by Spark (``{k}``/``{i}`` bound to the order key and
the row number) and by the DuckDB oracle (GEN / EXP of FIXTURES.md).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NBSP = "\u00a0"

# Cell formulas of candidate row i of message k (FIXTURES.md GEN).
NAME_RAW = (
    "CASE ({k} * 7 + {i} * 3) % 8"
    " WHEN 0 THEN 'ФРАХТ морской' WHEN 1 THEN 'Вознаграждение экспедитора' WHEN 2 THEN 'Тариф РЖД'"
    " WHEN 3 THEN 'Автовывоз контейнера' WHEN 4 THEN 'Охрана и фрахт' WHEN 5 THEN 'Прочее'"
    " WHEN 6 THEN 'Автовывоз до РЖД' ELSE '' END"
)
RATE_RAW = (
    "CASE ({k} + {i}) % 4"
    " WHEN 0 THEN concat(CAST(CAST(floor((({k} * 31 + {i} * 17) % 90000 + 1000) / 1000) AS INT) AS STRING), ' ',"
    " lpad(CAST(({k} * 31 + {i} * 17) % 1000 AS STRING), 3, '0'), ' руб')"
    " WHEN 1 THEN concat('USD ', CAST({k} % 500 + {i} AS STRING), '.5')"
    " WHEN 2 THEN concat('-', CAST({k} % 70 AS STRING), ',25') ELSE 'по запросу' END"
)
ENTRY_RAW = (
    "CASE {k} % 2 WHEN 0 THEN concat(CAST({i} AS STRING), '0 + 5 = ', CAST({i} * 10 + 5 AS STRING), ' руб')"
    " ELSE CAST({k} % 1000 AS STRING) END"
)
N_ROWS = "CAST(1 + {k} % 5 AS INT)"
TABLE_OF_ROW = "CASE WHEN {i} <= 3 THEN 0 ELSE 1 END"

# Expected normalised values (FIXTURES.md EXP), from integers only.
EXP_NAME = (
    "CASE ({k}*7+{i}*3)%8 WHEN 0 THEN 'Фрахт' WHEN 1 THEN 'Транспортно-Экспедиторское обслуживание'"
    " WHEN 2 THEN 'Организация ЖД перевозки' WHEN 3 THEN 'Организация автовывоза'"
    " WHEN 6 THEN 'Организация ЖД перевозки' END"
)
EXP_RATE = (
    "CASE ({k}+{i})%4 WHEN 0 THEN CAST(({k}*31+{i}*17)%90000+1000 AS DOUBLE)"
    " WHEN 1 THEN {k}%500+{i}+CAST(0.5 AS DOUBLE)"
    " WHEN 2 THEN CAST({k}%70 AS DOUBLE) END"
)
EXP_ENTRY = "CASE {k}%2 WHEN 0 THEN CAST({i}*10+5 AS DOUBLE) ELSE CAST({k}%1000 AS DOUBLE) END"


def _bind(sql: str, k: str, i: str) -> str:
    return sql.replace("{k}", k).replace("{i}", i)


def gen_sql(orders: str = "orders") -> str:
    """GEN as portable SQL over a table/view named ``orders``."""
    k, i = "m.o_orderkey", "v.i"
    return (
        f"SELECT m.o_orderkey AS message_id, {_bind(TABLE_OF_ROW, k, i)} AS table_idx, "
        f"CAST(v.i AS INT) AS row_idx, {_bind(NAME_RAW, k, i)} AS name_raw, "
        f"{_bind(RATE_RAW, k, i)} AS rate_raw, {_bind(ENTRY_RAW, k, i)} AS entry_raw "
        f"FROM {orders} m CROSS JOIN (VALUES (1),(2),(3),(4),(5)) AS v(i) "
        f"WHERE v.i <= 1 + m.o_orderkey % 5"
    )


def exp_sql(orders: str = "orders") -> str:
    """EXP (expected ``rate_rows``, row_idx counted over the message) as portable SQL."""
    k, i = "m.o_orderkey", "v.i"
    return (
        "SELECT message_id, table_idx, row_idx, name, rate, entry FROM ("
        f"SELECT m.o_orderkey AS message_id, {_bind(TABLE_OF_ROW, k, i)} AS table_idx, "
        f"CAST(v.i AS INT) AS row_idx, {_bind(EXP_NAME, k, i)} AS name, "
        f"{_bind(EXP_RATE, k, i)} AS rate, {_bind(EXP_ENTRY, k, i)} AS entry "
        f"FROM {orders} m CROSS JOIN (VALUES (1),(2),(3),(4),(5)) AS v(i) "
        f"WHERE v.i <= 1 + m.o_orderkey % 5) t WHERE name IS NOT NULL"
    )


def _rows_sql(k: str) -> str:
    """The candidate rows of the order with key ``k``, an array of structs."""
    i = "i"
    return (
        f"transform(sequence(1, {_bind(N_ROWS, k, i)}), i -> named_struct("
        f"'table_idx', {_bind(TABLE_OF_ROW, k, i)}, 'row_idx', i, "
        f"'name_raw', {_bind(NAME_RAW, k, i)}, 'rate_raw', {_bind(RATE_RAW, k, i)}, "
        f"'entry_raw', {_bind(ENTRY_RAW, k, i)}))"
    )


def nested_rows(orders: DataFrame) -> DataFrame:
    """One row per order: ``message_id`` and ``rows`` = its candidate rows (array of structs)."""
    return orders.select(
        F.col("o_orderkey").alias("message_id"), "o_custkey", "o_orderdate", F.expr(_rows_sql("o_orderkey")).alias("rows")
    )


def candidate_rows(orders: DataFrame) -> DataFrame:
    """GEN in Spark: ``(message_id, table_idx, row_idx, name_raw, rate_raw, entry_raw)``."""
    return nested_rows(orders).select("message_id", F.inline("rows"))


# ---------------------------------------------------------------------------------- html

def _td(c):
    return F.concat(F.lit("<td>"), c, F.lit("</td>"))


def _header_cells(variant):
    plain0 = "".join(f"<td>{h}</td>" for h in ("Наименование", "Ставка", "Вход"))
    plain1 = "".join(f"<td>{h}</td>" for h in ("Наименование услуги", "ставка", "вход"))
    # permuted, upper case, padded with NBSP inside a single <p> (kept unstripped)
    perm = "".join(f"<td><p>{NBSP}{h} </p></td>" for h in ("СТАВКА", "ВХОД", "НАИМЕНОВАНИЕ"))
    return F.when(variant == 0, F.lit(plain0)).when(variant == 1, F.lit(plain1)).otherwise(F.lit(perm))


def _row_html(r, variant):
    name, rate, entry = _td(r["name_raw"]), _td(r["rate_raw"]), _td(r["entry_raw"])
    cells = F.when(variant == 2, F.concat(rate, entry, name)).otherwise(F.concat(name, rate, entry))
    return F.concat(F.lit("\n<tr>"), cells, F.lit("</tr>"))


def _table_html(rows, variant, table_idx):
    mine = F.filter(rows, lambda r: r["table_idx"] == table_idx)
    return _table_of(F.array_join(F.transform(mine, lambda r: _row_html(r, variant)), ""), variant)


def _table_of(body, variant):
    return F.concat(
        F.lit('<table border="1" cellpadding="4">\n<tr>'),
        _header_cells(variant),
        F.lit("</tr>"),
        body,
        F.lit("\n</table>"),
    )


DECOY_TABLE = (
    "<table><tr><td>Sent: see below</td></tr>\n<tr><td>To: logistics</td></tr>\n"
    "<tr><td>Subject: reference data</td></tr></table>"
)
QUOTED_TABLE = (
    '<table border="1">\n<tr><td>Наименование</td><td>Ставка</td><td>Вход</td></tr>\n'
    "<tr><td>Фрахт (старая ставка)</td><td>999 руб</td><td>1000</td></tr>\n</table>"
)


def _quote_ru(k, cust):
    return F.concat(
        F.lit("<div>\r\n<p><b>От:</b> client"), cust, F.lit("@example.com<br>\r\n"),
        F.lit("<b>Отправлено:</b> 1 марта 2024 г. 10:00<br>\r\n"),
        F.lit("<b>Кому:</b> rates@example.com<br>\r\n"),
        F.lit("<b>Копия:</b> logist@example.com<br>\r\n"),
        F.lit("<b>Тема:</b> Запрос ставок "), k, F.lit("</p>\r\n"),
        F.lit(QUOTED_TABLE), F.lit("\r\n</div>\r\n"),
    )


def _quote_en(k, cust):
    return F.concat(
        F.lit("<div>\n<p><b>From:</b> client"), cust, F.lit("@example.com<br>\n"),
        F.lit("<b>Sent:</b> Monday, March 4, 2024 10:00 AM<br>\n"),
        F.lit("<b>To:</b> rates@example.com<br>\n"),
        F.lit("<b>Subject:</b> RE: rates "), k, F.lit("</p>\n"),
        F.lit(QUOTED_TABLE), F.lit("\n</div>\n"),
    )


def html_column(k, cust, rows):
    """Rendered html of one message (``k`` order key, ``cust`` customer key, ``rows`` array)."""
    variant = (k % 3).cast("int")
    return _html_of(k, cust, [_table_html(rows, variant, t) for t in (0, 1)], F.size(rows) > 3)


def _html_of(k, cust, tables, two_tables):
    ks = k.cast("string")
    cs = cust.cast("string")
    return F.concat(
        F.lit("<html><body>\n<p>Добрый день! Ставки по заявке "), ks, F.lit(":</p>\n"),
        tables[0], F.lit("\n"),
        F.when(
            two_tables,
            F.concat(F.lit("<p>Дополнительные услуги:</p>\n"), tables[1], F.lit("\n")),
        ).otherwise(F.lit("")),
        F.when(k % 8 == 2, F.concat(F.lit(DECOY_TABLE), F.lit("\n"))).otherwise(F.lit("")),
        F.lit("<p>С уважением,<br>отдел логистики</p>\n"),
        F.when(k % 8 == 0, _quote_ru(ks, cs)).when(k % 8 == 4, _quote_en(ks, cs)).otherwise(F.lit("")),
        F.lit("</body></html>"),
    )


def html_messages(orders: DataFrame) -> DataFrame:
    """``(message_id, html)``: one rendered html message per order."""
    n = nested_rows(orders)
    return n.select(
        "message_id", html_column(F.col("message_id"), F.col("o_custkey"), F.col("rows")).alias("html")
    )


def _with_html(orders: DataFrame, *cols: str) -> DataFrame:
    """``html_messages`` with ``cols`` of the order. The rows are written out one by one: without an array
    of them the rendering is compiled code. (A negative key has rows in descending order: the array form.)"""
    k = F.col("message_id")
    variant = (k % 3).cast("int")
    n_rows = F.expr(_bind(N_ROWS, "message_id", ""))

    def row(i: int):
        cells = {c: F.expr(_bind(sql, "message_id", str(i))) for c, sql in
                 (("name_raw", NAME_RAW), ("rate_raw", RATE_RAW), ("entry_raw", ENTRY_RAW))}
        html = _row_html(cells, variant)
        return html if i == 1 else F.when(n_rows >= i, html).otherwise(F.lit(""))

    tables = [_table_of(F.concat(*[row(i) for i in of]), variant) for of in ((1, 2, 3), (4, 5))]
    plain = _html_of(k, F.col("o_custkey"), tables, n_rows > 3)
    other = html_column(k, F.col("o_custkey"), F.expr(_rows_sql("message_id")))
    renamed = orders.withColumnRenamed("o_orderkey", "message_id")
    return renamed.select("message_id", *cols, F.when(k < 0, other).otherwise(plain).alias("html"))


# ---------------------------------------------------------------------------------- mime

TEXT_BODY = "Добрый день! Ставки по заявке {k} в письме."


def _text_body(ks):
    before, after = TEXT_BODY.split("{k}")
    return F.concat(F.lit(before), ks, F.lit(after))


def _b64_word(charset: str, data) -> "F.Column":
    return F.concat(F.lit(f"=?{charset}?B?"), F.base64(data), F.lit("?="))


def mime_column(k, cust, orderdate, html):
    """RFC 822 bytes of one message built with native columns (base64 bodies, CRLF lines).

    Variants by key: subject (utf-8 / plain / missing / windows-1251 word), sender (quoted name,
    bare, encoded name, missing, two addresses), date (present / missing), structure
    (text only, html only, multipart), html charset (utf-8, windows-1251, utf-8 with BOM).
    """
    from rateflow.functions.charset import encode_cp1251

    ks, cs = k.cast("string"), cust.cast("string")
    crlf = F.lit("\r\n")
    subject = (
        F.when(k % 4 == 0, _b64_word("utf-8", F.encode(F.concat(F.lit("Ставки по заявке "), ks), "UTF-8")))
        .when(k % 4 == 1, F.concat(F.lit("Rates for order "), ks))
        .when(k % 4 == 3, _b64_word("windows-1251", encode_cp1251(F.concat(F.lit("Ставка "), ks))))
    )
    addr = F.concat(F.lit("client"), cs, F.lit("@example.com"))
    sender = (
        F.when(k % 5 == 0, F.concat(F.lit('"Client '), cs, F.lit('" <'), addr, F.lit(">")))
        .when(k % 5 == 1, addr)
        .when(k % 5 == 2, F.concat(_b64_word("utf-8", F.encode(F.concat(F.lit("Клиент "), cs), "UTF-8")),
                                   F.lit(" <"), addr, F.lit(">")))
        .when(k % 5 == 4, F.concat(F.lit("a"), cs, F.lit("@example.com, b"), cs, F.lit("@example.com")))
    )
    date = F.when(k % 6 != 5, F.date_format(orderdate, "yyyy-MM-dd"))
    text = _text_body(ks)
    html_bytes = (  # strings are UTF-8 already: the cast takes their bytes
        F.when(k % 3 == 1, encode_cp1251(html))
        .when(k % 3 == 2, F.concat(F.unhex(F.lit("EFBBBF")), html.cast("binary")))
        .otherwise(html.cast("binary"))
    )
    html_charset = F.when(k % 3 == 1, F.lit("windows-1251")).otherwise(F.lit("utf-8"))
    boundary = F.concat(F.lit("=_b"), ks)

    def header(name, value):
        return F.coalesce(F.concat(F.lit(name + ": "), value, crlf), F.lit(""))

    def part(ctype, charset, data):
        return F.concat(
            F.lit("Content-Type: " + ctype + "; charset="), charset, crlf,
            F.lit("Content-Transfer-Encoding: base64"), crlf, crlf, F.base64(data), crlf,
        )

    heads = F.concat(
        header("From", sender), F.lit("To: rates@example.com\r\n"), header("Subject", subject),
        header("Date", date), F.lit("Message-ID: <"), ks, F.lit("@orders.example>\r\nMIME-Version: 1.0\r\n"),
    )
    text_part = part("text/plain", F.lit("utf-8"), text.cast("binary"))
    html_part = part("text/html", html_charset, html_bytes)
    multipart = F.concat(
        F.lit('Content-Type: multipart/alternative; boundary="'), boundary, F.lit('"'), crlf, crlf,
        F.lit("--"), boundary, crlf, text_part,
        F.lit("--"), boundary, crlf, html_part,
        F.lit("--"), boundary, F.lit("--"), crlf,
    )
    body = F.when(k % 11 == 0, text_part).when(k % 7 == 0, html_part).otherwise(multipart)
    return F.concat(heads, body).cast("binary")


def mime_messages(orders: DataFrame) -> DataFrame:
    """``(message_id, content BINARY)``: one RFC 822 message per order."""
    n = _with_html(orders, "o_custkey", "o_orderdate")
    return n.select(
        "message_id",
        mime_column(F.col("message_id"), F.col("o_custkey"), F.col("o_orderdate"), F.col("html")).alias("content"),
    )


def structured_messages(orders: DataFrame) -> DataFrame:
    """``structured_messages``: fields as a .msg reader gives them (some empty)."""
    n = _with_html(orders, "o_custkey", "o_orderdate")
    k = F.col("message_id")
    ks, cs = k.cast("string"), F.col("o_custkey").cast("string")
    return n.select(
        "message_id",
        F.when(k % 4 == 0, F.concat(F.lit("Ставки по заявке "), ks))
        .when(k % 4 == 1, F.concat(F.lit("=?utf-8?Q?=D0=A1=D1=82?= "), ks))
        .when(k % 4 == 2, F.lit("")).alias("subject"),
        F.when(k % 3 == 0, F.concat(F.lit("Клиент "), cs, F.lit(" <client"), cs, F.lit("@example.com>")))
        .when(k % 3 == 1, F.lit("")).alias("sender"),
        F.when(k % 5 != 0, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("date"),
        F.when(k % 6 != 0, _text_body(ks)).otherwise(F.lit("")).alias("body"),
        F.when(k % 9 != 0, F.col("html")).alias("html_body"),
    )
