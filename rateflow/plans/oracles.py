"""DuckDB oracle SQL for the registered queries (views ``orders`` etc. pre-registered).

Expectations are computed from the integers of ``orders`` (EXP of FIXTURES.md), never by
re-parsing text; where a query returns html, the oracle renders it with ``string_agg``.
"""

from __future__ import annotations

from rateflow.operators.render import TABLE_OPEN
from rateflow.sources import synth

NL = "chr(10)"
ROWS = "orders m CROSS JOIN (VALUES (1),(2),(3),(4),(5)) AS v(i) WHERE v.i <= 1 + m.o_orderkey % 5"


def _b(sql: str) -> str:
    return synth._bind(sql, "m.o_orderkey", "v.i")


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


GEN = synth.gen_sql("orders")
EXP = synth.exp_sql("orders")
EXP_PER_TABLE = (
    "SELECT message_id, table_idx, row_idx - 3 * table_idx AS row_idx, name, rate, entry FROM ("
    + EXP + ") e"
)
SERVICE_OF_NAME = (
    "CASE (m.o_orderkey*7+v.i*3)%8 WHEN 0 THEN 'Фрахт' WHEN 1 THEN 'Транспортно-Экспедиторское обслуживание'"
    " WHEN 2 THEN 'Организация ЖД перевозки' WHEN 3 THEN 'Организация автовывоза' WHEN 4 THEN 'Фрахт'"
    " WHEN 6 THEN 'Организация ЖД перевозки' ELSE '' END"
)
N_TABLES = "CASE WHEN 1 + o_orderkey % 5 > 3 THEN 2 ELSE 1 END"


def html_render_sql(wrap_tables: bool = False) -> str:
    """``(message_id, o_custkey, o_orderdate, html)``: the synthetic html, rendered in SQL."""
    w = (lambda t: f"{NL} || {t} || {NL}") if wrap_tables else (lambda t: t)
    plain0 = "".join(f"<td>{h}</td>" for h in ("Наименование", "Ставка", "Вход"))
    plain1 = "".join(f"<td>{h}</td>" for h in ("Наименование услуги", "ставка", "вход"))
    perm = "".join(f"<td><p>{synth.NBSP}{h} </p></td>" for h in ("СТАВКА", "ВХОД", "НАИМЕНОВАНИЕ"))
    header = f"CASE g.message_id % 3 WHEN 0 THEN {_q(plain0)} WHEN 1 THEN {_q(plain1)} ELSE {_q(perm)} END"
    cells = (
        "CASE WHEN g.message_id % 3 = 2 THEN '<td>' || g.rate_raw || '</td><td>' || g.entry_raw || '</td><td>' "
        "|| g.name_raw || '</td>' ELSE '<td>' || g.name_raw || '</td><td>' || g.rate_raw || '</td><td>' "
        "|| g.entry_raw || '</td>' END"
    )
    quote_ru = (
        "'<div>' || chr(13) || chr(10) || '<p><b>От:</b> client' || CAST(o.o_custkey AS VARCHAR) || "
        "'@example.com<br>' || chr(13) || chr(10) || '<b>Отправлено:</b> 1 марта 2024 г. 10:00<br>' || chr(13) || chr(10) || "
        "'<b>Кому:</b> rates@example.com<br>' || chr(13) || chr(10) || '<b>Копия:</b> logist@example.com<br>' || chr(13) || chr(10) || "
        "'<b>Тема:</b> Запрос ставок ' || CAST(o.o_orderkey AS VARCHAR) || '</p>' || chr(13) || chr(10) || "
        + w(_q(synth.QUOTED_TABLE)) + " || chr(13) || chr(10) || '</div>' || chr(13) || chr(10)"
    )
    quote_en = (
        f"'<div>' || {NL} || '<p><b>From:</b> client' || CAST(o.o_custkey AS VARCHAR) || '@example.com<br>' || {NL} || "
        f"'<b>Sent:</b> Monday, March 4, 2024 10:00 AM<br>' || {NL} || '<b>To:</b> rates@example.com<br>' || {NL} || "
        f"'<b>Subject:</b> RE: rates ' || CAST(o.o_orderkey AS VARCHAR) || '</p>' || {NL} || "
        + w(_q(synth.QUOTED_TABLE)) + f" || {NL} || '</div>' || {NL}"
    )
    return f"""
WITH g AS ({GEN}),
tabs AS (
  SELECT g.message_id, g.table_idx,
         '<table border="1" cellpadding="4">' || {NL} || '<tr>' || min({header}) || '</tr>'
         || string_agg({NL} || '<tr>' || {cells} || '</tr>', '' ORDER BY g.row_idx) || {NL} || '</table>' AS t
  FROM g GROUP BY g.message_id, g.table_idx),
t2 AS (
  SELECT message_id, max(CASE WHEN table_idx = 0 THEN t END) AS t0, max(CASE WHEN table_idx = 1 THEN t END) AS t1
  FROM tabs GROUP BY message_id)
SELECT o.o_orderkey AS message_id, o.o_custkey, o.o_orderdate,
  '<html><body>' || {NL} || '<p>Добрый день! Ставки по заявке ' || CAST(o.o_orderkey AS VARCHAR) || ':</p>' || {NL}
  || {w('t2.t0')} || {NL}
  || CASE WHEN t2.t1 IS NOT NULL THEN '<p>Дополнительные услуги:</p>' || {NL} || {w('t2.t1')} || {NL} ELSE '' END
  || CASE WHEN o.o_orderkey % 8 = 2 THEN {w(_q(synth.DECOY_TABLE))} || {NL} ELSE '' END
  || '<p>С уважением,<br>отдел логистики</p>' || {NL}
  || CASE o.o_orderkey % 8 WHEN 0 THEN {quote_ru} WHEN 4 THEN {quote_en} ELSE '' END
  || '</body></html>' AS html
FROM orders o JOIN t2 ON t2.message_id = o.o_orderkey
"""


def _td(x: str) -> str:
    return f"'  <td>' || coalesce(CAST({x} AS VARCHAR), '') || '</td>'"


def _th(names) -> str:
    return f" || {NL} || ".join(_q(f"  <th>{n}</th>") for n in names)


def reply_sql() -> str:
    row_default = f" || {NL} || ".join([_td("e.name"), _td("e.rate"), _td("e.entry")])
    row_perm = f" || {NL} || ".join([_td("e.rate"), _td("e.entry"), _td("e.name")])
    th_default = _th(["наименование", "ставка", "вход"])
    th_perm = _th(["ставка", "вход", "наименование"])
    return f"""
WITH e AS ({EXP}),
t AS (SELECT DISTINCT message_id, table_idx FROM ({GEN}) g),
rh AS (SELECT e.message_id, e.table_idx, e.row_idx,
         '<tr>' || {NL} || CASE WHEN e.message_id % 3 = 2 THEN {row_perm} ELSE {row_default} END || {NL} || '</tr>' AS h
       FROM e),
tb AS (SELECT t.message_id, t.table_idx,
         {_q(TABLE_OPEN)} || {NL} || '<tr>' || {NL}
         || CASE WHEN t.message_id % 3 = 2 THEN {th_perm} ELSE {th_default} END || {NL} || '</tr>'
         || coalesce({NL} || string_agg(rh.h, {NL} ORDER BY rh.row_idx), '') || {NL} || '</table>' AS html
       FROM t LEFT JOIN rh ON rh.message_id = t.message_id AND rh.table_idx = t.table_idx
       GROUP BY t.message_id, t.table_idx)
SELECT o.o_orderkey AS message_id, 'client' || CAST(o.o_custkey AS VARCHAR) || '@example.com' AS recipient,
       'Автоответ от rates@example.com' AS subject, true AS deliverable,
       string_agg(tb.html, {NL} || '+' || {NL} ORDER BY tb.table_idx) AS body_html
FROM orders o JOIN tb ON tb.message_id = o.o_orderkey
GROUP BY o.o_orderkey, o.o_custkey
"""


def table_csv_sql() -> str:
    def v(x):
        return f"coalesce(CAST({x} AS VARCHAR), '')"

    row_default = f"e.name || ',' || {v('e.rate')} || ',' || {v('e.entry')}"
    row_perm = f"{v('e.rate')} || ',' || {v('e.entry')} || ',' || e.name"
    return f"""
WITH e AS ({EXP}),
t AS (SELECT DISTINCT message_id, table_idx FROM ({GEN}) g),
rl AS (SELECT e.message_id, e.table_idx, e.row_idx,
         CASE WHEN e.message_id % 3 = 2 THEN {row_perm} ELSE {row_default} END AS line FROM e)
SELECT t.message_id, t.table_idx,
  CASE WHEN t.message_id % 3 = 2 THEN 'ставка,вход,наименование' ELSE 'наименование,ставка,вход' END
  || {NL} || coalesce(string_agg(rl.line || {NL}, '' ORDER BY rl.row_idx), '') AS csv
FROM t LEFT JOIN rl ON rl.message_id = t.message_id AND rl.table_idx = t.table_idx
GROUP BY t.message_id, t.table_idx
"""


def table_xml_sql() -> str:
    def field(name, value):
        return (
            f"CASE WHEN {value} IS NULL THEN '    <{name}/>' ELSE '    <{name}>' || CAST({value} AS VARCHAR) || '</{name}>' END"
        )

    name, rate, entry = field("наименование", "e.name"), field("ставка", "e.rate"), field("вход", "e.entry")
    plain, moved = f" || {NL} || ".join([name, rate, entry]), f" || {NL} || ".join([rate, entry, name])
    return f"""
WITH e AS ({EXP}),
t AS (SELECT DISTINCT message_id, table_idx FROM ({GEN}) g),
rl AS (SELECT e.message_id, e.table_idx, e.row_idx,
         '  <row>' || {NL} || CASE WHEN e.message_id % 3 = 2 THEN {moved} ELSE {plain} END || {NL} || '  </row>' || {NL} AS x FROM e)
SELECT t.message_id, t.table_idx,
  '<?xml version=''1.0'' encoding=''utf-8''?>' || {NL} ||
  coalesce('<data>' || {NL} || string_agg(rl.x, '' ORDER BY rl.row_idx) || '</data>', '<data/>') || {NL} AS xml
FROM t LEFT JOIN rl ON rl.message_id = t.message_id AND rl.table_idx = t.table_idx
GROUP BY t.message_id, t.table_idx
"""


def table_cells_sql() -> str:
    """Cells of all top-level tables of the synthetic html, from the integers."""
    nb = synth.NBSP
    hdr = [
        ("Наименование", "Ставка", "Вход"),
        ("Наименование услуги", "ставка", "вход"),
        (f"{nb}СТАВКА ", f"{nb}ВХОД ", f"{nb}НАИМЕНОВАНИЕ "),
    ]
    header_rows = " UNION ALL ".join(
        f"SELECT {v} AS variant, {c} AS col_idx, {_q(hdr[v][c])} AS text" for v in range(3) for c in range(3)
    )
    n_rate = "CASE WHEN 1 + o.o_orderkey % 5 > 3 THEN 2 ELSE 1 END"
    decoy = ["Sent: see below", "To: logistics", "Subject: reference data"]
    quoted = [["Наименование", "Ставка", "Вход"], ["Фрахт (старая ставка)", "999 руб", "1000"]]
    decoy_rows = " UNION ALL ".join(f"SELECT {r} AS row_idx, 0 AS col_idx, {_q(t)} AS text" for r, t in enumerate(decoy))
    quoted_rows = " UNION ALL ".join(
        f"SELECT {r} AS row_idx, {c} AS col_idx, {_q(t)} AS text" for r, row in enumerate(quoted) for c, t in enumerate(row)
    )
    return f"""
WITH g AS ({GEN}),
h AS ({header_rows}),
d AS ({decoy_rows}),
q AS ({quoted_rows}),
tabs AS (SELECT DISTINCT message_id, table_idx FROM g)
SELECT t.message_id, t.table_idx, 0 AS row_idx, h.col_idx, h.text
FROM tabs t JOIN h ON h.variant = t.message_id % 3
UNION ALL
SELECT g.message_id, g.table_idx, g.row_idx - 3 * g.table_idx AS row_idx, c.col_idx,
  CASE WHEN (g.message_id % 3 = 2 AND c.col_idx = 2) OR (g.message_id % 3 <> 2 AND c.col_idx = 0) THEN g.name_raw
       WHEN (g.message_id % 3 = 2 AND c.col_idx = 0) OR (g.message_id % 3 <> 2 AND c.col_idx = 1) THEN g.rate_raw
       ELSE g.entry_raw END AS text
FROM g CROSS JOIN (VALUES (0), (1), (2)) AS c(col_idx)
UNION ALL
SELECT o.o_orderkey AS message_id, {n_rate} AS table_idx, d.row_idx, d.col_idx, d.text
FROM orders o CROSS JOIN d WHERE o.o_orderkey % 8 = 2
UNION ALL
SELECT o.o_orderkey AS message_id, {n_rate} + CASE WHEN o.o_orderkey % 8 = 2 THEN 1 ELSE 0 END AS table_idx,
  q.row_idx, q.col_idx, q.text
FROM orders o CROSS JOIN q WHERE o.o_orderkey % 4 = 0
"""


def oracle_sql() -> dict[str, str]:
    text_body = _q(synth.TEXT_BODY.split("{k}")[0]) + " || CAST(o_orderkey AS VARCHAR) || " + _q(
        synth.TEXT_BODY.split("{k}")[1]
    )
    html = html_render_sql()
    sql = {
        "extract_rates": EXP_PER_TABLE,
        "normalised_rates": EXP,
        "first_number": f"SELECT m.o_orderkey AS message_id, CAST(v.i AS INT) AS row_idx, {_b(synth.EXP_RATE)} AS rate FROM {ROWS}",
        "entry_number": f"SELECT m.o_orderkey AS message_id, CAST(v.i AS INT) AS row_idx, {_b(synth.EXP_ENTRY)} AS entry FROM {ROWS}",
        "service_map": f"SELECT m.o_orderkey AS message_id, CAST(v.i AS INT) AS row_idx, {SERVICE_OF_NAME} AS name FROM {ROWS}",
        "service_map_dim": f"SELECT m.o_orderkey AS message_id, CAST(v.i AS INT) AS row_idx, {SERVICE_OF_NAME} AS name FROM {ROWS}",
        "stopword_filter": f"SELECT message_id, row_idx, name_raw FROM ({GEN}) g WHERE (message_id * 7 + row_idx * 3) % 8 <> 4",
        "drop_unmapped": (
            f"SELECT m.o_orderkey AS message_id, CAST(v.i AS INT) AS row_idx, {SERVICE_OF_NAME} AS name FROM {ROWS}"
            " AND (m.o_orderkey*7+v.i*3)%8 NOT IN (5, 7)"
        ),
        "header_match": (
            "SELECT o_orderkey AS message_id, CASE o_orderkey % 8 WHEN 3 THEN 4 ELSE 3 END AS width, "
            "o_orderkey % 8 IN (0, 1, 2) AS is_rate_table FROM orders"
        ),
        "all_or_nothing": f"""
WITH g AS (SELECT m.o_orderkey AS message_id, v.i AS i, {_b(synth.NAME_RAW)} AS name_raw FROM {ROWS}),
f AS (SELECT message_id,
             bool_or(message_id % 7 = 3 AND i = 2 AND NOT contains(lower(name_raw), 'охрана')) AS failed
      FROM g GROUP BY message_id)
SELECT e.message_id, e.table_idx, e.row_idx, e.name, e.rate, e.entry
FROM ({EXP}) e JOIN f ON e.message_id = f.message_id WHERE NOT f.failed""",
        "rate_table_count": f"SELECT o_orderkey AS message_id, {N_TABLES} AS n_tables FROM orders",
        "table_headers": f"""
SELECT message_id, table_idx, 3 AS width, CAST(count(*) AS INT) AS n_rows, true AS is_rate_table
FROM ({GEN}) g GROUP BY message_id, table_idx
UNION ALL
SELECT o_orderkey AS message_id, {N_TABLES} AS table_idx, 1 AS width, 2 AS n_rows, false AS is_rate_table
FROM orders WHERE o_orderkey % 8 = 2""",
        "html_cells_roundtrip": (
            f"SELECT message_id, table_idx, row_idx - 3 * table_idx AS row_idx, name_raw, rate_raw, entry_raw FROM ({GEN}) g"
        ),
        "thread_cut": (
            f"SELECT o_orderkey AS message_id, {N_TABLES} + CASE WHEN o_orderkey % 8 = 2 THEN 1 ELSE 0 END"
            " + CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END AS n_tables_total,"
            f" {N_TABLES} + CASE WHEN o_orderkey % 8 = 2 THEN 1 ELSE 0 END AS n_tables_newest FROM orders"
        ),
        "table_cells": table_cells_sql(),
        "thread_parts": (
            "SELECT o_orderkey AS message_id, CASE WHEN o_orderkey % 4 = 0 THEN 2 ELSE 1 END AS n_parts FROM orders"
        ),
        "restore_html": (
            f"SELECT message_id, md5(html) AS restored_md5, CAST(length(html) AS BIGINT) AS restored_len "
            f"FROM ({html_render_sql(True)}) h"
        ),
        "html_reply": reply_sql(),
        "table_csv": table_csv_sql(),
        "rate_table_status": f"""
WITH t AS (SELECT DISTINCT message_id, table_idx FROM ({GEN}) g),
c AS (SELECT message_id, table_idx, count(*) AS n FROM ({EXP}) e GROUP BY message_id, table_idx)
SELECT t.message_id, t.table_idx, CAST(coalesce(c.n, 0) AS INT) AS n_rows, false AS table_failed,
       false AS message_failed
FROM t LEFT JOIN c ON c.message_id = t.message_id AND c.table_idx = t.table_idx""",
        "unseen_messages": (
            "SELECT o.o_orderkey AS message_id FROM orders o WHERE NOT EXISTS (SELECT 1 FROM orders l "
            "WHERE l.o_orderdate < TIMESTAMP '1995-01-01' AND l.o_orderkey = o.o_orderkey)"
        ),
        "process_log": (
            f"SELECT o_orderkey AS message_id, CASE WHEN o_orderkey % 11 IN (0, 1, 2) THEN 0 ELSE {N_TABLES} END AS n_tables, "
            "CASE o_orderkey % 11 WHEN 0 THEN 'no_html' WHEN 1 THEN 'no_tables' WHEN 2 THEN 'error' ELSE 'ok' END AS status "
            "FROM orders"
        ),
        "mime_project": f"""
WITH h AS ({html})
SELECT o.o_orderkey AS message_id,
  CASE o.o_orderkey % 4 WHEN 0 THEN 'Ставки по заявке ' || CAST(o.o_orderkey AS VARCHAR)
    WHEN 1 THEN 'Rates for order ' || CAST(o.o_orderkey AS VARCHAR) WHEN 2 THEN '(Без темы)'
    ELSE 'Ставка ' || CAST(o.o_orderkey AS VARCHAR) END AS subject,
  CASE o.o_orderkey % 5
    WHEN 0 THEN '"Client ' || CAST(o.o_custkey AS VARCHAR) || '" <client' || CAST(o.o_custkey AS VARCHAR) || '@example.com>'
    WHEN 1 THEN 'client' || CAST(o.o_custkey AS VARCHAR) || '@example.com'
    WHEN 2 THEN '=?utf-8?B?' || to_base64(encode('Клиент ' || CAST(o.o_custkey AS VARCHAR))) || '?= <client'
                || CAST(o.o_custkey AS VARCHAR) || '@example.com>'
    WHEN 3 THEN 'Неизвестный отправитель'
    ELSE 'a' || CAST(o.o_custkey AS VARCHAR) || '@example.com, b' || CAST(o.o_custkey AS VARCHAR) || '@example.com' END AS sender,
  CASE o.o_orderkey % 5 WHEN 3 THEN 'Неизвестный' WHEN 4 THEN NULL
    ELSE 'client' || CAST(o.o_custkey AS VARCHAR) || '@example.com' END AS sender_address,
  CASE WHEN o.o_orderkey % 6 <> 5 THEN strftime(o.o_orderdate, '%Y-%m-%d') ELSE 'Дата неизвестна' END AS date_raw,
  CASE WHEN o.o_orderkey % 11 <> 0 AND o.o_orderkey % 7 = 0 THEN md5(h.html)
    ELSE md5({text_body.replace('o_orderkey', 'o.o_orderkey')}) END AS text_md5,
  CASE WHEN o.o_orderkey % 11 = 0 THEN NULL ELSE md5(h.html) END AS html_md5
FROM orders o JOIN h ON h.message_id = o.o_orderkey""",
        "charset_cascade": f"""
SELECT o_orderkey AS message_id,
  CASE o_orderkey % 3 WHEN 2 THEN 'Commande ' || CAST(o_orderkey AS VARCHAR) || ' {chr(0x98)} prix é'
    ELSE 'Заявка ' || CAST(o_orderkey AS VARCHAR) || ': фрахт, НДС 20%' END AS text,
  CASE o_orderkey % 3 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'windows-1251' ELSE 'iso-8859-1' END AS charset
FROM orders""",
        "structured_project": f"""
WITH h AS ({html})
SELECT o.o_orderkey AS message_id,
  CASE o.o_orderkey % 4 WHEN 0 THEN 'Ставки по заявке ' || CAST(o.o_orderkey AS VARCHAR)
    WHEN 1 THEN 'Ст ' || CAST(o.o_orderkey AS VARCHAR) ELSE '(Без темы)' END AS subject,
  CASE o.o_orderkey % 3 WHEN 0 THEN 'Клиент ' || CAST(o.o_custkey AS VARCHAR) || ' <client'
    || CAST(o.o_custkey AS VARCHAR) || '@example.com>' ELSE 'Неизвестный отправитель' END AS sender,
  CASE o.o_orderkey % 3 WHEN 0 THEN 'client' || CAST(o.o_custkey AS VARCHAR) || '@example.com'
    ELSE 'Неизвестный' END AS sender_address,
  CASE WHEN o.o_orderkey % 5 <> 0 THEN strftime(o.o_orderdate, '%Y-%m-%d %H:%M:%S') ELSE 'Дата неизвестна' END AS date_raw,
  CASE WHEN o.o_orderkey % 6 <> 0 THEN {text_body.replace('o_orderkey', 'o.o_orderkey')} END AS text,
  CASE WHEN o.o_orderkey % 9 <> 0 THEN md5(h.html) END AS html_md5
FROM orders o JOIN h ON h.message_id = o.o_orderkey""",
        "mail_rates": f"SELECT * FROM ({EXP_PER_TABLE}) x WHERE message_id % 11 <> 0",
        "structured_rates": f"SELECT * FROM ({EXP_PER_TABLE}) x WHERE message_id % 9 <> 0",
        "csv_roundtrip": EXP_PER_TABLE,
        "xml_roundtrip": EXP_PER_TABLE,
        "stream_rates": f"SELECT * FROM ({EXP_PER_TABLE}) x WHERE message_id % 11 <> 0",
    }
    sql["stopword_filter_dim"] = sql["stopword_filter"]
    sql["all_or_nothing_exploded"] = sql["all_or_nothing"]
    from rateflow.plans.queries import NUMBER_POWERS

    powers = ", ".join(f"CAST({p!r} AS DOUBLE)" for p in NUMBER_POWERS)
    n_rows = f"(SELECT message_id, count(*) AS n FROM ({EXP}) e GROUP BY message_id)"
    bad = "o_orderkey % 13 = 5"
    sql |= {
        "after_last_equal": (
            "SELECT message_id, row_idx, CASE WHEN contains(entry_raw, '=') "
            f"THEN '=' || list_extract(string_split(entry_raw, '='), -1) END AS formula FROM ({GEN}) g"
        ),
        "source_stem": (
            "SELECT o_orderkey AS message_id, CASE WHEN o_orderkey % 3 = 2 THEN 'mail' "
            "ELSE 'mail.' || CAST(o_orderkey AS VARCHAR) END AS stem FROM orders"
        ),
        "number_rendering": (
            "SELECT o_orderkey AS message_id, CAST(CAST(o_orderkey AS DOUBLE) / CAST(7.0 AS DOUBLE) * "
            f"list_extract([{powers}], CAST(o_orderkey % {len(NUMBER_POWERS)} + 1 AS INT)) AS VARCHAR) AS text FROM orders"
        ),
        "new_message_count": f"SELECT count(*) AS n_new FROM ({sql['unseen_messages']}) u",
        "table_xml": table_xml_sql(),
        "reply_no_tables": (
            "SELECT o_orderkey AS message_id, CASE WHEN o_orderkey % 2 = 0 THEN 'a@example.com' END AS recipient, "
            "'Автоответ от rates@example.com' AS subject, '' AS body_html, o_orderkey % 2 = 0 AS deliverable "
            "FROM orders WHERE o_orderkey % 3 = 0"
        ),
        "quarantine": f"SELECT o_orderkey AS message_id, 'mime' AS stage FROM orders WHERE {bad}",
        "batch_lifecycle": f"""
SELECT o.o_orderkey AS message_id,
  CASE WHEN {bad} AND o_orderkey % 2 = 0 THEN 2 ELSE 1 END AS n_log,
  CASE WHEN o_orderkey % 2 = 0 AND NOT {bad} THEN 'first' ELSE 'second' END AS run_id,
  CASE WHEN {bad} THEN 'mime_error' WHEN o_orderkey % 11 = 0 THEN 'no_html' ELSE 'ok' END AS status,
  CASE WHEN {bad} OR o_orderkey % 11 = 0 THEN 0 ELSE coalesce(r.n, 0) END AS n_rate_rows,
  CASE WHEN {bad} OR o_orderkey % 11 = 0 THEN 0 ELSE 1 END AS n_outbox,
  CASE WHEN {bad} THEN 0 ELSE 1 END AS n_ledger,
  CASE WHEN {bad} THEN CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END ELSE 0 END AS n_quarantine
FROM orders o LEFT JOIN {n_rows} r ON r.message_id = o.o_orderkey""",
        "html_table_function": sql["table_cells"],
        "copy_choice": """
SELECT o_orderkey AS message_id, CAST(1 AS BIGINT) AS n_log,
  CASE WHEN o_orderkey % 4 = 1 THEN 'mime_error' WHEN o_orderkey % 11 = 0 THEN 'no_html' ELSE 'ok' END AS status,
  CASE WHEN o_orderkey % 4 = 1 OR o_orderkey % 11 = 0 THEN 0 ELSE 1 END AS n_outbox,
  CASE WHEN o_orderkey % 4 = 1 THEN 0 ELSE 1 END AS n_ledger,
  CASE WHEN o_orderkey % 4 = 1 THEN 2 ELSE 0 END AS n_quarantine
FROM orders""",
        "retry_queue": f"""
SELECT o_orderkey AS message_id,
  CASE WHEN NOT bad THEN 1 WHEN even OR third THEN 2 + CAST(even AND third AS INT) ELSE 2 END AS n_log,
  CASE WHEN bad AND NOT third THEN 'mime_error' WHEN o_orderkey % 11 = 0 THEN 'no_html' ELSE 'ok' END AS status,
  CASE WHEN (bad AND NOT third) OR o_orderkey % 11 = 0 THEN 0 ELSE 1 END AS n_outbox,
  CASE WHEN bad AND NOT third THEN 0 ELSE 1 END AS n_ledger,
  CASE WHEN NOT bad THEN 0 WHEN even THEN 2 WHEN third THEN 1 ELSE 2 END AS n_quarantine,
  CASE WHEN NOT bad THEN 0 WHEN even THEN 2 WHEN third THEN 1 ELSE 2 END AS attempts
FROM (SELECT o_orderkey, {bad} AS bad, o_orderkey % 2 = 0 AS even, o_orderkey % 3 = 0 AS third FROM orders) o""",
        "committed_batches": f"""
SELECT message_id, CAST(message_id % 4 AS VARCHAR) AS run_id, 0 AS batch_id, count(*) AS n_rows, sum(rate) AS rates
FROM ({EXP_PER_TABLE}) x WHERE message_id % 11 <> 0 AND message_id % 4 < 3 GROUP BY 1""",
        "seen_index": "SELECT o_orderkey AS message_id FROM orders WHERE year(o_orderdate) > 1995",
        "header_match_dim": """
SELECT o_orderkey AS message_id, CASE o_orderkey % 8
  WHEN 0 THEN 'наименование:0;ставка:1;вход:2' WHEN 1 THEN 'наименование:0;ставка:1;вход:2'
  WHEN 2 THEN 'наименование:1;ставка:0;вход:2' WHEN 3 THEN 'наименование:3;ставка:2;вход:0;примечание:1'
  WHEN 4 THEN 'ставка:2;вход:1' WHEN 5 THEN 'ставка:0;вход:2' WHEN 6 THEN 'наименование:0;ставка:2;услуга:1'
  ELSE 'наименование:0;вход:2' END AS found, o_orderkey % 8 IN (0, 1, 2, 3, 6) AS is_rate_table FROM orders""",
        "charset_evidence": """
SELECT o_orderkey AS message_id, CASE WHEN v IN (5, 6) THEN 'Commande ' || o_orderkey || ' : prix révisé, délai à préciser'
    || CASE v WHEN 6 THEN ' – 5 €' ELSE '' END
  WHEN v = 2 THEN 'ЗАЯВКА ' || o_orderkey || ': СТАВКА ЗА ФРАХТ И ПЕРЕВОЗКУ, НДС 20%'
  ELSE 'Заявка ' || o_orderkey || ': ставка за фрахт и перевозку, НДС 20%' END AS text,
  list_extract(['utf-8', 'windows-1251', 'koi8-r', 'ibm866', 'iso-8859-5', 'iso-8859-1', 'windows-1252', 'koi8-r'], v + 1) AS charset
FROM (SELECT o_orderkey, CAST(o_orderkey % 8 AS INT) AS v FROM orders) o""",
        "table_files": f"""
SELECT CASE message_id % 3 WHEN 0 THEN 'mail.' || message_id WHEN 1 THEN CAST(message_id AS VARCHAR) ELSE 'mail~' || message_id END
  || '_' || table_idx || CASE WHEN message_id % 2 = 0 THEN '.csv' ELSE '.xml' END AS name, content
FROM (SELECT message_id, table_idx, csv AS content FROM ({table_csv_sql()}) c WHERE message_id % 2 = 0
  UNION ALL SELECT message_id, table_idx, xml AS content FROM ({table_xml_sql()}) x WHERE message_id % 2 <> 0) f""",
        "outbox_state": """
SELECT o_orderkey AS message_id, CASE WHEN o_orderkey % 4 <> 0 THEN 'c' || o_orderkey || '@example.com' END AS recipient,
  CASE WHEN tries > 0 AND o_orderkey % 6 <> 0 THEN 'sent' WHEN o_orderkey % 4 = 0 THEN 'undeliverable' WHEN tries = 0 THEN 'pending' ELSE 'failed' END AS state,
  tries, CASE WHEN tries > 0 AND o_orderkey % 6 = 0 THEN '451 try later' END AS error,
  o_orderkey % 4 <> 0 AND tries = 0 AS due
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 0 WHEN o_orderkey % 3 <> 0 THEN 1 ELSE 2 END AS tries FROM orders) o""",
    }
    return sql
