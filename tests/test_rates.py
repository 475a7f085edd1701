"""C8, D1-D4, E2, F1-F3 through the html pipeline (FIXTURES.md §3 headers and tables)."""

from pyspark.sql import functions as F

from rateflow.operators import rates

HDR = "<tr><td>Наименование</td><td>Ставка</td><td>Вход</td></tr>"


def tr(*cells):
    return "<tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr>"


def table(*rows, header=HDR):
    return "<table>" + header + "".join(rows) + "</table>"


def test_header_variants(spark):
    cases = [
        (["Наименование", "Ставка", "Вход"], True),
        ([" Вход ", "СТАВКА", "наименование "], True),
        (["Наименование услуги", "ставка", "вход"], True),
        (["Наименование", "ВХоД", "ставка", "1"], False),
        (["Услуги", "ВХОД", "ставка"], False),
        (["ставка", "ставка", "вход"], False),
        (["наименование", "наименование услуги", "ставка"], False),
        (["Наименование", None, "Вход"], False),
    ]
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(cases)], "i INT, h ARRAY<STRING>")
    got = df.select(
        "i", rates.is_rate_header(rates.header_fields(F.col("h")), F.size("h")).alias("ok")
    ).orderBy("i").collect()
    assert [r["ok"] for r in got] == [c[1] for c in cases]


def test_normalised_rows_keep_source_order(extract):
    perm = "<tr><td>Ставка</td><td>Вход</td><td>Наименование</td></tr>"
    html = table(tr("1 000 руб", "10=20", "ФРАХТ"), tr("5", "7", "Прочее"), header=perm)
    detected, rows = extract([html])
    assert [(r.name, r.rate, r.entry) for r in rows] == [("Фрахт", 1000.0, 20.0)]
    assert detected[0]["rate_tables"][0]["fields"] == ["ставка", "вход", "наименование"]


def test_two_identical_tables_are_both_extracted(extract):
    t = table(tr("Фрахт", "1", "2"))
    _, rows = extract([t + "<p>x</p>" + t])
    assert [(r.table_idx, r.row_idx) for r in rows] == [(0, 1), (1, 1)]


def test_th_header_is_not_a_rate_table_and_others_survive(extract):
    th = "<tr><th>Наименование</th><th>Ставка</th><th>Вход</th></tr>"
    detected, rows = extract([table(tr("Фрахт", "1", "2"), header=th) + table(tr("РЖД", "3", "4"))])
    assert [t["is_rate_table"] for t in detected[0]["table_info"]] == [False, True]
    assert [(r.table_idx, r.name) for r in rows] == [(1, "Организация ЖД перевозки")]


def test_ragged_row_with_kept_name_rejects_the_whole_message(extract):
    bad = table(tr("Фрахт", "1", "2"), "<tr><td>РЖД</td><td>3</td></tr>")
    good = table(tr("Фрахт", "1", "2"))
    detected, rows = extract([good + bad, good])
    assert [r["message_failed"] for r in detected] == [True, False]
    assert {r.message_id for r in rows} == {1}


def test_ragged_row_with_stopword_name_is_accepted(extract):
    html = table(tr("Фрахт", "1", "2"), "<tr><td>Охрана</td><td>3</td></tr>")
    detected, rows = extract([html])
    assert not detected[0]["message_failed"] and len(rows) == 1


def test_ragged_row_with_name_last_is_dropped(extract):
    perm = "<tr><td>Ставка</td><td>Вход</td><td>Наименование</td></tr>"
    html = table("<tr><td>1</td><td>2</td></tr>", tr("3", "4", "Фрахт"), header=perm)
    detected, rows = extract([html])
    assert not detected[0]["message_failed"] and [(r.rate, r.entry) for r in rows] == [(3.0, 4.0)]


def test_header_only_table_counts_with_zero_rows(extract):
    detected, rows = extract([table()])
    assert len(detected[0]["rate_tables"]) == 1 and rows == []


def test_header_of_two_cells_over_three_cell_rows_is_not_a_rate_table(extract):
    two = "<tr><td>Наименование</td><td>Ставка</td></tr>"
    detected, rows = extract([table(tr("Фрахт", "1", "2"), header=two) + table(tr("РЖД", "1", "2"))])
    assert [t["is_rate_table"] for t in detected[0]["table_info"]] == [False, True]
    assert len(rows) == 1


def test_table_without_rows_default_and_strict(extract):
    html = "<table>nothing</table>" + table(tr("Фрахт", "1", "2"))
    _, rows = extract([html])
    assert len(rows) == 1
    _, rows = extract([html], strict=True)
    assert rows == []


def test_all_or_nothing_for_exploded_input(spark):
    df = spark.createDataFrame(
        [(1, "Фрахт", "1", "2"), (1, "РЖД", "1", None), (2, "Фрахт", "1", "2"), (2, "Охрана", None, None)],
        "message_id BIGINT, name_raw STRING, rate_raw STRING, entry_raw STRING",
    )
    kept = rates.all_or_nothing_rows(df).select("message_id").distinct().collect()
    assert [r[0] for r in kept] == [2]


def test_status_rows(extract, spark):
    from rateflow.plans import pipeline

    html = table(tr("Фрахт", "1", "2"), tr("Прочее", "1", "2")) + table(tr("Охрана", "1", "2"))
    df = spark.createDataFrame([(0, html)], "message_id BIGINT, html STRING")
    st = rates.message_status(pipeline.detect_rate_tables(df)).orderBy("table_idx").collect()
    assert [(r.table_idx, r.n_rows, r.reason) for r in st] == [(0, 1, "ok"), (1, 0, "ok")]


def test_th_header_option_reads_th_cells(spark):
    from rateflow.plans import pipeline

    th = "<tr><th>Наименование</th><th>Ставка</th><th>Вход</th></tr>"
    df = spark.createDataFrame([(0, table(tr("Фрахт", "1", "2"), header=th))], "message_id BIGINT, html STRING")
    assert pipeline.rate_rows_from_detected(pipeline.detect_rate_tables(df)).count() == 0
    rows = pipeline.rate_rows_from_detected(pipeline.detect_rate_tables(df, th_as_td=True)).collect()
    assert [(r.name, r.rate, r.entry) for r in rows] == [("Фрахт", 1.0, 2.0)]
