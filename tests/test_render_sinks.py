"""Reply html, outbox, CSV/XML exports, process log."""

from pyspark.sql import functions as F

from rateflow.operators import render
from rateflow.plans import pipeline
from rateflow.sinks import files

HDR = "<tr><td>Ставка</td><td>Наименование</td><td>Вход</td></tr>"


def _detected(spark, htmls):
    rows = [(i, h, f"u{i}@x.ru" if i else None) for i, h in enumerate(htmls)]
    df = spark.createDataFrame(rows, "message_id BIGINT, html STRING, sender_address STRING")
    return pipeline.detect_rate_tables(df, carry=["sender_address"])


def test_reply_html_format(spark):
    t = f"<table>{HDR}<tr><td>1 234,5</td><td>Фрахт</td><td>=10000000</td></tr></table>"
    d = _detected(spark, [t + t, "<p>no tables</p>"])
    out = {r.message_id: r for r in render.outbox(d, "me@x.ru").collect()}
    one = "\n".join([
        render.TABLE_OPEN, "<tr>", "  <th>ставка</th>", "  <th>наименование</th>", "  <th>вход</th>", "</tr>",
        "<tr>", "  <td>1234.0</td>", "  <td>Фрахт</td>", "  <td>10000000.0</td>", "</tr>", "</table>",
    ])
    assert out[0].body_html == one + "\n+\n" + one
    assert out[0].subject == "Автоответ от me@x.ru" and out[0].deliverable is False
    assert out[1].body_html == "" and out[1].recipient == "u1@x.ru"


def test_csv_and_xml_roundtrip_dataset_layout(spark, tmp_path):
    t = f"<table>{HDR}<tr><td>5</td><td>РЖД</td><td>по запросу</td></tr></table>"
    rows = pipeline.rate_rows_from_detected(_detected(spark, [t]))
    for fmt in ("csv", "xml"):
        path = str(tmp_path / fmt)
        files.write_rate_tables(rows, path, fmt=fmt)
        back = files.read_rate_tables(spark, path, fmt=fmt).collect()
        assert [(r.name, r.rate, r.entry) for r in back] == [("Организация ЖД перевозки", 5.0, None)]


def test_per_table_layout_one_directory_per_table(spark, tmp_path):
    t = f"<table>{HDR}<tr><td>5</td><td>РЖД</td><td>7</td></tr></table>"
    rows = pipeline.rate_rows_from_detected(_detected(spark, [t + t]))
    path = str(tmp_path / "per")
    files.write_rate_tables(rows, path, fmt="csv", layout="per_table")
    dirs = sorted(p.name for p in (tmp_path / "per" / "message_id=0").iterdir())
    assert dirs == ["table_idx=0", "table_idx=1"]
    text = "".join(p.read_text() for p in (tmp_path / "per" / "message_id=0" / "table_idx=0").glob("*.csv"))
    assert text == "наименование,ставка,вход\nОрганизация ЖД перевозки,5.0,7.0\n"


def test_unknown_format_raises(spark, tmp_path):
    import pytest

    rows = spark.createDataFrame([], "message_id BIGINT, table_idx INT, row_idx INT, name STRING, rate DOUBLE, entry DOUBLE")
    with pytest.raises(ValueError):
        files.write_rate_tables(rows, str(tmp_path / "x"), fmt="json")


def test_process_log_statuses(spark):
    bad = "<table><tr><td>Наименование</td><td>Ставка</td><td>Вход</td></tr><tr><td>Фрахт</td><td>1</td></tr></table>"
    d = _detected(spark, ["<p>x</p>", bad, None])
    log = {r.message_id: r for r in pipeline.process_log(d, batch_id=7).collect()}
    assert (log[0].status, log[1].status, log[2].status) == ("no_tables", "error", "no_html")
    assert log[1].n_tables == 0 and log[0].batch_id == 7
    assert log[1].detail.startswith("ОШИБКА!") and log[0].detail.startswith("Успешно обработано <0>")


def test_table_csv_files_in_source_column_order(spark, tmp_path):
    t = f"<table>{HDR}<tr><td>1 234,5</td><td>Фрахт</td><td>10=15</td></tr><tr><td>x</td><td>РЖД</td><td>7</td></tr></table>"
    plain = "<table><tr><td>Наименование</td><td>Ставка</td><td>Вход</td></tr><tr><td>Охрана</td><td>1</td><td>2</td></tr></table>"
    d = _detected(spark, [t + plain])
    path = tmp_path / "csv"
    files.write_table_csv_files(d, str(path))
    got = {p.parent.name: p.read_text(encoding="utf-8") for p in (path / "message_id=0").glob("*/*.txt")}
    assert got == {
        "table_idx=0": "ставка,наименование,вход\n1234.0,Фрахт,15.0\n,Организация ЖД перевозки,7.0\n",
        "table_idx=1": "наименование,ставка,вход\n",
    }


def test_outbox_skip_empty_keeps_only_non_empty_replies(spark):
    t = f"<table>{HDR}<tr><td>5</td><td>Фрахт</td><td>7</td></tr></table>"
    bad = "<table><tr><td>Наименование</td><td>Ставка</td><td>Вход</td></tr><tr><td>Фрахт</td><td>1</td></tr></table>"
    d = _detected(spark, [t, "<p>none</p>", bad])
    out = render.outbox(d, "me@x.ru", skip_empty=True).collect()
    assert [r.message_id for r in out] == [0] and out[0].body_html.startswith(render.TABLE_OPEN)


def test_log_table(spark, tmp_path):
    d = _detected(spark, ["<p>x</p>", "<p>y</p>"])
    files.write_process_log(pipeline.process_log(d, batch_id=3), str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    assert log.count() == 2 and {r.batch_id for r in log.collect()} == {3}


def test_dimension_frames(spark):
    from rateflow import dims

    aliases = {r.alias: r.field for r in dims.field_alias_frame(spark).collect()}
    assert aliases["наименование услуги"] == "наименование" and len(aliases) == 4
    kw = dims.keyword_row(dims.service_keyword_frame(spark)).first().keywords
    assert [(r.keyword, r.service) for r in kw] == [(k, s) for k, s in dims.SERVICE_KEYWORDS]
    assert [r.word for r in dims.stopword_frame(spark).collect()] == ["охрана"]


def test_reply_equals_the_csv_text_rendered_as_html(spark):
    """The reply is the tables' CSV text formatted as HTML (first line th, others td, cells
    stripped, tables joined by '\\n+\\n'): checked on every message of sf0.001."""
    from pyspark.sql import functions as F

    from rateflow.plans.queries import QUERIES

    def as_html(csv_text):
        out = [render.TABLE_OPEN]
        for i, line in enumerate(csv_text.strip().split("\n")):
            tag = "th" if i == 0 else "td"
            out.append("<tr>")
            out += [f"  <{tag}>{cell.strip()}</{tag}>" for cell in line.split(",")]
            out.append("</tr>")
        out.append("</table>")
        return "\n".join(out)

    csv = QUERIES["table_csv"](spark, "/root/testdata/sf0.001").groupBy("message_id").agg(
        F.sort_array(F.collect_list(F.struct("table_idx", "csv"))).alias("tables")
    )
    expected = {r.message_id: "\n+\n".join(as_html(t.csv) for t in r.tables) for r in csv.collect()}
    replies = {r.message_id: r.body_html for r in QUERIES["html_reply"](spark, "/root/testdata/sf0.001").collect()}
    assert len(expected) == 1500 and all(replies[k] == v for k, v in expected.items())


def test_dictionary_table_takes_the_lowest_priority(spark):
    from rateflow import dims
    from rateflow.functions import text as tx

    dim = spark.createDataFrame([("ab", "late", 5), ("b", "first", 1), (None, "x", 0), ("", "y", 0)], "keyword STRING, service STRING, prio INT")
    df = spark.createDataFrame([("xABy",), ("a",), (None,)], "s STRING")
    got = tx.with_services(df, "s", dim, "v")
    assert got.columns == ["s", "v"] and {r.s: r.v for r in got.collect()} == {"xABy": "first", "a": "", None: None}
    assert {r.s: r.v for r in tx.with_services(df, "s", dim.limit(0), "v").collect()} == {"xABy": "", "a": "", None: None}
    big = spark.range(20_000).selectExpr("concat('key', id) AS keyword", "concat('s', id) AS service", "int(id) AS prio")
    one = spark.createDataFrame([("has key19999 inside",)], "s STRING")
    assert tx.with_services(one, "s", big, "v").first().v == "s1"


def test_round_trip_of_text_keys_and_table_xml(spark, tmp_path):
    t = f"<table>{HDR}<tr><td>0,5</td><td>Фрахт</td><td>x</td></tr><tr><td>2</td><td>РЖД</td><td>0.00012345678901234</td></tr></table>"
    df = spark.createDataFrame([("file:/a/b.eml", t)], "message_id STRING, html STRING")
    d = pipeline.detect_rate_tables(df)
    rows = pipeline.rate_rows_from_detected(d)
    for fmt in ("csv", "xml"):
        path = str(tmp_path / fmt)
        files.write_rate_tables(rows, path, fmt=fmt)
        back = files.read_rate_tables(spark, path, fmt=fmt, key_type="STRING")
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    files.write_table_xml_files(d, str(tmp_path / "tables"))
    (file,) = (tmp_path / "tables").rglob("*.txt")
    assert file.read_text() == "\n".join([
        "<?xml version='1.0' encoding='utf-8'?>", "<data>",
        "  <row>", "    <ставка>0.0</ставка>", "    <наименование>Фрахт</наименование>", "    <вход/>", "  </row>",
        "  <row>", "    <ставка>2.0</ставка>", "    <наименование>Организация ЖД перевозки</наименование>", "    <вход>0.00012345678901234</вход>", "  </row>",
        "</data>", "",
    ])


def test_numbers_are_written_as_python_does(spark):
    import random
    import struct

    from rateflow.functions.text import render_number

    rnd = random.Random(4)
    values = [struct.unpack("<d", struct.pack("<Q", rnd.getrandbits(64)))[0] for _ in range(20_000)]
    values += [rnd.uniform(-1, 1) * 10 ** rnd.randint(-300, 300) for _ in range(20_000)]
    values += [round(rnd.uniform(0, 1e7), rnd.randint(0, 12)) for _ in range(20_000)]
    values += [0.0, -0.0, 1e16, 9999999999999998.0, 1e15, 1e-4, 9.999e-5, 1e100, 1.5e-120, 5e-324, 1.7976931348623157e308, 0.30000000000000004, 2.0**-44, 1e23, 2e-3, 1e22, 123456789.0, 1e7]
    values += [float("inf"), float("-inf")]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values) if v == v], "i INT, v DOUBLE").select("i", "v", render_number("v").alias("s"))
    rows = df.collect()
    assert all(float(r.s) == r.v and len(r.s) == len(repr(r.v)) for r in rows)
    # in exponent form Java's 17th digit may be the second nearest; it still reads back the same
    assert [(r.v, r.s) for r in rows if 1e-4 <= abs(r.v) < 1e16 and r.s != repr(r.v)] == []
    assert sum(r.s != repr(r.v) for r in rows) <= len(rows) / 5000
