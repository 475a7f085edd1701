"""C1, C7, C8 and the table cases of FIXTURES.md §3 ("Tables and threads")."""

from rateflow.operators.markup import split_segments

H = "<tr><td>Наименование</td><td>Ставка</td><td>Вход</td></tr>"


def _tables(html):
    return [s for s in split_segments(html) if s["kind"] == "table"]


def test_segments_cover_the_text_and_spans_are_source_slices():
    html = f"<p>a</p>\n<table>{H}</table>\n<p>b</p><TABLE><tr><td>x</td></tr></TABLE>tail"
    segs = split_segments(html)
    assert "".join(s["html"] for s in segs) == html
    tabs = [s for s in segs if s["kind"] == "table"]
    assert [t["table_idx"] for t in tabs] == [0, 1]
    assert tabs[0]["html"] == f"<table>{H}</table>"
    assert tabs[1]["html"] == "<TABLE><tr><td>x</td></tr></TABLE>"
    assert tabs[0]["rows"] == [["Наименование", "Ставка", "Вход"]]


def test_nested_table_is_part_of_the_outer_one_and_its_rows_repeat():
    html = (
        "<table><tr><td>\n<table>" + H + "<tr><td>Фрахт</td><td>100</td><td>200</td></tr></table>\n"
        "</td></tr></table>"
    )
    tabs = _tables(html)
    assert len(tabs) == 1
    rows = tabs[0]["rows"]
    assert rows[0] == ["НаименованиеСтавкаВходФрахт100200", "Наименование", "Ставка", "Вход", "Фрахт", "100", "200"]
    assert rows[1:] == [["Наименование", "Ставка", "Вход"], ["Фрахт", "100", "200"]]


def test_cell_text_rules():
    html = "<table><tr><td><p>a</p><p> b</p></td><td><p> a </p></td><td> a <b> b</b></td></tr></table>"
    assert _tables(html)[0]["rows"] == [["a\n b", " a ", "ab"]]


def test_th_cells_are_ignored_and_entities_decoded():
    html = "<table><tr><th>Наименование</th></tr><tr><td>A&amp;B&nbsp;</td></tr></table>"
    assert _tables(html)[0]["rows"] == [[], ["A&B"]]


def test_unclosed_td_and_p_nest():
    html = "<table><tr><td>a<td>b</tr></table>"
    assert _tables(html)[0]["rows"] == [["ab", "b"]]


def test_comments_scripts_and_styles_are_not_text():
    html = "<table><tr><td>a<!-- c --><script>x=1</script><style>p{}</style>b</td></tr></table>"
    assert _tables(html)[0]["rows"] == [["ab"]]


def test_end_tag_closes_an_open_table_and_unclosed_table_runs_to_the_end():
    html = "<div><table><tr><td>x</td></div>after<table><tr><td>y</td>"
    tabs = _tables(html)
    assert [t["html"] for t in tabs] == ["<table><tr><td>x</td>", "<table><tr><td>y</td>"]
    assert [t["rows"] for t in tabs] == [[["x"]], [["y"]]]


def test_table_without_rows_has_an_empty_grid():
    assert _tables("<table>no rows</table>")[0]["rows"] == []


def test_no_table_fast_path():
    segs = split_segments("<p>no tables here</p>")
    assert segs == [{"kind": "text", "html": "<p>no tables here</p>", "start": 0, "end": 21, "table_idx": None, "rows": None}]


def test_long_views_and_sql_table_function(spark):
    from rateflow.operators.markup import html_segments, parse_html, register_udtfs, table_cells

    html = "<p>a</p><table><tr><td>x</td><td>y</td></tr><tr><td>z</td></tr></table>b"
    df = spark.createDataFrame([(5, html)], "message_id BIGINT, html STRING")
    p = parse_html(df)
    segs = html_segments(p).orderBy("seg_idx").collect()
    assert [(s.kind, s.table_idx) for s in segs] == [("text", None), ("table", 0), ("text", None)]
    cells = sorted(tuple(r)[1:] for r in table_cells(p).collect())
    assert cells == [(0, 0, 0, "x"), (0, 0, 1, "y"), (0, 1, 0, "z")]
    register_udtfs(spark)
    df.createOrReplaceTempView("mail_udtf_test")
    got = spark.sql(
        "SELECT m.message_id, c.* FROM mail_udtf_test m, LATERAL html_table_cells(m.html) c"
    ).collect()
    assert sorted(tuple(r)[1:] for r in got) == cells


def test_adjacent_text_is_one_string_and_whitespace_only_strings_collapse():
    from rateflow.operators.markup import split_segments

    html = (
        "<table><tr><td>a < b</td><td><p><b>a</b>\n   <b>b</b></p></td>"
        "<td><p>  </p></td><td><pre>x<b>y</b>  </pre></td><td>a <!-- c --> b</td></tr></table>"
    )
    rows = [s for s in split_segments(html) if s["kind"] == "table"][0]["rows"]
    assert rows == [["a < b", "a\nb", " ", "xy", "ab"]]


def test_cdata_is_text_but_doctype_and_processing_instructions_are_not():
    from rateflow.operators.markup import split_segments

    html = "<!DOCTYPE html><table><tr><td>a<![CDATA[ b ]]>c<?pi x?>d</td></tr></table>"
    rows = [s for s in split_segments(html) if s["kind"] == "table"][0]["rows"]
    assert rows == [["abcd"]]


def test_columnar_arrow_conversion_equals_the_nested_one():
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    from rateflow.operators.markup import SEGMENTS_TYPE, segments_to_arrow, split_segments

    docs = ["<p>x</p>", "<table><tr><td>a</td></tr><tr></tr></table>t<table></table>", "",
            "<table><tr><td><p>1</p><p>2</p></td><td>b</td></tr></table>"]
    segs = [split_segments(d) for d in docs] + [None]
    typ = to_arrow_type(SEGMENTS_TYPE)
    assert segments_to_arrow(segs, typ).equals(pa.array(segs, typ))


def test_self_closed_tables_end_at_their_own_tag():
    from rateflow.operators.markup import split_segments

    t = "<table><tr><td>a</td></tr></table>"
    html = f"x<table/>y{t}z<TABLE class='q' />Sent: a\nTo: b\nSubject: c\n{t}end"
    segments = split_segments(html)
    assert [s["kind"] for s in segments] == ["text", "table"] * 4 + ["text"]
    assert [s["html"] for s in segments] == ["x", "<table/>", "y", t, "z", "<TABLE class='q' />", "Sent: a\nTo: b\nSubject: c\n", t, "end"]
    assert [s["rows"] for s in segments if s["kind"] == "table"] == [[], [["a"]], [], [["a"]]]


def test_self_closed_table_does_not_open_the_quoted_thread(extract):
    hdr = "<tr><td>Наименование</td><td>Ставка</td><td>Вход</td></tr>"
    new = f"<table>{hdr}<tr><td>Фрахт</td><td>1</td><td>2</td></tr></table>"
    old = f"<table>{hdr}<tr><td>Фрахт</td><td>8</td><td>9</td></tr></table>"
    _, rows = extract([f"<table/>{new}<table/><p>&#58;</p>\nSent: a\nTo: b\nSubject: c\n{old}"])
    assert [(r.rate, r.entry) for r in rows] == [(1.0, 2.0)]
