"""The plain readers of markup and mail give what the full parsers give, and are taken."""

import base64
import email

import pyarrow as pa
import pytest

from rateflow.operators import markup
from rateflow.sources import messages

ROWS = '<tr><td class="a"> x &amp; y </td><td><p> p </p>\n<p>q</p></td><td></td></tr>\n<tr></tr>'
QUOTE = "\n<p>From: a\nSent: b\nTo: c\nSubject: d</p>\n"
PLAIN = [
    f"<p>a</p><table>{ROWS}</table>b<br/><TABLE border=\"1\"><TR><TD><p> \n</p></TD></TR></TABLE>",
    f"<div><table>{ROWS}</table></div>{QUOTE}<table>{ROWS}</table>",
    f"<table><tr><td>x{QUOTE}</td></tr></table><table>{ROWS}</table>",
]
OTHER = [
    "<table><tr><td>a<b> b</b></td></tr></table>", "<script><table></script><table><tr><td>a</td></tr></table>",
    "<table><tr><td>a</table>", "<table><tr\n><td>a</td></tr></table>", "<table><tr><td>&#10;a</td></tr></table>", "<!-- <table> -->",
]


@pytest.mark.parametrize("newest", [False, True])
@pytest.mark.parametrize("html", PLAIN + OTHER)
def test_plain_markup_reads_as_the_tree(monkeypatch, html, newest):
    assert (markup._plain_tables(html, newest) is not None) == (html in PLAIN)
    got = markup.split_segments(html, newest)
    monkeypatch.setattr(markup, "_plain_tables", lambda *_: None)
    assert got == markup.split_segments(html, newest)


def test_batches_are_taken_in_slices():
    batch = pa.RecordBatch.from_pydict({"x": list(range(1200))})
    assert [b.num_rows for b in markup.slices([batch])] == [512, 512, 176]


B64 = base64.encodebytes(b"<p>html</p>" * 9).replace(b"\n", b"\r\n")
PART = b"--=_b\r\nContent-Type: text/%b; charset=utf-8\r\nContent-Transfer-Encoding: %b\r\n\r\n%b"
HEAD = b'From: "A B" <a.b@c.de>\r\nSubject: s\r\nContent-Type: multipart/alternative; boundary="=_b"\r\n\r\n'
MAIL = HEAD + PART % (b"plain", b"7bit", b"a\r\nb\r\n") + PART % (b"html", b"base64", B64) + b"--=_b--\r\n"


@pytest.mark.parametrize("want_text", [False, True])
@pytest.mark.parametrize(
    "raw,plain",
    [
        (MAIL, True),
        (MAIL.replace(b"\r\n", b"\n"), True),
        (b"content-type: text/html\r\nFROM:  a@b.c, d@e.f\r\n\r\nx\r\n", True),
        (MAIL.replace(b"7bit", b"quoted-printable"), None),
        (MAIL.replace(b"Subject: s", b"Subject: s\r\n t"), False),
        (MAIL.replace(b"--=_b--", b""), False),
        (MAIL.replace(b"\r\n", b"\n", 1), False),
        (MAIL.replace(b"A B", b"\xd0\x90"), False),
    ],
)
def test_plain_mail_reads_as_the_parser(monkeypatch, raw, plain, want_text):
    read = messages._PlainMessage.read(raw)
    if plain is None:
        assert read.bodies(True) is None
    else:
        assert (read is not None) == plain
    got = messages.project_message(raw, want_text)
    monkeypatch.setattr(messages._PlainMessage, "read", lambda _: None)
    assert got == messages.project_message(raw, want_text)


@pytest.mark.parametrize("levels", [3, 200, 2000])
def test_deep_mail_is_refused_without_reading_it(monkeypatch, levels):
    raw = b"X: 1\r\n" + b"Content-Type: message/rfc822\r\n\r\n" * levels
    seen = []
    real = email.message_from_bytes
    monkeypatch.setattr(email, "message_from_bytes", lambda b: seen.append(1) or real(b))
    if levels < 2000:
        messages.project_message(raw)
        assert seen
    else:
        with pytest.raises(RecursionError, match="maximum recursion depth exceeded"):
            messages.project_message(raw)
        assert not seen
    if levels == 2000:
        with pytest.raises(RecursionError, match="maximum recursion depth exceeded"):
            real(raw)


def test_refused_bytes_are_written_once_and_not_cached(spark, tmp_path, monkeypatch):
    from rateflow.plans import pipeline
    from rateflow.streaming import commits, stream

    deep, out, chosen = b"Content-Type: message/rfc822\r\n\r\n" * 2000, str(tmp_path / "out"), []
    real = stream._choose
    monkeypatch.setattr(stream, "_choose", lambda d, *a: chosen.append(d.columns) or real(d, *a))
    rows = [("a", MAIL), ("a", deep), ("b", deep), ("b", b"X: 1\r\n" + deep), ("c", MAIL)]
    pipeline.process_messages(spark.createDataFrame(rows, "message_id STRING, content BINARY"), out, "x@y.z", "1")
    assert len(chosen) == 1 and "failed_content" not in chosen[0]
    assert sorted(r[0] for r in commits.committed(spark, out, "ledger").select("message_id").collect()) == ["a", "c"]
    held = commits.committed(spark, out, "quarantine").select("message_id", "content").collect()
    assert sorted((r[0], bytes(r[1])) for r in held) == [("b", deep), ("b", b"X: 1\r\n" + deep)]
    assert not (tmp_path / "out" / "_parsed" / "run_id=1" / "batch_id=0").exists()
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_named_files_are_read_by_their_report(spark, tmp_path):
    from rateflow.sinks import named_files as nf

    out = str(tmp_path / "files")
    rows = [("a_0.csv", "x\ny\n"), ("б 1.xml", "ж"), ("a_0.csv", "x\ny\n"), ("no/name", "z"), ("empty.csv", None)]
    report = nf.write_named_files(spark.createDataFrame(rows, "name STRING, content STRING"), out, f"{out}-report")
    read = nf.read_named_files(report, out)
    assert read.columns == ["name", "content"]
    assert sorted(map(tuple, read.collect())) == [("a_0.csv", "x\ny\n"), ("empty.csv", ""), ("б 1.xml", "ж")]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["rate_table_status", "table_headers", "html_cells_roundtrip"])
def test_derived_arrays_are_unpacked_without_a_second_evaluation(spark, name):
    import __spark_entry__ as entry

    plan = _plan(entry.queries()[name](spark, entry.SMOKE_DIR))
    assert plan.count("(?imdU)") == 1  # the cut, with all that detection makes of it, once a message


@pytest.mark.parametrize("name", ["table_xml", "html_reply"])
def test_reply_numbers_are_read_once(spark, name):
    import __spark_entry__ as entry

    plan = _plan(entry.queries()[name](spark, entry.SMOKE_DIR))
    assert plan.count("translate(") == 2  # one for the rate, one for the entry


def test_texts_without_the_first_word_of_a_header_are_not_searched(spark):
    from pyspark.sql import functions as F

    from rateflow.operators import thread

    letters = [(chr(c),) for c in range(1, 0x20000) if not 0xD800 <= c < 0xE000]
    d = spark.createDataFrame(letters, "c STRING").where(F.col("c").rlike("(?imdU)^[sentотправлено:]$"))
    assert d.where(~F.upper("c").isin(list("SENTОТПРАВЛЕНО:"))).count() == 0
    assert d.count() > 24  # other letters than the plain ones, such as the long s, count as them
    texts = ["a\nSENT: x\nTo: y\nsubject: z\nb", "ſent: x\nto: y\nsubject: z", "sent:", "none", "", None]
    d = spark.createDataFrame([(t,) for t in texts], "t STRING")
    got = d.select(thread.newest_part(F.col("t")), thread.thread_parts(F.col("t"))).collect()
    want = d.select(F.element_at(F.split("t", thread.REPLY_SPLIT, 2), 1), F.split("t", thread.REPLY_SPLIT)).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]


def test_only_lines_with_its_first_word_are_tried_as_a_header(monkeypatch):
    from rateflow.operators import markup

    rest, real = "\nTo: x\nSubject: y\n", markup._first_header("sent:\nto:\nsubject:").re
    texts = ["a: b\n" * 50 + "<b>Sent:</b> 1 sent: 2" + rest, "SENT:" + rest, "sent:\n\nto:\nsent: a" + rest + "sent: b" + rest,
             "a\r\nотправлено: 1\r\nКому: 2\r\nтема: 3\r\nend", "ſent: x" + rest, "sent: nothing else", "none\n"]
    found = [(m := markup._first_header(t)) and m.span() for t in texts]
    assert found == [(m := real.search(t)) and m.span() for t in texts]
    tried = []

    class Pattern:
        def match(self, text, at):
            tried.append(at)
            return real.match(text, at)

    monkeypatch.setattr(markup, "_REPLY_HEADER", Pattern())
    assert markup._first_header(texts[0]).start() == 250
    assert tried == [250]


def test_table_function_sends_no_arrow_batch_for_a_message(spark):
    import __spark_entry__ as entry

    assert "ArrowEvalPythonUDTF" not in entry.queries()["html_table_function"](spark, entry.SMOKE_DIR)._jdf.queryExecution().executedPlan().toString()
