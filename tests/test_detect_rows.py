"""The extraction's own detection and the rendering without arrays (F15) against the full ones."""

from rateflow.operators import markup, rates, thread
from rateflow.sources import synth

HEAD = "<tr><td>Наименование</td><td>Ставка</td><td>Вход</td></tr>"
ROW = "<tr><td>Фрахт</td><td>1</td><td>2</td></tr>"
QUOTE = "\nFrom: a<br>\nSent: today<br>\nTo: b<br>\nSubject: c<br>\n"
PLAIN = [
    f"<p>a</p><table>{HEAD}{ROW}</table>",
    f"<TABLE border=\"1\">\n{HEAD.upper()}\n{ROW}</TABLE>{QUOTE}<table>{HEAD}{ROW}</table>",
    f"<table>{HEAD}<tr><td> x </td><td><p> 1 </p><p>\n </p><p></p></td><td>\t</td></tr></table>",
    f"<table>\n</table><table><tr></tr>{HEAD}<tr><td>Фрахт</td><td>1</td></tr></table>",
    f"<table><tr><td>Sent: a</td></tr>\n<tr><td>To: b</td></tr>\n<tr><td>Subject: c</td></tr></table>\n<table>{HEAD}{ROW}</table>",
    f"<table>{HEAD}{ROW}{ROW}<tr><td>a</td><td>b</td><td>c</td><td>d</td></tr></table><table>{HEAD}</table>",
]
OTHER = [
    None, "", "<p>no table</p>", f"<table>{HEAD}<tr><td>a&nbsp;b</td><td>&#49;</td><td>2</td></tr></table>",
    f"<table><tr><td><table>{HEAD}{ROW}</table></td></tr></table>", f"<table>{HEAD}<tr><td>a<td>1<td>2</table>",
    f"<table>{HEAD}{ROW}", f"<!-- <table> --><table>{HEAD}{ROW}</table>", f"\x01<table>{HEAD}{ROW}</table>", f"<ta\x01ble>{HEAD}</table>",
    f"<script><table></script><table>{HEAD}{ROW}</table>", f"<table><tr><th>Вход</th></tr>{ROW}</table>{QUOTE}<table",
]


def test_lean_detection_gives_the_rows_of_the_full_one(spark):
    mail = spark.createDataFrame(list(enumerate(PLAIN + OTHER)), "message_id int, html string")
    tables = thread.cut_thread(markup.parse_html(mail))
    lean, full = (sorted(map(str, rates.candidate_rows(d(tables)).collect())) for d in (rates.detect_rows, rates.detect))
    assert lean == full and lean


def test_html_written_out_row_by_row_is_the_same(spark):
    orders = [(k, 7 * (k or 0), None) for k in [*range(-12, 241), 10**12 + 7, None]] + [(3, None, None)]
    orders = spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz")
    ours, theirs = (sorted(map(str, d.collect())) for d in (synth._with_html(orders), synth.html_messages(orders)))
    assert ours == theirs
