"""Metamorphic checks on messages rendered from orders."""

from pyspark.sql import functions as F

from rateflow.plans import pipeline
from rateflow.sources import synth

SF = "/root/testdata/sf0.001"
QUOTE = (
    "\n<div>\nFrom: a@b.c\nSent: Monday\nTo: x@y.z\nSubject: RE: rates\n</div>\n"
    "<table><tr><td>Наименование</td><td>Ставка</td><td>Вход</td></tr>"
    "<tr><td>Фрахт</td><td>1</td><td>2</td></tr></table>"
)


def _mail(spark):
    o = spark.read.parquet(f"{SF}/orders.parquet").where("o_orderkey % 4 <> 0 AND o_orderkey < 400")
    return synth.html_messages(o)


def _rows(df):
    return sorted(tuple(r) for r in pipeline.extract_rates(df).collect())


def test_appending_a_quoted_thread_changes_nothing(spark):
    m = _mail(spark)
    assert _rows(m.withColumn("html", F.concat("html", F.lit(QUOTE)))) == _rows(m)


def test_header_wrapped_in_a_table_keeps_the_quoted_table(spark):
    m = _mail(spark)
    wrapped = QUOTE.replace("\n<div>", "\n<table><tr><td>").replace("</div>", "</td></tr></table>")
    base = _rows(m)
    more = _rows(m.withColumn("html", F.concat("html", F.lit(wrapped))))
    assert len(more) == len(base) + m.count()


def test_duplicating_messages_doubles_rows(spark):
    m = _mail(spark)
    assert len(_rows(m.unionAll(m))) == 2 * len(_rows(m))


def test_permuting_columns_changes_nothing_but_order(spark):
    m = _mail(spark)
    # swap the first two cells of every row (header included): the canonical columns follow
    swapped = m.withColumn(
        "html", F.regexp_replace("html", r"<tr>(<td>(?:(?!</td>).)*</td>)(<td>(?:(?!</td>).)*</td>)", "<tr>$2$1")
    )
    assert _rows(swapped) == _rows(m)
