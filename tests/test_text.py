"""E1, E3-E8, D3 and number rendering (column functions) against hand cases and a Python model."""

import re

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from rateflow.functions import text as tx

NBSP = "\u00a0"


def _one(spark, fn, values, schema="v STRING"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(fn(F.col("v"))).collect()]


def test_e3_first_number_hand_cases(spark):
    cases = {
        "1 234.50 USD": 1234.5, f"1{NBSP}234,50": 1234.0, "abc\n 55 руб": 55.0, "-7": 7.0,
        "12.": 12.0, ".5": 5.0, "1.2.3": 1.2, "no": None, "1 000\n000": 1000.0,
        "20DC 1500": 20.0, "10 %\r\n": 10.0, "": None, "по запросу": None,
    }
    got = _one(spark, tx.first_number, list(cases))
    assert dict(zip(cases, got)) == cases


def test_e5_entry_number(spark):
    cases = {"100+200=300": 300.0, "55": 55.0, "a=b=": None, "10 + 5 = 15 руб": 15.0, "=": None}
    assert dict(zip(cases, _one(spark, tx.entry_number, list(cases)))) == cases


def test_e4_after_last_equal(spark):
    assert _one(spark, tx.after_last_equal, ["a=b=c", "x", "=1"]) == ["=c", None, "=1"]


def test_e1_header_key_strips_python_whitespace(spark):
    vals = [f"{NBSP}СТАВКА ", "\tВход\x1c", "Наименование услуги", "  "]
    assert _one(spark, tx.header_key, vals) == ["ставка", "вход", "наименование услуги", ""]


def test_e6_service_dictionary_order(spark):
    cases = {
        "ФРАХТ морской": "Фрахт", "Вознаграждение экспедитора": "Транспортно-Экспедиторское обслуживание",
        "Тариф РЖД": "Организация ЖД перевозки", "Автовывоз до РЖД": "Организация ЖД перевозки",
        "Организация автоперевозки": "Организация автовывоза", "Прочее": "", "": "",
        "Охрана и фрахт": "Фрахт",
    }
    assert dict(zip(cases, _one(spark, tx.service_name, list(cases)))) == cases


def test_d3_stopwords_case_insensitive_and_null(spark):
    vals = ["Охрана груза", "ОХРАНА", "Фрахт", "", None]
    assert _one(spark, tx.keeps_row, vals) == [False, False, True, True, False]


def test_e8_source_stem(spark):
    vals = ["/data/in/msg 1.eml", "file:/x/y/z.tar.msg", "plain"]
    assert _one(spark, tx.source_stem, vals) == ["msg 1", "z.tar", "plain"]


def test_render_number_like_pandas(spark):
    vals = [1234.5, 35.0, 10000000.0, 0.1, None, 91000.0, 1e16, 1.2345e20, 1e-05, 1.5e-07, 0.0001, 0.0, -2e17]
    got = _one(spark, tx.render_number, vals, "v DOUBLE")
    assert got == [None if v is None else repr(v) for v in vals]


# ------------------------------------------------------------------ property tests

def _py_first_number(text):
    """Model: drop every whitespace character except newlines, take the first ASCII number."""
    squeezed = "".join(ch for ch in text if ch == "\n" or not ch.isspace())
    m = re.search(r"[0-9]+(?:\.[0-9]+)?", squeezed)
    return float(m.group(0)) if m else None


_ALPHABET = st.sampled_from(list("0123456789.,=-+ abcя\n\r\t") + [NBSP, "\x1c", "\x85", "\u2009", "\u3000"])


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(_ALPHABET, max_size=24), min_size=1, max_size=60))
def test_property_first_number_and_entry_match_python_model(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "v STRING")
    got = df.select(tx.first_number("v"), tx.entry_number("v"), tx.header_key("v")).collect()
    for t, (a, b, c) in zip(texts, got):
        assert a == _py_first_number(t), t
        assert b == _py_first_number(t.rsplit("=", 1)[-1]), t
        assert c == t.strip().lower(), t


def test_digits_of_other_scripts_are_numbers(spark):
    from rateflow.functions.text import entry_number, first_number

    df = spark.createDataFrame([("٣٤",), ("x १२ ३.५",), ("=１=２",), ("²",), ("𝟗1",)], "s STRING")
    got = [tuple(r) for r in df.select(first_number("s"), entry_number("s")).collect()]
    assert got == [(34.0, 34.0), (123.5, 123.5), (1.0, 2.0), (None, None), (91.0, 91.0)]
