"""Charset by evidence, field consumption with an alias table, and counts without a job."""

import random

from pyspark.sql import functions as F

from rateflow import dims
from rateflow.functions import charset as cs
from rateflow.operators import rates
from rateflow.sources import messages

TEXTS = ["Фрахт", "ставка за контейнер", "СТАВКА ЗА КОНТЕЙНЕР", "Добрый день! Просим выставить счёт на перевозку.",
         "<p>Организация автовывоза со станции</p>", "Наименование услуги: экспедирование, вознаграждение агента"]


def charsets(spark, bodies):
    df = spark.createDataFrame([(i, bytearray(b) if b is not None else None) for i, b in enumerate(bodies)], "id INT, body BINARY")
    out = df.select("id", cs.charset_by_evidence(F.col("body")).alias("c"), cs.decode_by_evidence(F.col("body")).alias("t"))
    return [(r.c, r.t) for r in sorted(out.collect(), key=lambda r: r.id)]


def test_cyrillic_charsets(spark):
    cases = [(t, c) for t in TEXTS for c in cs.CYRILLIC]
    assert charsets(spark, [t.encode(c) for t, c in cases]) == [(c, t) for t, c in cases]


def test_western_utf8_and_empty(spark):
    bodies = ["Prix révisé à 5".encode("latin-1"), "L’été – 5 €".encode("cp1252"), "Größe, Maß".encode("latin-1"),
              "﻿да".encode(), b"plain", b"", None]
    assert charsets(spark, bodies) == [
        ("iso-8859-1", "Prix révisé à 5"), ("windows-1252", "L’été – 5 €"), ("iso-8859-1", "Größe, Maß"),
        ("utf-8", "да"), ("utf-8", "plain"), (None, None), (None, None)]


def test_no_evidence_goes_by_the_cascade(spark):
    rng = random.Random(1)
    bodies = [bytes([0xB9]), bytes([0x98, 0x20, 0xB9])] + [bytes(rng.randrange(256) for _ in range(n)) for n in range(1, 40)]
    got = charsets(spark, bodies)
    assert got[0] == ("windows-1251", "№") and got[1][0] == "iso-8859-1"
    assert all(c is not None and t is not None for c, t in got)


def test_mail_without_a_charset_is_read(spark):
    mail = [(i, bytearray(b"Subject: x\r\nContent-Type: text/html\r\n\r\n<p>" + TEXTS[3].encode(c) + b"</p>")) for i, c in enumerate(cs.CYRILLIC)]
    raw = spark.createDataFrame(mail, "message_id INT, content BINARY")
    assert {r.html for r in messages.emails_from_raw(raw).collect()} == {f"<p>{TEXTS[3]}</p>"}
    plain = messages.emails_from_raw(raw, evidence=False).collect()
    assert len({r.html for r in plain}) == 4


def consumed(header, fields):
    """Plain model: fields in order, aliases in order, leftmost free cell."""
    free = [None if h is None else h.strip().lower() for h in header]
    found = []
    for field, names in fields.items():
        for name in names:
            if name in free:
                found.append((field, free.index(name)))
                free[free.index(name)] = None
                break
    return found, len(found) == len(header)


def test_consumption_equals_a_plain_model(spark):
    rng = random.Random(4)
    fields = {f: rng.sample("абвгдежз", rng.randint(1, 4)) for f in ("f1", "f2", "f3", "f4")}
    headers = [[rng.choice(["а", " Б", "в", "Г ", "д", "е\t", "ж", "з", "и", None, ""]) for _ in range(rng.randint(0, 6))] for _ in range(400)]
    df = spark.createDataFrame([(i, h, "mine") for i, h in enumerate([*headers, None])], "message_id INT, header ARRAY<STRING>, hits STRING")
    aliases = dims.field_alias_frame(spark, fields)
    aliases = aliases.union(aliases)
    got = {r.message_id: r for r in rates.consume_fields(df, aliases).collect()}
    for i, h in enumerate(headers):
        found, whole = consumed(h, fields)
        assert ([tuple(f) for f in got[i].found], got[i].is_rate_table) == (found, whole)
    assert (got[400].found, got[400].is_rate_table, got[400].hits) == (None, False, "mine")
    none = rates.consume_fields(df, aliases.limit(0), width=3)
    assert none.where("is_rate_table").count() == 0 and none.count() == 401


def test_a_large_alias_table_has_no_nested_loop(spark):
    aliases = spark.range(100_000).selectExpr("concat('поле ', id) AS alias", "concat('f', id % 5000) AS field", "cast(id div 5000 AS INT) AS prio", "cast(id % 5000 AS INT) AS field_no")
    df = spark.createDataFrame([(1, ["Поле 7", "поле 99999 "])], "message_id INT, header ARRAY<STRING>")
    out = rates.consume_fields(df, aliases, width=2)
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    row = out.first()
    assert ([tuple(f) for f in row.found], row.is_rate_table) == ([("f7", 0), ("f4999", 1)], True)


def test_observed_count_starts_no_job(spark, tmp_path):
    sc = spark.sparkContext
    df, seen = messages.observe_new(spark.range(1000).withColumnRenamed("id", "message_id"))
    sc.setJobGroup("plain", "")
    df.drop("x").write.parquet(str(tmp_path / "plain"))
    sc.setJobGroup("after", "")
    assert seen.get["n_new"] == 1000
    jobs = sc.statusTracker().getJobIdsForGroup
    assert len(jobs("plain")) == 1 and len(jobs("after")) == 0
    sc.setLocalProperty("spark.jobGroup.id", None)
