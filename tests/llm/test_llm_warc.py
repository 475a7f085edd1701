"""WARC archives: round trips, segment reassembly, damaged records and the query against its SQL."""

import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from rateflow.llm import warc

SF = "/root/testdata/sf0.001"
PAGES = "page_id BIGINT, url STRING, html STRING"


def round_trip(spark, tmp_path, rows, schema=PAGES, **options):
    path = str(tmp_path / "archive")
    df = spark.createDataFrame(rows, schema)
    warc.write(warc.captures(df), path, **options)
    return [r.asDict() for r in warc.read(spark, path).withColumn("page_id", warc.page_of("record_id")).withColumn("of", warc.page_of("refers_to")).collect()], path


def test_chunked_framing_is_undone():
    rng = random.Random(1)
    for n in [0, 1, 2, 9, 10, 11, 1000]:
        body = bytes(rng.randrange(256) for _ in range(n))
        for size in (1, 3, 10, 5000):
            assert warc.unchunked(warc.chunked(body, size)) == body
    assert warc.unchunked(b"3;name=x\r\nabc\r\n0\r\nTrailer: y\r\n\r\n") == b"abc"
    for bad in (b"", b"3\r\nab", b"zz\r\nabc\r\n0\r\n\r\n", b"3\r\nabcX0\r\n\r\n", b"3\r\nabc\r\n", b"+3\r\nabc\r\n0\r\n\r\n"):
        with pytest.raises(ValueError):
            warc.unchunked(bad)


def test_query_equals_its_sql(spark):
    got = [tuple(r) for r in warc.op12_warc_segments(spark, SF).collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    assert sorted(got, key=str) == sorted(con.execute(warc.ORACLE).fetchall(), key=str)


def test_payloads_of_any_content_come_back(spark, tmp_path):
    rng = random.Random(3)
    parts = ["\r\n\r\nWARC/1.1\r\n", "\r\n\r\n", "\r", "\n", "WARC/1.1\r\n", "Content-Length: 3", "й", "漢", "😀", "x" * 50, "\0"]
    html = ["", None, "a", "WARC/1.1\r\n", "\r\n\r\nWARC/1.1\r\n" * 40, "é" * 70_000]
    html += ["".join(rng.choices(parts, k=rng.randrange(1, 400))) for _ in range(150)]
    rows = [(i, f"http://a/{i}\r\nX: y z", h) for i, h in enumerate(html)]
    for segment, chunk in ((1 << 14, 4096), (37, 11)):
        got, _ = round_trip(spark, tmp_path / str(segment), rows if segment > 100 else rows[6:60], segment_bytes=segment, chunk_bytes=chunk)
        expected = {i: (h or "").encode() for i, _, h in (rows if segment > 100 else rows[6:60])}
        assert {r["page_id"]: r["payload"] for r in got if r["kind"] == "response"} == expected
        assert all(r["error"] is None and r["payload_digest"] == hashlib.sha256(expected[r["page_id"]]).hexdigest() for r in got)
        assert len(got) == len(expected) and max(r["segments"] for r in got) > 1
        assert all(r["uri"].endswith("%0D%0AX:%20y%20z") for r in got)


def test_files_are_plain_archives(spark, tmp_path):
    import gzip

    _, path = round_trip(spark, tmp_path, [(1, "http://a/1", "x" * 500), (2, None, "x" * 500), (3, "u", "y")], segment_bytes=200)
    data = b"".join(gzip.open(f).read() for f in sorted((tmp_path / "archive").glob("part-*.gz")))
    at, kinds = 0, []
    while at < len(data):  # read as the format says, by length only
        assert data[at:].startswith(b"WARC/1.1\r\n")
        end = data.index(b"\r\n\r\n", at) + 4
        fields = dict(line.split(b": ", 1) for line in data[at:end].split(b"\r\n")[1:-2])
        at = end + int(fields[b"Content-Length"])
        assert data[at : at + 4] == b"\r\n\r\n"
        at += 4
        kinds.append(fields[b"WARC-Type"].decode())
    assert sorted(kinds) == ["continuation"] * 2 + ["response"] * 2 + ["revisit"]
    assert path


def test_equal_payloads_nulls_and_repeated_rows(spark, tmp_path):
    long, other, short = "p" * 100, "q" * 20_000, "s" * 99
    rows = [(5, "a", long), (3, "b", long), (None, "c", long), (9, "d", long), (3, "b", long)]
    rows += [(1, "e", short), (2, "f", short), (None, None, None), (None, "g", other), (None, "g", other), (7, "h", other), (7, "h", other)]
    rows += [(None, "i", "r" * 200), (None, "i", "r" * 200)]
    got, _ = round_trip(spark, tmp_path, rows)
    key = lambda t: tuple((x is not None, x or 0) for x in t)
    seen = sorted(((r["page_id"], r["payload_bytes"], r["kind"], r["of"]) for r in got), key=key)
    expected = [(5, 100, "revisit", 3), (3, 100, "response", None), (None, 100, "revisit", 3), (9, 100, "revisit", 3), (3, 100, "response", None)]
    expected += [(1, 99, "response", None), (2, 99, "response", None), (None, 0, "response", None)]
    expected += [(None, 20_000, "revisit", 7)] * 2 + [(7, 20_000, "response", None)] * 2 + [(None, 200, "response", None)] * 2
    assert seen == sorted(expected, key=key)
    ids = {r["record_id"] for r in got if r["kind"] == "response"}
    assert all(r["refers_to"] in ids for r in got if r["kind"] == "revisit")


def test_join_beyond_the_broadcast_bound(spark, tmp_path, monkeypatch):
    rows = [(i, "u", "z" * (100 + i % 3)) for i in range(60)]
    few, _ = round_trip(spark, tmp_path / "a", rows)
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    many, _ = round_trip(spark, tmp_path / "b", rows)
    order = lambda rs: sorted((r["page_id"], r["kind"], r["of"] if r["of"] is not None else -1, r["payload_digest"]) for r in rs)
    assert order(few) == order(many) and sum(r["kind"] == "response" for r in few) == 3


def test_empty_table_and_extra_columns(spark, tmp_path):
    assert round_trip(spark, tmp_path / "none", [])[0] == []
    rows = [(1, "u", "text", "clash", 5)]
    got, _ = round_trip(spark, tmp_path / "more", rows, PAGES + ", payload STRING, digest INT")
    assert [r["payload"] for r in got] == [b"text"]


def test_damage_is_named(spark, tmp_path):
    body = "d" * 3000
    path = str(tmp_path / "whole")
    warc.write(warc.captures(spark.createDataFrame([(1, "u", body)], PAGES)), path, segment_bytes=1000)
    lines = spark.read.option("lineSep", warc.BETWEEN).text(path)
    held = [r[0].removeprefix("WARC/1.1\r\n").removesuffix(warc.BREAK) for r in lines.collect()]
    assert len(held) == 4

    def reread(values, name):
        at = str(tmp_path / name)
        spark.createDataFrame([("WARC/1.1\r\n" + v,) for v in values], "value STRING").write.option("lineSep", warc.BREAK).text(at)
        return warc.read(spark, at).collect()

    whole = reread(random.Random(0).sample(held, 4), "shuffled")
    assert [(r["error"], r["payload"]) for r in whole] == [(None, body.encode())]
    assert [(r["error"], r["payload"]) for r in reread(held + held[1:2] * 0, "same")] == [(None, body.encode())]
    middle = next(v for v in held if "Segment-Number: 2" in v)
    last = next(v for v in held if "Total-Length" in v)
    without = lambda v: [x for x in held if x != v]
    assert [r["error"] for r in reread(without(middle), "gap")] == ["segment missing"]
    assert [r["error"] for r in reread(without(last), "tail")] == ["no total length"]
    wrong = last.replace("Total-Length: ", "Total-Length: 9")
    assert [r["error"] for r in reread(without(last) + [wrong], "total")] == ["wrong total length"]
    cut = reread(without(middle) + [middle[:-5]], "cut")
    assert [r["error"] for r in cut] == ["block cut short"]
    changed = reread(without(middle) + [middle.replace("ddd", "dxd", 1)], "changed")
    assert [r["error"] for r in changed] == ["wrong digest"]
    one = 'WARC-Type: response\r\nWARC-Record-ID: <x>\r\nContent-Length: {}\r\n\r\n{}'
    bad = "HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\nxyz"
    assert [r["error"] for r in reread([one.format(len(bad), bad)], "framing")] == ["chunk size missing"]
    plain = "HTTP/1.1 200 OK\r\n\r\nbody"
    assert [bytes(r["payload"]) for r in reread([one.format(len(plain), plain), "WARC-Type: warcinfo\r\nContent-Length: 0\r\n\r\n"], "plain")] == [b"body"]


def test_query_fails_on_a_damaged_archive(spark, monkeypatch):
    real = warc.read
    monkeypatch.setattr(warc, "read", lambda *a, **k: real(*a, **k).withColumn("error", F.lit("wrong digest")))
    with pytest.raises(Exception, match="wrong digest"):
        warc.op12_warc_segments(spark, SF).collect()
