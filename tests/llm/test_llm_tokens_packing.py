"""Direct codes and packing against the tokenizers library."""

import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rateflow.llm import dac, packing, tokens

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    return [(r[0], r[1] or "") for r in rows]


def ids_of(name, text, end):
    enc = tokens.Encoder(name, None)
    return np.append(np.frombuffer(enc.direct(text), dtype="<u4"), np.uint32(end))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["the", "The.", " ", "\n", "\t", "it's", "don't!!", "é", "ß###", "1234", "  ", " \n", "a|b", "\x1c", "\xa0", "ÉTÉ,", "<|endoftext|>", "é", "中文", "\0"]), max_size=25))
def test_cached_pieces_encode_as_whole_texts(parts):
    text = "".join(parts)
    for name, cut in (("word_bpe_49k.json", tokens.WORDS), ("byte_bpe_50k.json", tokens.BLANKS)):
        enc = tokens.encoder(name, cut)
        assert enc.encode(text) == enc.direct(text)


@given(st.lists(st.integers(0, 2**32 - 1), max_size=300), st.sampled_from([8, 16]))
def test_codes_round_trip_and_random_access(ids, bits):
    codes = dac.Codes(dac.pack(np.array(ids, dtype=np.uint32), bits))
    assert len(codes) == len(ids)
    assert codes.get(np.arange(len(ids))).tolist() == ids
    at = np.random.default_rng(0).integers(0, max(1, len(ids)), 50 if ids else 0)
    assert codes.get(at).tolist() == [ids[i] for i in at]


def test_damaged_file_is_refused():
    data = dac.pack_file([1, None], [2, 1], np.array([1, 2, 3], dtype=np.uint32))
    assert dac.open_file(data)[0] == [1, None]
    with pytest.raises(ValueError):
        dac.open_file(data[:40] + bytes([data[40] ^ 1]) + data[41:])


def test_direct_codes_query(spark, texts):
    got = {r["doc_id"]: r for r in dac.op4_direct_codes(spark, SF).collect()}
    start = 0
    for key, text in texts:
        ids = ids_of("word_bpe_49k.json", text, 2)
        assert (got[key]["start"], got[key]["n_tokens"]) == (start, len(ids))
        assert got[key]["ids_crc32"] == zlib.crc32(ids.astype("<u4").tobytes())
        start += len(ids)
    assert len(got) == len(texts)


def test_packing_query(spark, texts):
    rows = packing.op9_cutting_stock(spark, SF).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for key, text in texts:
        ids = ids_of("byte_bpe_50k.json", text, 1).astype("<u4")
        at = 0
        for r in sorted(by_doc[key], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    padded = total = 0
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
        total += at
        padded += 0 if at & (at - 1) == 0 else 2048 - at
    assert padded <= 0.005 * total


def test_lookup_fetches_any_token(spark, tmp_path):
    texts = [(None, "no id"), (1, "a few words, and more of them"), (2, None), (3, "the same id"), (3, "twice, and longer"), (4, "last " * 700)]
    path = str(tmp_path / "codes")
    docs = spark.createDataFrame([(i, t, 7) for i, t in texts], "doc_id INT, text STRING, part INT")
    dac.write_codes(docs, path, "word_bpe_49k.json", tokens.WORDS, 2, file_tokens=20)
    asked = [(i, p) for i in (None, 1, 2, 3, 4, 5) for p in (-1, 0, 1, 4, 8, 699, 700, 701, None)]
    wanted = spark.createDataFrame(asked + asked[:20], "doc_id BIGINT, position BIGINT")
    ids = [(i, ids_of("word_bpe_49k.json", t or "", 2).tolist()) for i, t in texts]
    expected = []
    for i, p in asked:
        found = [d[p] for k, d in ids if k == i and p is not None and 0 <= p < len(d)]
        expected += [(i, p, x) for x in found or [None]]
    stored = dac.directory(spark, path).cache()
    assert stored.count() == len(texts)
    for places in (None, stored):
        got = [tuple(r) for r in dac.lookup(spark, path, wanted, places, chunk=64).collect()]
        assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert dac.lookup(spark, path, wanted.limit(0)).collect() == []


def test_repeated_rows_of_one_length_are_several_groups(spark):
    docs = spark.range(300).selectExpr("CAST(7 AS BIGINT) AS doc_id", "'a repeated row' AS text", "id AS salt", "'x' AS rest")
    rows = packing.pack(docs, "byte_bpe_50k.json", tokens.BLANKS, 1, group_rows=11).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
    assert sum(r["length"] for r in rows) == 300 * rows[0]["doc_tokens"]


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 63), st.integers(1, 40), max_size=12))
def test_plan_meets_demand_and_places_every_rank(demand):
    size = 64
    assert sum((Counter({n: k * used for n, k in p.items()}) for p, used in packing.rounded(demand, size)), Counter()) == Counter(demand)
    plan = packing.Plan(demand, size, 5, slack=0)
    seen = {}
    for n, count in demand.items():
        for rank in range(count):
            pieces = plan.place(n, rank)
            assert sum(p[1] for p in pieces) == n
            for _, length, seq, offset in pieces:
                seen.setdefault(seq, []).append((offset, length))
    for pieces in seen.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at & (at - 1) == 0  # full or a power of two
    if demand:
        area = sum(n * k for n, k in demand.items()) / size
        fractional = sum(x for _, x in packing.solve(demand, size))
        assert area - 1e-6 <= fractional


def test_column_generation_reaches_the_optimum():
    # 3 pieces of 40 and 6 of 30 in 100: one of each kind of pattern at best
    demand = {40: 30, 30: 60}
    assert abs(sum(x for _, x in packing.solve(demand, 100, 0.0)) - 30.0) < 1e-6


def test_hot_length_is_packed_once(spark):
    docs = spark.range(500).selectExpr("id AS doc_id", "'the same text' AS text")
    rows = packing.pack(docs, "byte_bpe_50k.json", tokens.BLANKS, 1, with_ids=True).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
    assert sum(r["length"] for r in rows) == sum({r["doc_id"]: r["doc_tokens"] for r in rows}.values())
    assert all(len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"] for r in rows)
