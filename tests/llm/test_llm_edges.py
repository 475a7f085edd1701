"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rateflow.llm import brown, common, dac, html_boost, langcnn, packing, pii, pu_quality, rows, simhash, spotsigs, templates, tokens

SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, score DOUBLE, row STRING, fp BIGINT, items STRING, held_out STRING"
LONG = " ".join(f"w{i % 977} the of and" for i in range(60_000))
ROWS = [
    (1, "The first text of the table is here, and it has 12 words.", "en", "s", 5, 0.1, "r", 1, "i", "h"),
    (1, "The first text of the table is here, and it has 12 words.", "en", "s", 5, 0.1, "r", 1, "i", "h"),
    (1, "Another text with the same id", None, None, None, None, None, None, None, None),
    (2, None, "de", None, None, None, None, None, None, None),
    (3, "", "en", "s", 0, None, None, None, None, None),
    (4, " \n\t ", None, "s", 4, None, None, None, None, None),
    (None, "A text that has no id", "en", "s", 1, None, None, None, None, None),
    (5, LONG, "fr", "s", len(LONG), None, None, None, None, None),
    (-7, "Ünïcödé 中文 \U0001f600 text!", "de", "s", 9, None, None, None, None, None),
]
TEXT = "test of all the edges"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, some=True):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 0), (5, 1, 0), (5, 0, 1), (None, 1, None), (2, None, None)] if some else [], "doc_id BIGINT, quality INT, toxic INT")


def bench(spark, some=True):
    return spark.createDataFrame([(1, "The first text of the table is here, and it has 99 words."), (2, None), (None, "x"), (3, "")] if some else [], "item_id BIGINT, text STRING")


def test_fingerprints(odd, none):
    assert spotsigs.compared(none).collect() == []
    got = spotsigs.compared(odd).collect()
    assert len(got) == len(ROWS)
    one = [r for r in got if r["doc_id"] == 1 and r["n_chars"] == len(ROWS[0][1])]
    assert one[0]["fingerprint"] == one[1]["fingerprint"]
    assert {r["n_chars"] for r in got if r["doc_id"] in (2, 3)} == {0}
    # ascending: null, -7, 1, 1, 1, ... and the last is followed by the first
    last = next(r for r in got if r["doc_id"] == 5)
    import hashlib

    assert last["edited_sha256"] == hashlib.sha256((LONG[: len(LONG) - len(LONG) // 2] + "A text that has no id").encode()).hexdigest()


def test_single_document_is_its_own_next(spark):
    df = spark.createDataFrame([(9, "The only text of the table")], "doc_id BIGINT, text STRING")
    assert [r["near_next"] for r in spotsigs.compared(df).collect()] == [1.0]


def test_quality(spark, odd, none):
    for some in (True, False):
        net = pu_quality.learn(odd, labels(spark, some))
        got = pu_quality.scored(odd, net).collect()
        assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    assert pu_quality.scored(none, None).collect() == []
    assert pu_quality.learn(none, labels(spark)) is None
    assert pu_quality.keep_good(odd, labels(spark)).columns == odd.columns


def test_pseudonyms(odd, none):
    assert pii.mask(none, "k").collect() == []
    got = pii.mask(odd, "k")
    assert got.columns == odd.columns and got.count() == len(ROWS)
    assert {r["text"] for r in got.collect()} == {r[1] for r in ROWS}


def test_codes(odd, none, spark, tmp_path):
    for name, df in (("odd", odd), ("none", none)):
        path = str(tmp_path / name)
        dac.write_codes(df, path, "word_bpe_49k.json", tokens.WORDS, 2, file_tokens=1000)
        got = sorted((r["start"], r["doc_id"], r["n_tokens"]) for r in dac.read_codes(spark, path).collect())
        assert len(got) == (len(ROWS) if name == "odd" else 0)
        at = 0
        for start, _, n in got:
            assert start == at
            at += n
        ids = [d for _, d, _ in got]
        assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))


def test_leaks(spark, odd, none):
    got = templates.found_items(odd, bench(spark)).collect()
    assert len(got) == len(ROWS) and sum(list(r["items"]) == [1] for r in got) == 2
    assert templates.clean(odd, bench(spark, False)).count() == len(ROWS)
    assert templates.clean(none, bench(spark)).collect() == []


def test_language(spark, odd, none):
    net = langcnn.learn(odd, F.lit(True))
    got = langcnn.predicted(odd, net).collect()
    und = {r["row"]["doc_id"] for r in got if r["lang_pred"] == "und"}
    assert len(got) == len(ROWS) and und == {2, 3, 4}
    assert langcnn.learn(none, F.lit(True)) is None
    assert {r["lang_pred"] for r in langcnn.predicted(odd, None).collect()} == {"und"}
    assert langcnn.predicted(none, net).collect() == []


def test_near_duplicates(odd, none):
    got = simhash.near_duplicates(odd, 4, 4).collect()
    assert len(got) == len(ROWS)
    assert {r["component_id"] for r in got if r["doc_id"] in (2, 3, 4)} == {2}  # no words: fingerprint zero
    assert simhash.near_duplicates(none, 4, 4).collect() == []
    kept = simhash.keep_one(odd, 4, 4)
    assert kept.columns == odd.columns and kept.count() == 6
    assert simhash.keep_one(none, 4, 4).collect() == []


def test_pages(spark):
    page = "<body><nav><a href=x>m</a></nav><article><h1>T</h1><p>Some text of the page.</p></article></body>"
    df = spark.createDataFrame([(1, "u", page, "x"), (1, "u", page, "x"), (None, None, page, None), (2, "u", None, None), (3, "u", "", None)], "page_id BIGINT, url STRING, html STRING, content STRING")
    got = html_boost.main_text(df).collect()
    assert len(got) == 5
    assert [r["content"] for r in got if r["row"]["html"] is None or r["row"]["html"] == ""] == ["", ""]
    assert html_boost.main_text(df.limit(0)).collect() == []


def test_packing(odd, none):
    got = packing.pack(odd, "byte_bpe_50k.json", tokens.BLANKS, 1, size=64).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == len(got)
    assert [r["doc_tokens"] for r in got if r["doc_id"] in (2, 3)] == [1, 1]
    assert packing.pack(none, "byte_bpe_50k.json", tokens.BLANKS, 1).collect() == []


def test_class_scores(odd, none):
    got = brown.class_scores(odd, common.is_held_out("doc_id", 5, 1)).collect()
    assert len(got) == len(ROWS) and {r["n_tokens"] for r in got if r["doc_id"] in (2, 3, 4)} == {1}
    assert brown.class_scores(none, F.lit(False)).collect() == []
    everything_held = brown.class_scores(odd, F.lit(True)).collect()
    assert {r["train_tokens"] for r in everything_held} == {0}


def test_pipeline_on_odd_rows(spark, odd, none, tmp_path):
    for name, df, some in (("odd", odd, True), ("none", none, False)):
        sf = str(tmp_path / name)
        df.write.parquet(f"{sf}/documents.parquet")
        labels(spark, some).write.parquet(f"{sf}/labels.parquet")
        bench(spark, some).write.parquet(f"{sf}/benchmark.parquet")
        docs = spark.read.parquet(f"{sf}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf)
            assert docs.columns == df.columns
        assert corpus_pipeline.run(spark, sf).columns[0] == "doc_id"


def test_pipeline_effects(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    kept = {r["doc_id"] for r in corpus_pipeline.run(spark, sf).select("doc_id").distinct().collect()}
    assert kept <= set(docs)
    leaks = {r["doc_id"] for r in templates.op5_template_leaks(spark, sf).collect()}
    assert not kept & leaks
    good = {r["doc_id"] for r in pu_quality.op2_pu_quality(spark, sf).collect() if r["predicted"]}
    near = {r["doc_id"]: r["component_id"] for r in simhash.op7_simhash_bk(spark, sf).collect()}
    lonely = {d for d in good - leaks if list(near.values()).count(near[d]) == 1}
    assert lonely <= kept <= good


def test_sample_is_bounded_and_repeatable(spark):
    df = spark.range(5000).withColumnRenamed("id", "doc_id")
    a, b = (sorted(r[0] for r in rows.sample(x, 100).collect()) for x in (df, df.repartition(7)))
    assert a == b and len(a) == 100
