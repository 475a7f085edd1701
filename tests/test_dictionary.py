"""E6 with a dictionary table: blocking on rare substrings against a plain search."""

import random

from rateflow.functions import text as tx


def plain(text, keywords):
    if text is None:
        return None
    hits = [(p, k.lower(), s) for k, s, p in keywords if k and k.lower() in text.lower()]
    return min(hits)[2] if hits else ""


def test_large_dictionary_equals_a_plain_search(spark):
    rng = random.Random(2)
    word = lambda a, b: "".join(rng.choice("абвгд ") for _ in range(rng.randint(a, b)))
    keywords = [(word(1, 9), f"s{i}", rng.randint(0, 300)) for i in range(3000)]
    keywords += [("", "empty", 0), (None, "null", 0), ("ФРАХТ", "Фрахт", 1), ("x" * 50, "long", 2), ("яю", "two", -1), ("ж", "one", -2)]
    texts = [word(0, 40) for _ in range(300)] + [None, "", "Морской фрахт", "x" * 49, "x" * 51, "эяюэ", "эжэ"] + ["hot text ФРАХТ"] * 200
    df = spark.createDataFrame([(i, t, "keep") for i, t in enumerate(texts)], "id INT, raw STRING, gram STRING")
    dim = spark.createDataFrame(keywords, "keyword STRING, service STRING, prio INT")
    out = tx.with_services(df, "raw", dim)
    assert {r["id"]: r["name"] for r in out.collect()} == {i: plain(t, keywords) for i, t in enumerate(texts)}
    assert out.columns == ["id", "raw", "gram", "name"]
    assert tx.with_services(df, "raw", dim.limit(0)).where("name <> ''").count() == 0


def test_no_nested_loop(spark):
    dim = spark.range(100_000).selectExpr("concat('ключ ', id) AS keyword", "concat('s', id) AS service", "cast(id AS INT) AS prio")
    df = spark.range(2000).selectExpr("id", "concat('текст ключ ', id * 49, ' конец') AS raw")
    out = tx.with_services(df, "raw", dim)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = {r["id"]: r["name"] for r in out.collect()}
    # the keyword of lowest number that the text contains is the first digit run's shortest prefix
    assert got == {i: f"s{str(i * 49)[0]}" for i in range(2000)}


def test_stopword_table_equals_a_plain_search(spark):
    rng = random.Random(5)
    word = lambda a, b: "".join(rng.choice("абвгд ") for _ in range(rng.randint(a, b)))
    words = [word(2, 7) for _ in range(200)] + ["ОХРАНА", "", None, "охрана"]
    names = [word(0, 12) for _ in range(300)] + ["Охрана груза", None, ""] + ["фрахт"] * 50
    df = spark.createDataFrame(list(enumerate(names)), "id INT, name STRING")
    dim = spark.createDataFrame([(w,) for w in words], "word STRING")
    kept = {r["id"] for r in tx.without_stopwords(df, "name", dim).collect()}
    stops = [w.lower() for w in words if w]
    assert kept == {i for i, n in enumerate(names) if n is not None and not any(s in n.lower() for s in stops)}
    assert tx.without_stopwords(df, "name", dim.limit(0)).count() == len(names) - 1
