"""Whole secrets, exact ids of odd words, letters by category, and templates that many items share."""

import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from rateflow.llm import dom, html_boost, langcnn, pii, templates, tokens

SECRETS = [
    ("secret = {}", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"),
    ("token: {}", "abc.def123.ghi456xyz"),
    ("password={}", "Tr0ub4dor&3xyz9"),
    ("password={}", "p@ssw0rd!long"),
    ('{{"password": "{}"}}', "hunter2hunter2"),
    ("{{'api_key' : '{}'}}", "ABCDEFGHIJ"),
    ("Authorization: Bearer {}", "abcDEF123.x-y_z"),
    ("authorization: basic {} next", "dXNlcjpwYXNz"),
    ("pwd: {}", "abc12"),
    ("password:    {}", "correcthorse"),
    ("my passphrase={} here", "x" * 300),
    ("from {} on", "2001:0db8:85a3:0000:0000:8a2e:0370:7334"),
    ("from {} on", "fe80:1:2::5"),
]


def test_no_part_of_a_secret_stays(spark):
    rows = [(i, shape.format(value)) for i, (shape, value) in enumerate(SECRETS)]
    got = dict(tuple(r) for r in pii.mask(spark.createDataFrame(rows, "doc_id INT, text STRING"), "k").collect())
    for i, (shape, value) in enumerate(SECRETS):
        before, after = shape.format("\x00").split("\x00")
        assert got[i].startswith(before) and got[i].endswith(after) and len(got[i]) == len(before + value + after)
        new = got[i][len(before) : len(got[i]) - len(after)]
        alike = sum(a == b for a, b in zip(new, value, strict=True) if a.isalnum())
        assert alike <= 0.4 * len(value) and [c.isalnum() for c in new] == [c.isalnum() for c in value]
        assert all(part not in new for part in re.findall("[A-Za-z0-9]{6,}", value))


def test_plain_prose_and_other_keys(spark):
    plain = ["secret: it was", "The token: a b c", "at 12:30:45", "std::vector a::b", "password reset", "ratio 3:2::1", "token:", "pwd = "]
    rows = [(i, t) for i, t in enumerate(plain)]
    assert [r[1] for r in pii.mask(spark.createDataFrame(rows, "doc_id INT, text STRING"), "k").orderBy("doc_id").collect()] == plain
    one = spark.createDataFrame([(1, "password=hunter2hunter2")], "doc_id INT, text STRING")
    assert len({pii.mask(one, k).first()["text"] for k in ("a", "b", "c")}) == 3
    with pytest.raises(TypeError):
        pii.mask(one)


def test_ids_of_wide_unicode_equal_the_tokenizer():
    enc = tokens.Encoder("word_bpe_49k.json", tokens.WORDS)
    fixed = ["ΟΔΟΣ", "ΟΔΟΣ ΣΑΣ Σ", "İI ıß ǅ", "Σ.", "ΑΣ'Σ ΑΣ-Β"]
    rng = np.random.default_rng(4)
    letters = [chr(c) for c in [*range(0x41, 0x5B), *range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000), 0x3A3, 0x3A3, 0x20, 0x20, 0x2E, 0x27]]
    fixed += ["".join(rng.choice(letters, int(rng.integers(1, 12)))) for _ in range(4000)]
    for t in fixed:
        assert enc.encode(t) == enc.direct(t), t


def test_letters_are_letters(spark):
    languages = ["a", "b"]
    net = langcnn.train(np.stack([langcnn.windows(b"xyz" * 30)[0], langcnn.windows(b"qrs" * 30)[0]] * 4), np.array([0, 1] * 4), languages)
    texts = ["½ ² 12", "Ⅷ", "", None, "7 _ -", "ª", "ж", "1a", "漢"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id INT, text STRING")
    got = {r["row"]["doc_id"]: r["lang_pred"] for r in langcnn.predicted(df, net).collect()}
    assert [got[i] == "und" for i in range(len(texts))] == [True, True, True, True, True, False, False, False, False]


def test_a_rare_language_is_learned(spark):
    rows = [(i, "der die das und ist " * 5, "de") for i in range(900)] + [(1000 + i, "το και είναι στο " * 5, "el") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id INT, text STRING, lang STRING")
    net = langcnn.learn(df, F.lit(True), limit=100, least=10)
    assert net.languages == ["de", "el"]
    assert {r["row"]["lang"] + r["lang_pred"] for r in langcnn.predicted(df, net).collect()} == {"dede", "elel"}


TEMPLATE = "A farmer in {} sells {} baskets of apples to {} and then {} more to {} before noon, how many baskets does the farmer sell in total that day?"


def _index(n):
    rng = np.random.default_rng(1)
    names = ["Paris", "Rome", "Oslo", "Kyiv", "Lima", "Bern", "Cairo", "Delhi"]
    items = [(i, TEMPLATE.format(names[i % 8], 100 + i, names[(i + 3) % 8], int(rng.integers(5000, 9000)), names[(i + 5) % 8])) for i in range(n)]
    return items, templates.Index(items, 5)


def test_like_items_are_worked_out_once():
    words = templates.Words()
    copy = TEMPLATE.format("Accra", 7, "Quito", 12, "Tunis")
    bad = TEMPLATE.format("Accra", 7, "Accra", 7, "Accra")
    took = {}
    for n in (20, 2000):
        items, index = _index(n)
        assert len(index.members) < 20
        for text, held in [(copy, True), (" Then. ".join([copy] * 20), True), ("So it is. " + bad, False), (items[3][1], True)]:
            doc = templates.Sequence(words.codes(text))
            began = time.perf_counter()
            found = index.matches(doc, 0.8, 60, 0.8)
            took[n] = time.perf_counter() - began
            alone = {i for i, t in items[:20] if templates.Index([(i, t)], 5).matches(doc, 0.8, 60, 0.8)}
            assert {m[0] for m in found if m[0] < 20} == alone
            if held:
                assert 3 in alone
    assert took[2000] < 100 * took[20] + 1


def test_classes_report_every_member_and_copy(spark):
    items, _ = _index(40)
    bench = spark.createDataFrame(items + items[:3], "item_id BIGINT, text STRING")
    docs = spark.createDataFrame([(1, items[5][1]), (2, TEMPLATE.format("Accra", 7, "Quito", 12, "Tunis")), (3, "Nothing of it.")], "doc_id INT, text STRING")
    found = {r["row"]["doc_id"]: sorted(r["items"]) for r in templates.found_items(docs, bench, run=60).collect()}
    assert found == {1: sorted([*range(40), 0, 1, 2]), 2: sorted([*range(40), 0, 1, 2]), 3: []}




def test_quotes_in_tags_are_read_as_html5_does():
    def blocks(html):
        return [n.text for n in dom.parse(html)[1] if n.text]

    assert blocks("<p title=it's>one</p><p>two's</p>") == ["one", "two's"]
    assert blocks('<p data-x="5" tall">one</p><p>"two"</p>') == ["one", '"two"']
    assert blocks("<p a='x > y' b=\"<b>\">one</p>") == ["one"]
    assert blocks('<p a = "1"b=\'2\'/>one<p =x a=>two') == ["one", "two"]
    assert blocks('<div a=">" ><script x=">">no</script>one</div>') == ["one"]
    assert blocks('<p class="open>one</p><p>two') == []  # the value goes on to the end, as in a browser
    began = time.perf_counter()
    blocks("<p " + "a=b'" * 50_000 + ">one</p>" + "<p a=\"" * 20_000)
    assert time.perf_counter() - began < 20


def test_the_main_text_needs_no_telling_tag_or_name(spark):
    pages = [r[0] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id").select("html").collect()]
    forest = html_boost.learn(pages)
    articles = [re.findall("<article.*</article>", h, re.S)[0] for h in pages]
    want = [[n.text for n in dom.parse(a)[1] if n.text] for a in articles]
    assert html_boost.extract(pages, forest) == want
    forms = [
        lambda h: re.sub(r"<(/?)article\b", r"<\1div", h),
        lambda h: re.sub(r"<(/?)article\b", r"<\1section", h),
        lambda h: re.sub(r"<article\b", "<article class=css-0x1", h),
        lambda h: h.replace("<p>", "<p title=it's>"),
        lambda h: h.replace("<p>", '<p data-x="5" tall">'),
    ]
    for form in forms:
        got = html_boost.extract([form(h) for h in pages], forest)
        assert sum(a == b for a, b in zip(got, want, strict=True)) >= 0.99 * len(want)
