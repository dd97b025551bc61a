import html

import pytest
from pyspark.sql import functions as F

from gleanery.functions.text import first_fence, remove_urls, strip_space, token_count, token_cut, unescape_entities


def apply(spark, function, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.out for r in df.select("i", function(F.col("v")).alias("out")).orderBy("i").collect()]


def test_remove_urls_golden(spark):
    cases = {
        "see [a](http://x.com/p?q=1#frag) end": "see [a](#frag) end",
        "http://x.com/~me ok": "~me ok",
        "(https://a.b/c), next": "( next",
        "http://é.com": "http://é.com",
    }
    assert apply(spark, remove_urls, *cases) == list(cases.values())


def test_remove_urls_by_the_pattern_as_given(spark):
    import random
    import re

    given = re.compile(r"http[s]?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\\(\\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+")
    rng = random.Random(1)
    cases = ["http://" + "".join(rng.choices("aZ0$%^_`~@.&+!*\\(),;:/?é# \n-[]{}|", k=rng.randrange(30))) for _ in range(500)]
    cases += ["x http://" + "a" * n + " y" for n in (10, 2_000, 1_000_000)]
    assert apply(spark, remove_urls, *cases) == [given.sub("", c) for c in cases]


def test_numeric_entities_of_any_length(spark):
    cases = ["&#00000065;", "&#x000000041;", "&#99999999999999999999;", "&#xFFFFFFFFFFFF;", "&#0000000000;", "&#0000128;", "&#x80;"]
    assert apply(spark, unescape_entities, *cases) == [html.unescape(c) for c in cases]


def test_first_fence_golden(spark):
    cases = [
        ("a ```json\n{\"k\":1}\n``` b ```json\n2\n```", '{"k":1}'),
        ("```json\n\n\n```", None),
        ("```json\n \t \n```", None),
        ("no fence", None),
        ("```json\n [1] \n\n```", "[1]"),
        (None, None),
    ]
    assert apply(spark, first_fence, *[c[0] for c in cases]) == [c[1] for c in cases]


TEXTS = ["", "  ", "a", " a  b\tc\n", "a b c", "x\x1cy\x1fz\x85w", "é ü　ß", "one\x0btwo"]


def test_tokens_are_the_words_of_unicode_text(spark):
    assert apply(spark, token_count, *TEXTS) == [len(t.split()) for t in TEXTS]
    assert apply(spark, strip_space, *TEXTS) == [t.strip() for t in TEXTS]


@pytest.mark.parametrize("limit", [1, 2, 3, 1000])
def test_token_cut_keeps_the_first_words_and_their_spacing(spark, limit):
    for text, cut in zip(TEXTS, apply(spark, lambda c: token_cut(c, limit), *TEXTS)):
        assert text.startswith(cut)
        assert cut.split() == text.split()[:limit]
        if len(text.split()) <= limit:
            assert cut == text


def test_token_cut_of_a_long_text(spark):
    text = "word " * 300_000
    assert apply(spark, lambda c: token_cut(c), text) == [("word " * 120_000).rstrip()]


def test_entities_follow_html(spark):
    texts = ["a &amp; b", "&copy;&#233;&#xE9;&#150;&#0;", "&amp;lt;", "plain", "&hellip;&NotEqualTilde;&frac12;", "", "&#x1F600;"]
    assert apply(spark, unescape_entities, *texts) == [html.unescape(t) for t in texts]
    assert apply(spark, unescape_entities, "&nosuch; & &x", None) == ["&nosuch; & &x", None]
