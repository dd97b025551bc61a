import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from gleanery.llm import divergence
from gleanery.llm.divergence import audit, probabilities, sort_pointers, word_starts

SCHEMA = "doc_id long, text string, lang string, source string, term string, `my col` string"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def terms_of(text):
    return [re.sub("[A-Z]", lambda m: m.group().lower(), t) for t in TERM.findall(text or "")]


def expected(rows, least=10, top=10):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        docs[lang].update(set(terms_of(text)))
        counts[lang, source].update(terms_of(text))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        n_of = {s: sum(counts[lang, s][t] for t in kept) for s in sources}

        def p(c, n):
            return 1 + 10**9 * (c + 2) // (n + 2 * len(kept))

        whole = {t: sum(counts[lang, s][t] for s in sources) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(r, sum(f(p(counts[lang, s][t], n_of[s]), p(counts[lang, r][t], n_of[r])) for t in kept)) for r in sources if r != s]
            named = []
            for t in kept:
                a, b = p(counts[lang, s][t], n_of[s]), p(whole[t], sum(n_of.values()))
                if counts[lang, s][t] and a > b:
                    named.append((t, f(a, b)))
            for part, found, most in (("pair", pairs, None), ("term", named, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(found[:most])]
    return sorted(out)


def sample():
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdeé語ZQ", k=rng.randrange(1, 22))) for _ in range(60)]
    words += ["sharedprefix" + x for x in "abc"] + ["sharedprefix", "eightabc", "eightabcd", "Eightabc"]
    rows = []
    for i in range(300):
        own = rng.sample(words, 30)
        text = rng.choice([" ", "1", "_", "\n", "@"]).join(rng.choices(own, k=rng.randrange(0, 60)))
        rows.append((i, text, rng.choice(["en", "en", "en", "de", None]), rng.choice(["s1", "s2", "s3", "é", None, ""])))
    rows += [(1000 + i, words[0] + " " + words[1], "en", "hot") for i in range(150)]  # one source and text
    rows += [(2000, "onlyhere", "fr", "a"), (2001, "", "fr", "b"), (2002, None, "fr", "c"), (2003, None, "xx", None)]
    rows += [(None, "long word " * 30_000, "en", "s1"), (2004, "z" * 200_000, "en", "s2")]
    return rows + rows[-4:]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "x") for r in rows], SCHEMA).repartition(4)


@pytest.mark.parametrize("limits", [{}, {"_SLICE": 2000, "_CELLS": 40}])
@pytest.mark.parametrize("bucket_rows", [100_000, 20])
def test_equals_brute_force(spark, many_chunks, monkeypatch, limits, bucket_rows):
    for name, value in limits.items():
        monkeypatch.setattr(divergence, name, value)
    rows = sample()
    got = audit(frame(spark, rows), bucket_rows=bucket_rows)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == expected(rows)


def test_no_rows_and_no_terms(spark):
    assert audit(frame(spark, [])).collect() == []
    rows = [(1, "a b", "en", "x"), (2, None, "en", "y")]
    assert sorted(tuple(r) for r in audit(frame(spark, rows)).collect()) == expected(rows)


def test_pointers_sorted_as_bytes():
    rng = random.Random(3)
    words = [bytes(rng.choices(b"ab\xc3\xa9", k=rng.randrange(1, 30))) for _ in range(3000)]
    words += [b"a" * n for n in range(1, 40)] * 2
    data = np.frombuffer(b" ".join(words) + b" " * 9, np.uint8)
    starts, lengths = word_starts(data)
    order, heads = sort_pointers(data, starts, lengths)
    assert [words[i] for i in order] == sorted(words) and order.tolist() == sorted(range(len(words)), key=lambda i: (words[i], i))
    assert [words[i] for i in order[heads]] == sorted(set(words))


def test_probabilities_are_exact():
    rng = random.Random(4)
    for _ in range(500):
        total = rng.randrange(1, 10**17)
        count = rng.randrange(0, total + 1)
        got = probabilities(np.array([count]), np.array([total]))[0]
        assert got == 1 + 10**9 * count // total
