import random
from itertools import permutations

import numpy as np
import pytest

from gleanery.llm import interactions
from gleanery.llm.interactions import audit, difference, gallop

SCHEMA = "doc_id long, text string, lang string, part string, bits string, `my col` string"
LABELS = "doc_id long, quality int, toxic int, extra string"


def fails(text):
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", text) if w]
    return {
        "A": len(words) < 100,
        "B": 100 * len(set(words)) < 80 * len(words),
        "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
        "D": any(c in "#$%&*|" for c in text),
    }


def expected(rows, labels):
    ids = {}
    for i, text, _ in rows:
        if i is not None:
            ids.setdefault(text or "", set()).add(i)
    judged = []
    for i, text, lang in rows:
        smaller = ids.get(text or "", set()) if i is None else {x for x in ids[text or ""] if x < i}
        bad = {k for k, v in fails(text or "").items() if v} | ({"E"} if smaller else set())
        good = any(q == 1 for d, q, _ in labels if d is not None and d == i)
        toxic = any(t == 1 for d, _, t in labels if d is not None and d == i)
        judged.append((lang or "", bad, good, toxic))
    out = []
    for part in {p for p, *_ in judged}:
        own = [x[1:] for x in judged if x[0] == part]
        removed_in_all = dict.fromkeys("ABCDE", 0)
        found = []
        for order in permutations("ABCDE"):
            left = own
            for step, name in enumerate(order):
                gone = [x for x in left if name in x[0]]
                left = [x for x in left if name not in x[0]]
                removed_in_all[name] += len(gone)
                found.append(
                    [
                        part, "".join(order), step + 1, len(left), len(gone),
                        sum(name in x[0] for x in own) - len(gone), sum(x[0] == {name} for x in own),
                        sum(x[1] for x in gone), sum(x[2] for x in gone), name,
                    ]
                )
        out += [tuple([*row[:-1], removed_in_all[row[-1]]]) for row in found]
    return sorted(out)


def sample():
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgé", k=rng.randrange(3, 9)))
    rows = []
    for i in range(120):
        text = " ".join(word() for _ in range(rng.choice([50, 99, 100, 130])))
        text = text.upper() if rng.random() < 0.2 else text
        text = text + " " + text if rng.random() < 0.2 else text
        text += " #" if rng.random() < 0.3 else ""
        rows.append((i * 3, text, rng.choice(["en", "de", None])))
    rows += [(1000 + i, rows[0][1], "en") for i in range(60)]  # copies
    rows += [(2, rows[3][1], "fr")]  # the smaller id in another part
    rows += [(5000, None, "en"), (5001, "", "en"), (5002, " \n", "xx"), (None, rows[0][1], "en"), (None, "alone", "en")]
    rows += [(5003, "long " * 60_000, "en")]
    rows += rows[-8:]  # repeated rows
    labels = [(i, rng.randrange(2), rng.randrange(2)) for i in range(0, 360, 2)] + [(3, 1, 1), (3, 0, 0), (None, 1, 1), (9, None, None)]
    return rows, labels


def frames(spark, rows, labels):
    docs = spark.createDataFrame([(*r, "clash", "clash", "x") for r in rows], SCHEMA).repartition(5)
    return docs, spark.createDataFrame([(*r, "x") for r in labels], LABELS)


@pytest.mark.parametrize("width", [1 << 17, 16])
def test_equals_all_orders_one_by_one(spark, many_chunks, monkeypatch, width):
    monkeypatch.setattr(interactions, "_RANGE", width)
    rows, labels = sample()
    got = audit(*frames(spark, rows, labels))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(tuple(r) for r in got.collect()) == expected(rows, labels)


def test_no_documents_no_labels(spark):
    rows, labels = sample()
    assert audit(*frames(spark, [], labels)).collect() == []
    assert sorted(tuple(r) for r in audit(*frames(spark, rows[:20], [])).collect()) == expected(rows[:20], [])


def test_other_filters(spark):
    docs = spark.createDataFrame([(1, "aa", "x"), (2, "b", "x"), (3, "aa", "x")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], LABELS)
    got = audit(docs, labels, {"S": lambda text: len(text.body) < 2}).orderBy("filter_order", "step").collect()
    assert [tuple(r)[1:6] for r in got] == [("ES", 1, 2, 1, 0), ("ES", 2, 1, 1, 0), ("SE", 1, 2, 1, 0), ("SE", 2, 1, 1, 0)]
    with pytest.raises(ValueError):
        audit(docs, labels, {"E": lambda text: True})


def test_galloping(monkeypatch):
    monkeypatch.setattr(interactions, "_STRIDE", 7)
    rng = np.random.default_rng(1)
    for _ in range(200):
        lead, *others = (np.unique(rng.integers(0, 200, rng.integers(0, 80))) for _ in range(4))
        want = sorted(set(lead.tolist()) - set().union(*(x.tolist() for x in others)))
        assert difference(lead, others).tolist() == want
        if len(lead):
            beyond = int(rng.integers(-1, 201))
            assert gallop(lead, 0, beyond) == int(np.searchsorted(lead, beyond, "right"))
