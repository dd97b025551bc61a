import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gleanery.llm import benchmark
from gleanery.llm.benchmark import GAP, MATCH, MISMATCH, align, contaminated, without_leaks

DOCS = "doc_id long, text string, item_id string, score string, _leaked string"
ITEMS = "item_id long, text string, doc_id string"


def plain_alignment(item, passage):
    best, row = 0, [0] * (len(passage) + 1)
    for a in item:
        new = [0]
        for j, b in enumerate(passage):
            new.append(max(0, row[j] + (MATCH if a == b else MISMATCH), row[j + 1] + GAP, new[j] + GAP))
        row = new
        best = max(best, *row)
    return best


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=12), st.lists(st.integers(1, 4), min_size=1, max_size=30))
def test_alignment_equals_the_full_table(item, passage):
    score, start, end = align(np.array(item, np.uint64), np.array(passage, np.uint64))
    assert score == plain_alignment(item, passage)
    if score:
        assert 0 <= start < end <= len(passage)
        assert plain_alignment(item, passage[start:end]) == score


def sample(seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgé", k=rng.randrange(2, 8))) for _ in range(2000)] + ["the", "of", "and"] * 300
    passage = lambda n: rng.choices(words, k=n)
    items = [(i, passage(rng.randrange(15, 60))) for i in range(12)]
    docs, want = [], set()

    def add(doc_id, inner, item=None):
        docs.append((doc_id, " ".join(passage(rng.randrange(0, 80)) + inner + passage(rng.randrange(0, 80)))))
        if item is not None:
            want.add((doc_id, item))

    for i, item in items:
        add(i, item, i)
        add(100 + i, [w.upper() + rng.choice("!.,") for w in item], i)
        edited = [w if rng.random() > 0.12 else rng.choice(words) for w in item]
        add(200 + i, edited, i)
        shorter = list(item)
        for _ in range(len(item) // 10):
            del shorter[rng.randrange(len(shorter))]
        add(300 + i, shorter, i)
        add(400 + i, item[:3])
    for i in range(60):
        add(500 + i, passage(100))
    for i in range(60):  # one leak in a great part of all documents
        add(600 + i, items[0][1], 0)
    docs += [(700, None), (701, ""), (702, "the " * 30_000), (703, "!!! ... ???")]
    return docs, [(i, " ".join(w)) for i, w in items], want


@pytest.mark.parametrize("block_bytes", [8 << 20, 500])
def test_copies_and_edited_copies_are_found(spark, block_bytes):
    docs, items, want = sample()
    items += [(50, None), (51, ""), (52, "?!"), (None, "no id " * 9), items[0]]
    frame = spark.createDataFrame([(*d, "clash", "clash", "clash") for d in docs], DOCS).repartition(4)
    result = contaminated(frame, spark.createDataFrame([(*x, "clash") for x in items], ITEMS), block_bytes=block_bytes)
    rows = result.collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == want
    texts = dict(docs)
    for r in rows:
        passage = texts[r["doc_id"]].split()[r["start"] : r["start"] + r["words"]]
        item = next(t for i, t in items if i == r["item_id"]).split()
        plain = [[benchmark._EDGES.sub("", w.lower()) for w in x] for x in (item, passage)]
        assert r["score"] == pytest.approx(plain_alignment(*plain) / (2 * len(item)))
        assert r["score"] >= 0.5


def test_items_of_few_words(spark):
    docs = [(1, "x y alpha beta z", "", "", ""), (2, "alpha only", "", "", ""), (None, "alpha beta", "", "", "")]
    items = spark.createDataFrame([(1, "alpha beta", "")], ITEMS)
    got = contaminated(spark.createDataFrame(docs, DOCS), items).collect()
    assert {r["doc_id"] for r in got} == {1, None}


def test_no_rows_and_leaks_taken_out(spark):
    docs, items, want = sample(2)
    docs += [(None, items[0][1]), (None, "clean")]
    frame = spark.createDataFrame([(*d, "a", "b", "c") for d in docs], DOCS)
    items = spark.createDataFrame([(*x, "clash") for x in items], ITEMS)
    kept = without_leaks(frame, items)
    assert kept.columns == frame.columns
    leaked = {d for d, _ in want}
    left = [d for d, _ in docs[:-2] if d not in leaked] + [None]  # the clean row without an id stays
    got = kept.collect()
    assert sorted((r["doc_id"] for r in got), key=repr) == sorted(left, key=repr)
    assert [r["text"] for r in got if r["doc_id"] is None] == ["clean"]
    assert contaminated(frame.limit(0), items).collect() == []
    assert contaminated(frame, items.limit(0)).collect() == []


def test_query_over_all_documents(spark):
    """Every document that holds a whole item is found; nothing else without its words."""
    from gleanery.llm.queries import op10_benchmark_decontamination

    folder = "/root/testdata/sf0.01"
    plain = lambda t: [w for w in (benchmark._EDGES.sub("", x.lower()) for x in t.split()) if w]
    items = {r["item_id"]: plain(r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()}
    docs = {r["doc_id"]: plain(r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = {(r["doc_id"], r["item_id"]) for r in op10_benchmark_decontamination(spark, folder).collect()}
    want = set()
    for d, words in docs.items():
        text = f" {' '.join(words)} "
        want |= {(d, i) for i, item in items.items() if f" {' '.join(item)} " in text}
    assert want and want <= got
    for d, i in got - want:
        runs = {tuple(items[i][k : k + 13]) for k in range(len(items[i]) - 12)}
        held = {tuple(docs[d][k : k + 13]) for k in range(len(docs[d]) - 12)}
        assert runs & held or plain_alignment(items[i], docs[d]) / (2 * len(items[i])) >= 0.5


def test_words_in_a_row_of_a_long_item(spark):
    """Part of an item, word by word, is reported however small its share; as many scattered words are not."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghij", k=8))
    item = [word() for _ in range(200)]
    filler = lambda n: [word() for _ in range(n)]
    scattered = [x for w in item[:40] for x in (w, word())]
    rows = [
        (1, filler(30) + item[50:63] + filler(30)),
        (2, filler(30) + item[50:62] + filler(30)),
        (3, filler(30) + item[100:150] + filler(30)),
        (4, scattered),
        (5, item[80:93]),
    ]
    docs = spark.createDataFrame([(i, " ".join(w), "", "", "") for i, w in rows], DOCS)
    items = spark.createDataFrame([(7, " ".join(item), "")], ITEMS)
    got = {r["doc_id"]: r for r in contaminated(docs, items).collect()}
    assert {i: (r["start"], r["words"], r["run"]) for i, r in got.items()} == {1: (30, 13, 13), 3: (30, 50, 50), 5: (0, 13, 13)}


def test_rows_that_share_an_id_are_judged_each(spark):
    item = " ".join(f"word{i}" for i in range(30))
    rows = [(1, item), (1, "clean words of the same id"), (2, f"a {item} b"), (None, item), (None, "clean"), (None, None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, `my col.x` string")
    kept = without_leaks(docs, spark.createDataFrame([(1, item, "")], ITEMS))
    assert kept.columns == docs.columns
    assert sorted((tuple(r)[:2] for r in kept.collect()), key=repr) == sorted([rows[1], *rows[4:]], key=repr)
