import zlib

import pytest

from gleanery.llm import toxicity
from gleanery.llm.toxicity import INSULT, OTHER, SYMBOLS, Transducer, clause_score, compose, grammar, score_toxicity

DOCS = "doc_id long, text string, score string, held_out string, body string"
LABELS = "doc_id long, toxic int, quality int"


def clause(*kinds):
    return clause_score([(k, 3.0 if k == INSULT else 0.0) for k in kinds])


def test_the_grammar_weighs_matched_clauses():
    plain = clause(OTHER, INSULT)
    assert plain == 3.0
    assert clause("target", OTHER, INSULT) > plain
    assert clause(INSULT, "target") > plain
    assert clause("negation", OTHER, INSULT) < plain
    assert clause("report", OTHER, INSULT) < plain
    assert clause("negation", OTHER, OTHER, OTHER, OTHER, INSULT) == plain  # out of reach
    assert clause("threat", OTHER) == 0
    assert clause("target", "threat") > 0
    assert clause("negation", "threat", "target") == 0
    assert clause("negation", "target", "threat") == 0
    assert clause(OTHER) == 0


def test_composition_equals_running_one_after_the_other():
    a = Transducer("a", {("a", "x"): ("b", "y", (1.0, 2.0)), ("b", "x"): ("a", "x", (0.5, 1.0))})
    b = Transducer("c", {("c", "y"): ("d", "x", (0.0, 3.0)), ("d", "x"): ("c", "y", (2.0, 0.5))})
    joined = compose(a, b, ("x", "y"))
    for word in ("xxyxyx", "yyx", "xxxxxx"):
        sa, sb, sj = a.start, b.start, joined.start
        for symbol in word:
            sa, middle, (add1, by1) = a.step(sa, symbol)
            sb, put, (add2, by2) = b.step(sb, middle)
            sj, last, weight = joined.arcs[sj, symbol]
            assert (last, weight, sj) == (put, (add1 + add2, by1 * by2), f"{sa}+{sb}")


def test_the_composed_machine_is_complete():
    machine = grammar()
    assert all((state, symbol) in machine.arcs for state in machine.states() for symbol in SYMBOLS)


def test_null_empty_repeated_and_unlabelled(spark):
    long = "word " * 40_000
    rows = [(1, None), (2, ""), (None, "you filth"), (None, "you filth"), (3, long), (4, "x")]
    docs = spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], DOCS)
    none = spark.createDataFrame([], LABELS)
    odd = spark.createDataFrame([(1, None, 0), (None, 1, 0), (4, 1, None), (4, 0, None), (4, 1, 1)], LABELS)
    for labels in (none, odd):
        got = score_toxicity(docs, labels).collect()
        assert len(got) == len(rows)
        assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
        for r in got:
            held = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
            assert r["held_out"] == held
    assert score_toxicity(spark.createDataFrame([], DOCS), odd).collect() == []


def auc(pairs):
    good = [s for s, y in pairs if y]
    bad = [s for s, y in pairs if not y]
    return sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad))


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.1"])
def test_accuracy_on_held_out_labels(spark, folder):
    from gleanery.llm.queries import op3_toxicity

    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = op3_toxicity(spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    held = [(r["score"], labels[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    toxic = [p for _, y, p in held if y]
    clean = [p for _, y, p in held if not y]
    print("auc", auc([(s, y) for s, y, _ in held]), "recall", sum(toxic) / len(toxic), "false", sum(clean) / len(clean))
    assert auc([(s, y) for s, y, _ in held]) > 0.9
    assert sum(toxic) / len(toxic) > 0.7
    assert sum(clean) / len(clean) < 0.05


def test_labels_of_the_held_out_fold_are_not_used(spark):
    rows = [(i, f"the {'grumf' if i % 3 == 0 else 'house'} number{i}", "", "", "") for i in range(200)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = [(i, int(i % 3 == 0), 0) for i in range(200)]
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y, q) for i, y, q in labels]
    a, b = (toxicity.fit(docs, spark.createDataFrame(x, LABELS)) for x in (labels, turned))
    assert a == b and "grumf" in a.learned
