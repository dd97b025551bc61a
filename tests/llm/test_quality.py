import random
import re
from collections import Counter, defaultdict

import pytest

from gleanery.llm import quality

SCHEMA = "doc_id long, text string, source string, kept string, row string, salt string"
SPACE = "[\x20\x09-\x0d]+"


def words_of(text):
    return [w for w in re.split(SPACE, text) if w]


def normal(line):
    return re.sub("[0-9]+", "0", re.sub(SPACE, " ", line.lower()).strip(" "))


def base(text):
    text = text or ""
    words = words_of(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    counts = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if words_of(x)]
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(covered),
    )


def expected(rows, docs=3):
    texts = {(s or "", t) for _, t, s in rows if t is not None}
    held, hosts = defaultdict(set), Counter(s for s, _ in texts)
    for s, t in texts:
        for line in t.split("\n"):
            if words_of(line):
                held[s, normal(line)].add(t)
    often = {k for k, v in held.items() if len(v) >= docs and len(v) ** 2 > hosts[k[0]]}
    out = []
    for i, t, s in rows:
        n, *rest = base(t)
        lost = sum(len(words_of(x)) for x in (t or "").split("\n") if words_of(x) and (s or "", normal(x)) in often)
        failed = n < 20 or 100 * rest[-1] > 30 * n
        out.append((i, n, *rest, failed, not failed and lost <= n / 2 and n - lost >= 20, lost))
    return sorted(out, key=repr)


def sample():
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdé", k=rng.randrange(1, 7))) for _ in range(200)]
    line = lambda n: " ".join(rng.choices(words, k=n))
    common = [f"Share  this page {n} times & more" for n in range(40)]
    rows = [(i, "\n".join([line(rng.randrange(1, 30)), line(9)]), f"h{i % 4}") for i in range(60)]
    rows += [(100 + i, f"{line(12)}\n{common[i % 7]}\n{line(20)}", "h1") for i in range(20)]
    rows += [(200 + i, f"{line(5)}\n" + "\n".join(common[:6]), "h1") for i in range(20)]
    rows += [(300 + i, rows[0][1], "h0") for i in range(30)]
    repeated = line(10)
    rows += [(400, f"{repeated}\n{line(30)}\n{repeated}", "h2"), (401, "a " * 500, "h2"), (402, "b\n" * 30, None)]
    rows += [(403, None, "h3"), (404, "", "h3"), (405, " \n\t\x0b \n", None), (None, line(40), "h3"), (406, line(20_000), "h3")]
    rows += [(407, "one two three four five six seven eight", "h3"), (408, "#*$%&|<> " * 30 + line(25), "h3")]
    return rows + rows[-5:]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], SCHEMA).repartition(4)


@pytest.mark.parametrize("limit", [None, "BROADCAST_LINES", "HOST_LINES"])
def test_equals_brute_force(spark, monkeypatch, limit):
    if limit:
        monkeypatch.setattr(quality, limit, 0)
    rows = sample()
    got = quality.judge(frame(spark, rows), line_docs=3)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected(rows)


@pytest.mark.parametrize("limit", [None, "HOST_LINES"])
def test_kept_rows_lose_boilerplate_lines(spark, monkeypatch, limit):
    if limit:
        monkeypatch.setattr(quality, limit, 0)
    rows = sample()
    kept = Counter(r[0] for r in expected(rows) if r[-2])
    got = quality.keep_good(frame(spark, rows), line_docs=3)
    assert got.columns == ["doc_id", "text", "source", "kept", "row", "salt"]
    assert Counter(r["doc_id"] for r in got.collect()) == kept
    texts = {r["doc_id"]: r["text"] for r in got.collect()}
    assert texts[100].count("\n") == 1 and "Share" not in texts[100]
    assert texts[1] == dict((r[0], r[1]) for r in rows)[1]


def test_no_rows(spark):
    assert quality.judge(frame(spark, [])).collect() == []
    assert quality.keep_good(frame(spark, [])).collect() == []


def test_no_python_in_the_plan(spark):
    plan = quality.judge(frame(spark, sample()))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_query_over_all_documents(spark):
    from gleanery.llm.queries import op6_quality_rules

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    got = sorted((tuple(r) for r in op6_quality_rules(spark, folder).collect()), key=repr)
    assert got == expected([(r["doc_id"], r["text"], r["source"]) for r in docs], docs=20)


def test_default_limits_on_given_documents(spark):
    """Lines go and documents are depleted without any limit being lowered for the test."""
    folder = "/root/testdata/sf0.1"
    got = quality.judge(spark.read.parquet(f"{folder}/documents.parquet")).where("removed_words > 0").collect()
    assert len(got) > 1000 and any(not r["kept"] and not r["base_failed"] for r in got)


def test_names_with_spaces_and_very_long_texts(spark):
    long = "\n".join(f"word{i} and others of line {chr(97 + i % 26) * (i % 30 + 1)}" for i in range(100_000))
    rows = [(1, long, "h", "x"), (2, None, None, None), (None, "", "h", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, `my col.x` string")
    got = quality.keep_good(docs)
    assert got.columns == docs.columns
    assert [tuple(r) for r in got.collect()] == [rows[0]]
