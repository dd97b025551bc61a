import random
from collections import defaultdict

from pyspark.sql import functions as F

from gleanery.operators.ordering import number_rows, ordered_chunks, running_sums
from gleanery.operators.usage import budget_breaches


def hot_rows(n=3000):
    """A third of all rows share one leading key."""
    rng = random.Random(5)
    return [("hot" if rng.random() < 0.34 else f"k{rng.randint(0, 50):02}", i, rng.randint(0, 9)) for i in rng.sample(range(n), n)]


def test_numbers_are_consecutive_and_ordered(spark, many_chunks):
    data = hot_rows()
    df = spark.createDataFrame(data, "k string, i int, v int").repartition(5)
    chunks = ordered_chunks(df, ["k", "i"])
    sizes = {r.chunk: r["count"] for r in chunks.groupBy("chunk").count().collect()}
    assert len(sizes) > 1 and max(sizes.values()) < len(data) * 0.45
    hot = chunks.where("k = 'hot'").select("chunk").distinct().count()
    assert hot > 1, "the hot key spreads over chunks"
    got = [(r.k, r.i) for r in number_rows(df, ["k", "i"]).orderBy("n").collect()]
    assert got == sorted((k, i) for k, i, _ in data)
    assert [r.n for r in number_rows(df, ["k", "i"]).select("n").orderBy("n").collect()] == list(range(1, len(data) + 1))


def test_running_sums_match_a_loop(spark, many_chunks):
    data = hot_rows()
    df = spark.createDataFrame(data, "k string, i int, v int").repartition(5)
    got = running_sums(df, ["k", "i"], {("k",): {"s": F.col("v"), "n": F.lit(1)}})
    sums, counts, expected = defaultdict(int), defaultdict(int), []
    for k, i, v in sorted(data):
        sums[k] += v
        counts[k] += 1
        expected.append((k, i, sums[k], counts[k]))
    assert sorted((r.k, r.i, r.s, r.n) for r in got.collect()) == expected


def test_budget_breaches_match_a_loop(spark, many_chunks):
    rng = random.Random(3)
    # One minute holds most calls of one day; days 2 and 3 are quiet.
    calls = [(i, 1_700_000_000 - 1_700_000_000 % 86400 + (40 if rng.random() < 0.5 else rng.randint(0, 3 * 86400)), rng.randint(0, 90)) for i in range(2000)]
    df = spark.createDataFrame(calls, "call_id int, s bigint, tokens int").withColumn("ts", F.timestamp_seconds("s")).repartition(6)
    got = budget_breaches(df, requests_per_minute=30, tokens_per_minute=2000, tokens_per_day=20_000)
    minute_n, minute_t, day_t, expected = defaultdict(int), defaultdict(int), defaultdict(int), {}
    for i, s, tokens in sorted(calls, key=lambda c: (c[1], c[0])):
        minute_n[s // 60] += 1
        minute_t[s // 60] += tokens
        day_t[s // 86400] += tokens
        flags = (minute_n[s // 60] > 30, minute_t[s // 60] > 2000, day_t[s // 86400] > 20_000)
        if any(flags):
            expected[i] = flags
    assert {r.call_id: (r.over_requests, r.over_minute, r.over_day) for r in got.collect()} == expected
