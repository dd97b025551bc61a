import datetime
import random

import numpy as np
import pytest

from gleanery.operators import admission
from gleanery.operators.admission import admit_calls, open_calls

SCHEMA = "call_id long, ts timestamp, tokens long, admitted string, minute string"
START = datetime.datetime(2024, 1, 1, 23, 50)


def one_by_one(calls, requests, minute_tokens, day_tokens):
    out, minute, day = [], None, None
    n = used = spent = 0
    for call_id, ts, tokens in sorted((c for c in calls if c[1] is not None), key=lambda c: (c[1], c[0])):
        tokens = max(tokens or 0, 0)
        if ts.replace(second=0, microsecond=0) != minute:
            minute, n, used = ts.replace(second=0, microsecond=0), 0, 0
        if ts.date() != day:
            day, spent = ts.date(), 0
        why = None
        if used + tokens > minute_tokens:
            why = "minute_tokens"
        elif spent + tokens > day_tokens:
            why = "day_tokens"
        elif n >= requests:
            why = "requests"
        else:
            n, used, spent = n + 1, used + tokens, spent + tokens
        out.append((call_id, ts, tokens, why is None, why, n, used, spent))
    return sorted(out)


def sample(seed, n=1500):
    """A third of all calls in one minute, the others over four days' edges."""
    rng = random.Random(seed)
    calls = []
    for i in range(n):
        at = datetime.timedelta(minutes=7) if i % 3 == 0 else datetime.timedelta(minutes=rng.choice([0, 3, 9, 10, 11, 40, 1500, 3000]))
        ts = START + at + datetime.timedelta(microseconds=rng.choice([0, rng.randrange(60_000_000)]))
        calls.append((i, ts, rng.choice([0, 1, 5, 30, 100, 400, 2000, None, -3])))
    return calls + [(n, None, 5)]


def answer(spark, calls, *limits):
    df = spark.createDataFrame([(*c, "clash", "clash") for c in calls], SCHEMA).repartition(6)
    got = admit_calls(df, requests_per_minute=limits[0], tokens_per_minute=limits[1], tokens_per_day=limits[2])
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("limits", [(30, 2000, 6000), (5, 10_000, 3000), (1000, 900, 10**9), (0, 10, 10), (3, 50, 1), (10**6, 10**9, 10**9)])
def test_equals_a_run_one_by_one(spark, many_chunks, limits):
    calls = sample(1)
    assert answer(spark, calls, *limits) == one_by_one(calls, *limits)


def test_little_memory_changes_nothing(spark, many_chunks, monkeypatch):
    monkeypatch.setattr(admission, "_HELD", 40)
    monkeypatch.setattr(admission, "_BLOCK", 16)
    monkeypatch.setattr(admission, "SMALL_MINUTES", 0)
    calls = sample(2)
    assert answer(spark, calls, 4, 900, 5000) == one_by_one(calls, 4, 900, 5000)


def test_few_calls_of_a_minute_are_left(spark):
    rng = np.random.default_rng(1)
    tokens = rng.integers(0, 10**6, 300_000)
    left = open_calls(tokens, 30)
    assert 30 <= len(left) < 500
    values = tokens[:5000]
    want = [i for i in range(len(values)) if np.count_nonzero(values[:i] <= values[i]) < 30]
    assert open_calls(values, 30).tolist() == want


def test_no_calls(spark):
    assert answer(spark, [(1, None, 3)], 1, 1, 1) == []
