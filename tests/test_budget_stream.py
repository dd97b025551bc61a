import datetime
import random

import pandas as pd
from gleanery.streaming.budget_stream import Budget, Ledger, admitted_calls, settle
from gleanery.streaming.page_stream import append_to

SCHEMA = "call_id long, model string, ts timestamp, tokens long, wait_seconds double"
BUDGET = Budget(requests_per_minute=2, tokens_per_minute=300, tokens_per_day=900)
START = datetime.datetime(2024, 1, 1, 23, 0, tzinfo=datetime.timezone.utc)


def calls(n=400):
    rng = random.Random(3)
    times = sorted(rng.randrange(2 * 3600 * 10**6) for _ in range(n))
    rows = []
    for i, t in enumerate(times):
        wait = rng.choice([20.5, 90.0]) if rng.random() < 0.05 else None
        rows.append((i, rng.choice("abb"), START + datetime.timedelta(microseconds=t), rng.choice([0, 10, 80, 400, None]), wait))
    return rows


def one_run(rows):
    out = []
    for model in sorted({r[1] for r in rows}):
        own = pd.DataFrame([(*r[:2], r[2].replace(tzinfo=None), *r[3:]) for r in rows if r[1] == model], columns=["call_id", "model", "ts", "tokens", "wait_seconds"])
        decided = settle(own, Ledger(), BUDGET)
        out += [(model, *r[:1], *r[2:]) for r in decided.itertuples(index=False)]
    return sorted(out)


def rows_of(frame):
    return sorted((r.model, r.call_id, r.tokens, r.admitted, r.refused_by, r.minute_requests, r.minute_tokens, r.day_tokens) for r in frame.collect())


def test_batches_with_restarts_decide_as_one_run(spark, tmp_path):
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    rows = calls()
    for k in range(3):  # the stream starts anew for each part, from its checkpoint
        part = rows[k * 140 : (k + 1) * 140]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = admitted_calls(spark.readStream.schema(SCHEMA).parquet(source), BUDGET)
        append_to(stream, target, state, once=True).awaitTermination()
    got = rows_of(spark.read.parquet(target))
    want = one_run(rows)
    assert got == want
    assert {r[4] for r in got} == {None, "wait", "minute_tokens", "day_tokens", "requests"}

    late = [(9000, "a", START + datetime.timedelta(minutes=115), 1, None), (9001, "a", None, 1, None), (9002, "new", START + datetime.timedelta(hours=2), 1, None)]
    spark.createDataFrame(late, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    append_to(admitted_calls(spark.readStream.schema(SCHEMA).parquet(source), BUDGET), target, state, once=True).awaitTermination()
    more = [r for r in rows_of(spark.read.parquet(target)) if r[1] >= 9000]
    assert [(r[0], r[1], r[4]) for r in more] == [("a", 9000, "late" if max(r[2] for r in rows if r[1] == "a") > late[0][2] + datetime.timedelta(minutes=1) else None), ("new", 9002, None)]


def test_a_new_minute_and_day_start_afresh():
    ledger, minute, day = Ledger(), 60_000_000, 86_400_000_000
    one = Budget(1, 100, 150)
    assert [ledger.decide(t, 100, one) for t in (0, 1, minute, day, day - 1)] == [None, "minute_tokens", "day_tokens", None, "late"]
    ledger.wait(day + minute, 30)
    assert [ledger.decide(day + 2 * minute + s * 1_000_000, 0, one) for s in (-31, 0)] == ["wait", None]
