"""Which calls a budget lets through, when refused calls do not count.

Calls are taken in the order of time and id. One goes through if its minute has a
request left and its tokens fit into what is left of the minute and of the day.
That chain runs through a whole day, however many calls the day holds, but few of
them can matter: a call whose minute has as many earlier calls of no more tokens
as it has requests is refused whatever happened before, because each of those
goes through whenever it would. Tasks and then minutes drop such calls, in any
order; what is left of a minute is about its requests times the logarithm of its
calls, and a day of that is settled call by call. All other calls find the state
they met in a table of one row per minute.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.functions import fixed
from gleanery.session import written

SALTS = 32  # groups a minute is thinned in before it is thinned as a whole
SMALL_MINUTES = 20_000  # rows of one minute each that may be broadcast
_HELD = 200_000  # calls a task holds before it thins them
_BLOCK = 4096


def open_calls(tokens: np.ndarray, requests: int) -> np.ndarray:
    """Places of the calls of a minute, in order, that have fewer than ``requests`` earlier ones of no more tokens."""
    if requests < 1:
        return np.empty(0, np.int64)
    out, least = [], np.empty(0, tokens.dtype)  # the least tokens so far, ascending
    for a in range(0, len(tokens), _BLOCK):
        block = tokens[a : a + _BLOCK]
        # What the calls before this block rule out needs no closer look.
        maybe = np.flatnonzero(block < least[-1]) if len(least) == requests else np.arange(len(block))
        for i in maybe.tolist():
            value = block[i]
            if len(least) < requests or value < least[-1]:
                out.append(a + i)
                least = np.insert(least, np.searchsorted(least, value, "right"), value)[:requests]
    return np.array(out, np.int64)


def _thinned(calls: pd.DataFrame, requests: int, most_tokens: int) -> pd.DataFrame:
    """The calls that may go through, minute by minute, in order."""
    calls = calls.sort_values(["minute", "t", "call_id"], kind="stable")
    minutes, tokens = calls["minute"].to_numpy(), calls["tokens"].to_numpy()
    edges = np.append(np.flatnonzero(np.diff(minutes, prepend=minutes[:1] - 1)), len(minutes))
    places = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        fits = a + np.flatnonzero(tokens[a:b] <= most_tokens)
        # The first call stays in any case: it stands for the state its minute begins with.
        places.append(np.union1d([a], fits[open_calls(tokens[fits], requests)]))
    return calls.iloc[np.concatenate(places).astype(np.int64) if places else []]


def _thin(rows: DataFrame, requests: int, most_tokens: int) -> DataFrame:
    """Each task's calls without those that cannot go through, in bounded memory."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, grown = [], 0, _HELD
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size >= grown:
                kept = _thinned(pd.concat(held), requests, most_tokens)
                if len(kept) > grown // 2:  # many minutes: those that went before go out
                    yield kept
                    kept = kept.iloc[:0]
                held, size = [kept], len(kept)
        if held:
            yield _thinned(pd.concat(held), requests, most_tokens)

    return rows.mapInPandas(work, rows.schema)


def _settle(calls: pd.DataFrame, requests: int, minute_tokens: int, day_tokens: int) -> pd.DataFrame:
    """Calls of one day that go through, in order, with the counts after each; a row before them for each minute."""
    calls = calls.sort_values(["minute", "t", "call_id"], kind="stable")
    out: list[tuple] = []
    of, n, used, day = None, 0, 0, 0
    for minute, t, call_id, tokens in zip(calls["minute"], calls["t"], calls["call_id"], calls["tokens"], strict=True):
        if minute != of:
            of, n, used = minute, 0, 0
            out.append((minute, None, None, 0, 0, day))
        if n < requests and used + tokens <= minute_tokens and day + tokens <= day_tokens:
            n, used, day = n + 1, used + tokens, day + tokens
            out.append((minute, t, call_id, n, used, day))
    return pd.DataFrame(out, columns=["minute", "t", "call_id", "requests", "tokens", "day_tokens"])


def admit_calls(
    calls: DataFrame,
    call_id: str = "call_id",
    ts: str = "ts",
    tokens: str = "tokens",
    requests_per_minute: int = fixed.REQUESTS_PER_MINUTE,
    tokens_per_minute: int = fixed.TOKENS_PER_MINUTE,
    tokens_per_day: int = fixed.TOKENS_PER_DAY,
) -> DataFrame:
    """``call_id, ts, tokens, admitted, refused_by, minute_requests, minute_tokens, day_tokens``: one row per call with a time.

    Calls go through in the order of ``ts`` and ``call_id`` (ids of any number
    type, different) while calendar minute and day have room; refused calls take none.
    ``refused_by`` names the first limit in the way: ``minute_tokens``,
    ``day_tokens`` or ``requests``. The counts are those after the call. Null and
    negative tokens are 0; calls without a time are left out.
    """
    spark = calls.sparkSession
    kind = calls.schema[call_id].dataType.simpleString()
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    log = calls.where(F.col(ts).isNotNull()).select(
        F.col(call_id).alias("call_id"),
        F.col(ts).alias("ts"),
        F.greatest(F.coalesce(F.col(tokens), F.lit(0)), F.lit(0)).cast("bigint").alias("tokens"),
    )
    stamp = micros.alias("t")
    minute = F.unix_micros(F.date_trunc("minute", F.col(ts).cast("timestamp"))).alias("minute")
    log = log.select("call_id", "ts", "tokens", stamp, minute)
    log = written(log, "calls")

    most = min(tokens_per_minute, tokens_per_day)
    thin = log.select("minute", "t", "call_id", "tokens")
    thin = _thin(thin, requests_per_minute, most)
    salt = F.pmod(F.xxhash64("t", "call_id"), F.lit(SALTS)).cast("int").alias("salt")
    thin = thin.select("*", salt).repartition("minute", "salt").drop("salt")
    thin = _thin(thin, requests_per_minute, most)
    thin = _thin(thin.repartition("minute"), requests_per_minute, most)
    day = F.date_trunc("day", F.timestamp_micros("minute")).alias("day")
    schema = f"minute long, t long, call_id {kind}, requests long, tokens long, day_tokens long"

    def settle(part: pd.DataFrame) -> pd.DataFrame:
        return _settle(part, requests_per_minute, tokens_per_minute, tokens_per_day)

    settled = written(thin.select("*", day).groupBy("day").applyInPandas(settle, schema), "admitted")
    # At most as many entries as the minute has requests, and one before them.
    states = settled.groupBy("minute").agg(
        F.array_sort(F.collect_list(F.struct("requests", "t", "call_id", "tokens", "day_tokens"))).alias("states")
    )
    states = written(states, "minutes")
    if states.count() <= SMALL_MINUTES:  # counted: a few kilobytes at the standard limits each
        states = F.broadcast(states)
    joined = log.join(states, "minute", "left")
    met = F.filter(
        "states",
        lambda s: s["t"].isNull()
        | (s["t"] < F.col("t"))
        | ((s["t"] == F.col("t")) & (s["call_id"] <= F.col("call_id"))),
    )
    last = F.element_at(met, -1)
    joined = joined.select("*", F.coalesce(last["call_id"] == F.col("call_id"), F.lit(False)).alias("admitted"), last.alias("state"))
    used, spent = F.col("state.tokens"), F.col("state.day_tokens")
    why = (
        F.when(used + F.col("tokens") > tokens_per_minute, "minute_tokens")
        .when(spent + F.col("tokens") > tokens_per_day, "day_tokens")
        .otherwise("requests")
    )
    return joined.select(
        "call_id",
        "ts",
        "tokens",
        "admitted",
        F.when(~F.col("admitted"), why).alias("refused_by"),
        F.col("state.requests").alias("minute_requests"),
        used.alias("minute_tokens"),
        spent.alias("day_tokens"),
    )
