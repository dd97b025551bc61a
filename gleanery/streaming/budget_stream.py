"""Budgets and waits on calls as they arrive: keyed state with an end.

Each model has its own state: what its minute and day have used, and until when
the service asked to wait. A micro-batch takes the calls of a model in the order of
time and id, so batches that arrive in order decide as one run over all calls does.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gleanery.functions import fixed

_MINUTE = 60_000_000
_DAY = 24 * 60 * _MINUTE
_STATE = "minute long, requests long, tokens long, day long, spent long, until long"
_DECIDED = (
    "model string, call_id long, ts timestamp, tokens long, admitted boolean, refused_by string,"
    " minute_requests long, minute_tokens long, day_tokens long"
)


@dataclass(frozen=True)
class Budget:
    requests_per_minute: int = fixed.REQUESTS_PER_MINUTE
    tokens_per_minute: int = fixed.TOKENS_PER_MINUTE
    tokens_per_day: int = fixed.TOKENS_PER_DAY


class Ledger:
    """What one model has used; times are microseconds of UTC."""

    def __init__(self, held: tuple[int, ...] | None = None):
        self.minute, self.requests, self.tokens, self.day, self.spent, self.until = held or (-1, 0, 0, -1, 0, -1)

    def held(self) -> tuple[int, ...]:
        return self.minute, self.requests, self.tokens, self.day, self.spent, self.until

    def wait(self, t: int, seconds: float) -> None:
        """The service refused a call and named a time to wait; that call has used nothing."""
        self.until = max(self.until, t + round(seconds * 1_000_000))

    def decide(self, t: int, tokens: int, budget: Budget) -> str | None:
        """Why a call is refused, or None when it goes through. Calls of minutes gone by are late and change nothing."""
        minute, day = t - t % _MINUTE, t - t % _DAY
        if minute < self.minute:
            return "late"
        if minute > self.minute:
            self.minute, self.requests, self.tokens = minute, 0, 0
        if day > self.day:
            self.day, self.spent = day, 0
        if t < self.until:
            return "wait"
        if self.tokens + tokens > budget.tokens_per_minute:
            return "minute_tokens"
        if self.spent + tokens > budget.tokens_per_day:
            return "day_tokens"
        if self.requests >= budget.requests_per_minute:
            return "requests"
        self.requests, self.tokens, self.spent = self.requests + 1, self.tokens + tokens, self.spent + tokens
        return None


def settle(calls: pd.DataFrame, ledger: Ledger, budget: Budget) -> pd.DataFrame:
    """Decisions on a model's calls (``call_id, ts, tokens, wait_seconds``), in order; rows with a wait are no calls."""
    calls = calls.dropna(subset=["ts"]).sort_values(["ts", "call_id"], kind="stable")
    times = calls["ts"].astype("datetime64[us]").astype("int64")
    out = []
    for call_id, ts, t, tokens, wait in zip(calls["call_id"], calls["ts"], times, calls["tokens"], calls["wait_seconds"], strict=True):
        if not pd.isna(wait):
            ledger.wait(t, float(wait))
            continue
        tokens = 0 if pd.isna(tokens) else max(0, int(tokens))
        why = ledger.decide(t, tokens, budget)
        out.append((call_id, ts, tokens, why is None, why, ledger.requests, ledger.tokens, ledger.spent))
    names = ["call_id", "ts", "tokens", "admitted", "refused_by", "minute_requests", "minute_tokens", "day_tokens"]
    return pd.DataFrame(out, columns=names)


def admitted_calls(calls: DataFrame, budget: Budget = Budget(), lateness: str = "10 minutes") -> DataFrame:  # noqa: B008  it cannot change
    """``model, call_id, ts, tokens, admitted, refused_by`` and the counts after each call, for a stream of calls.

    ``calls`` has ``call_id, model, ts, tokens, wait_seconds``: a row with a wait
    stands for a call that the service refused, and closes the model until the wait is
    over. A call of a minute before the model's latest is refused as ``late``; a
    call without a time is left out. A model's state goes when the watermark,
    ``lateness`` behind the latest call, has passed the end of its day.
    """

    def step(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        ledger = Ledger(state.get if state.exists else None)
        decided = settle(pd.concat(list(batches)), ledger, budget)  # a micro-batch
        state.update(ledger.held())
        over = (max(ledger.day, 0) + _DAY) // 1000
        state.setTimeoutTimestamp(max(over, state.getCurrentWatermarkMs() + 1))
        decided.insert(0, "model", key[0])
        yield decided

    named = calls.select("model", "call_id", "ts", "tokens", "wait_seconds").withWatermark("ts", lateness)
    return named.groupBy("model").applyInPandasWithState(step, _DECIDED, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
