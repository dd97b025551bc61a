"""Token usage, cost, budgets and errors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import fixed
from gleanery.functions.text import token_count
from gleanery.operators.ordering import running_sums


def request_tokens(messages: DataFrame, request: str, text: str) -> DataFrame:
    """Words per request, over its messages."""
    return messages.groupBy(request).agg(F.sum(token_count(F.col(text))).alias("tokens"))


def _rate(model: Column, prices: Mapping[str, tuple[float, float]], side: int) -> Column:
    rate = F.lit(None).cast("double")
    for name, pair in prices.items():
        rate = F.when(model == name, float(pair[side])).otherwise(rate)
    return rate


def _costed(usage: DataFrame, prices: Mapping[str, tuple[float, float]] | DataFrame) -> DataFrame:
    usage = usage.withColumns(
        {c: F.coalesce(F.col(c), F.lit(0).cast("bigint")) for c in ("input_tokens", "output_tokens")}
    )
    if isinstance(prices, DataFrame):
        # One price per model: of several the highest counts, so that no call is counted twice.
        known = prices.groupBy("model").agg(F.max("input").alias("_in"), F.max("output").alias("_out"))
        priced = usage.join(known, "model", "left")
    else:
        priced = usage.withColumns({"_in": _rate(F.col("model"), prices, 0), "_out": _rate(F.col("model"), prices, 1)})
    cost = F.col("input_tokens") * F.col("_in") + F.col("output_tokens") * F.col("_out")
    return priced.withColumns({"cost": cost, "unpriced": F.col("_in").isNull()}).drop("_in", "_out")


def call_cost(
    usage: DataFrame, prices: Mapping[str, tuple[float, float]] | DataFrame = fixed.MODEL_PRICES
) -> DataFrame:
    """Cost of each call; missing counts are 0; a model without a price has no cost and is flagged.

    Prices held by the driver become constants in the plan; a price table is
    joined, and Spark broadcasts it if its measured size allows.
    """
    return _costed(usage, prices)


def run_totals(
    usage: DataFrame,
    prices: Mapping[str, tuple[float, float]] | DataFrame = fixed.MODEL_PRICES,
    by: Sequence[str] = (),
    counts: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Calls, tokens and cost of a run, or per ``by``; ``counts`` adds how many calls meet a condition.

    Tokens are first summed as integers per model, so the prices meet a handful
    of rows and the cost does not depend on the order of the calls.
    """
    per_model = usage.groupBy(*by, "model").agg(
        F.count("*").alias("calls"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        *[F.count_if(condition).alias(name) for name, condition in (counts or {}).items()],
    )
    return (
        _costed(per_model, prices)
        .groupBy(*by)
        .agg(
            F.coalesce(F.sum("calls"), F.lit(0)).alias("calls"),
            F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
            F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
            F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"),
            F.coalesce(F.sum(F.when(F.col("unpriced"), F.col("calls"))), F.lit(0)).alias("unpriced_calls"),
            *[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in counts or {}],
        )
    )


def budget_breaches(
    calls: DataFrame,
    call_id: str = "call_id",
    ts: str = "ts",
    tokens: str = "tokens",
    requests_per_minute: int = fixed.REQUESTS_PER_MINUTE,
    tokens_per_minute: int = fixed.TOKENS_PER_MINUTE,
    tokens_per_day: int = fixed.TOKENS_PER_DAY,
) -> DataFrame:
    """Calls that would pass a limit of their calendar minute or day.

    Every call counts towards its window. A minute or a day may hold any share
    of the log: running sums are taken over chunks of the time order.
    """
    log = calls.select(
        F.col(call_id).alias("call_id"),
        F.col(ts).alias("ts"),
        F.coalesce(F.col(tokens), F.lit(0)).cast("bigint").alias("tokens"),
        F.date_trunc("minute", ts).alias("minute"),
        F.date_trunc("day", ts).alias("day"),
    ).where(F.col("ts").isNotNull())  # a call without a time is in no window
    counted = running_sums(
        log,
        ["ts", "call_id"],
        {
            ("minute",): {"minute_requests": F.lit(1).cast("bigint"), "minute_tokens": F.col("tokens")},
            ("day",): {"day_tokens": F.col("tokens")},
        },
    )
    flags = {
        "over_requests": F.col("minute_requests") > requests_per_minute,
        "over_minute": F.col("minute_tokens") > tokens_per_minute,
        "over_day": F.col("day_tokens") > tokens_per_day,
    }
    return (
        counted.withColumns(flags)
        .where(F.col("over_requests") | F.col("over_minute") | F.col("over_day"))
        .drop("minute", "day")
    )


def retry_wait(message: Column) -> Column:
    """Seconds the service asked to wait, null when it named none."""
    return F.nullif(F.regexp_extract(message, fixed.RETRY_PATTERN, 1), F.lit("")).try_cast("double")


def triage_errors(errors: DataFrame, message: str = "msg") -> DataFrame:
    """Adds ``action`` (wait, backoff, stop) and ``wait_seconds`` for wait."""
    limited = F.contains(F.col(message), F.lit(fixed.RATE_LIMIT_MARK))
    wait = retry_wait(F.col(message))
    action = (
        F.when(limited & F.coalesce(wait != 0, F.lit(False)), "wait")
        .when(limited | F.contains(F.col(message), F.lit(fixed.UNAVAILABLE_MARK)), "backoff")
        .otherwise("stop")
    )
    return errors.withColumn("action", action).withColumn("wait_seconds", F.when(F.col("action") == "wait", wait))


def error_report(triaged: DataFrame) -> DataFrame:
    """Errors and longest wait per action."""
    return triaged.groupBy("action").agg(F.count("*").alias("errors"), F.max("wait_seconds").alias("longest_wait"))
