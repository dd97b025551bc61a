"""Queries on usage, cost, budgets and errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions.text import token_count
from gleanery.operators import replies, usage
from gleanery.operators.admission import admit_calls
from gleanery.plans.replies_job import reply_totals
from gleanery.queries.tables import table

_DAY = 86_400_000_000  # microseconds
_PRICES = {"small": (0.5, 1.5), "large": (3.0, 12.25)}


def conversation_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One call per conversation: assistant words are output, all others input; who takes part decides the model."""
    words, role = token_count(F.col("text")), F.col("role")
    per_call = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("call_id")).agg(
        F.sum(F.when(role != "assistant", words)).alias("input_tokens"),
        F.sum(F.when(role == "assistant", words)).alias("output_tokens"),
        F.count_if(role == "system").alias("systems"),
        F.max("turn").alias("turns"),
    )
    model = F.when(F.col("systems") > 0, "small").when(F.col("turns") > 3, "large").otherwise("unlisted")
    return per_call.select("call_id", model.alias("model"), "input_tokens", "output_tokens")


def q_call_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.call_cost(conversation_usage(spark, sf_dir), _PRICES)


def q_run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.run_totals(conversation_usage(spark, sf_dir), _PRICES)


def q_model_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals per part of a run: here by model, the name kept beside its price."""
    calls = conversation_usage(spark, sf_dir).withColumn("part", F.col("model"))
    return usage.run_totals(calls, _PRICES, by=["part"])


def q_replies_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies in events.props, broken for errors; k and the user stand for the token counts."""
    event = F.col("event_type")
    calls = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("page_id"),
        F.when(event == "error", "no json").otherwise(F.col("props")).alias("reply"),
        F.when(event == "view", "small").when(event == "click", "large").when(event == "error", "small").otherwise("unlisted").alias("model"),
        F.get_json_object("props", "$.k").cast("bigint").alias("input_tokens"),
        F.col("user_id").alias("output_tokens"),
    )
    return reply_totals(calls, _PRICES)


def q_budget_breach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as a call log, with limits low enough to be passed."""
    calls = table(spark, sf_dir, "events").select("event_id", "ts", F.col("value").cast("bigint").alias("tokens"))
    breaches = usage.budget_breaches(
        calls, "event_id", requests_per_minute=1, tokens_per_minute=60, tokens_per_day=1500
    )
    return breaches.select("call_id", "minute_requests", "minute_tokens", "day_tokens", "over_requests", "over_minute", "over_day")


def q_budget_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as a call log, each day in its first forty minutes, so that every limit refuses some."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    ts = F.timestamp_micros(micros - micros % _DAY + F.floor(micros % _DAY / 36))
    calls = table(spark, sf_dir, "events").select("event_id", ts.alias("ts"), F.col("value").cast("bigint").alias("tokens"))
    decided = admit_calls(calls, "event_id", requests_per_minute=5, tokens_per_minute=200, tokens_per_day=6000)
    return decided.drop("ts", "tokens")


def q_request_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The standard limits over the words of all conversations, sent one second apart."""
    requests = usage.request_tokens(table(spark, sf_dir, "conversations"), "conv_id", "text")
    calls = requests.select("conv_id", F.timestamp_seconds("conv_id").alias("ts"), "tokens")
    breaches = usage.budget_breaches(calls, "conv_id")
    return breaches.select("call_id", "minute_requests", "minute_tokens", "day_tokens")


def event_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    event, value = F.col("event_type"), F.col("value").cast("string")
    message = (
        F.when(event == "error", F.concat(F.lit("code rate_limit_exceeded. Please try again in "), value, F.lit("s.")))
        .when(event == "view", F.concat(F.lit("rate_limit_exceeded after "), value))
        .when(event == "click", F.concat(F.lit("Error 503 for user "), F.col("user_id").cast("string")))
        .when(event == "signup", F.concat(F.lit("rate_limit_exceeded Please try again in ..s 503 "), value))
        .otherwise(F.concat(F.lit("bad key. Please try again in "), value, F.lit("s")))
    )
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("call_id"), message.alias("msg"))


def q_error_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.triage_errors(event_errors(spark, sf_dir)).select("call_id", "action", "wait_seconds")


def q_error_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.error_report(usage.triage_errors(event_errors(spark, sf_dir)))


QUERIES = {
    "call_cost": q_call_cost,
    "run_totals": q_run_totals,
    "model_totals": q_model_totals,
    "replies_job": q_replies_job,
    "budget_breach": q_budget_breach,
    "budget_admission": q_budget_admission,
    "request_budget": q_request_budget,
    "error_triage": q_error_triage,
    "error_report": q_error_report,
}


# --- SQL checks -------------------------------------------------------------

_WORDS = r"len(regexp_extract_all(text, '[^\s\pZ\x0b\x1c-\x1f\x85]+'))"
_USAGE = f"""
select conv_id as call_id,
  case when count(*) filter (role = 'system') > 0 then 'small' when max(turn) > 3 then 'large' else 'unlisted' end as model,
  cast(coalesce(sum({_WORDS}) filter (role <> 'assistant'), 0) as bigint) as input_tokens,
  cast(coalesce(sum({_WORDS}) filter (role = 'assistant'), 0) as bigint) as output_tokens
from conversations group by 1"""
_COST = """input_tokens * case model when 'small' then 0.5::double when 'large' then 3.0::double end
  + output_tokens * case model when 'small' then 1.5::double when 'large' then 12.25::double end"""
_TOTALS = f"""count(*) as calls, cast(coalesce(sum(input_tokens), 0) as bigint) as input_tokens,
  cast(coalesce(sum(output_tokens), 0) as bigint) as output_tokens, coalesce(sum({_COST}), 0.0::double) as cost,
  count(*) filter (model = 'unlisted') as unpriced_calls"""
_RUNNING = """
select call_id,
  cast(count(*) over (partition by date_trunc('minute', ts) order by ts, call_id rows unbounded preceding) as bigint) as minute_requests,
  cast(sum(tokens) over (partition by date_trunc('minute', ts) order by ts, call_id rows unbounded preceding) as bigint) as minute_tokens,
  cast(sum(tokens) over (partition by date_trunc('day', ts) order by ts, call_id rows unbounded preceding) as bigint) as day_tokens
from calls"""
_ACTION = """case event_type when 'error' then case when value <> 0 then 'wait' else 'backoff' end
  when 'view' then 'backoff' when 'click' then 'backoff' when 'signup' then 'backoff'
  else case when contains(cast(value as varchar), '503') then 'backoff' else 'stop' end end"""

ORACLES = {
    "call_cost": f"select *, {_COST} as cost, model = 'unlisted' as unpriced from ({_USAGE})",
    "run_totals": f"select {_TOTALS} from ({_USAGE})",
    "model_totals": f"select model as part, {_TOTALS} from ({_USAGE}) group by 1",
    "replies_job": f"""
with calls as (select event_type = 'error' as bad,
  case event_type when 'view' then 'small' when 'click' then 'large' when 'error' then 'small' else 'unlisted' end as model,
  case when event_type = 'error' then 0 else cast(json_extract(props, '$.k') as bigint) end as input_tokens,
  case when event_type = 'error' then 0 else user_id end as output_tokens from events)
select {_TOTALS}, count(*) filter (bad) as failed from calls""",
    "budget_breach": f"""
with calls as (select event_id as call_id, ts, cast(trunc(value) as bigint) as tokens from events),
r as ({_RUNNING}),
f as (select *, minute_requests > 1 as over_requests, minute_tokens > 60 as over_minute, day_tokens > 1500 as over_day from r)
select * from f where over_requests or over_minute or over_day""",
    # Call after call: each step takes the next call of every day.
    "budget_admission": f"""
with recursive calls as (
  select event_id as call_id, greatest(cast(trunc(value) as bigint), 0) as tokens,
    make_timestamp(epoch_us(ts) - epoch_us(ts) % {_DAY} + cast(floor(epoch_us(ts) % {_DAY} / 36) as bigint)) as ts from events),
c as (
  select *, date_trunc('minute', ts) as minute, date_trunc('day', ts) as day,
    row_number() over (partition by date_trunc('day', ts) order by ts, call_id) as k from calls),
s as (
  select day, cast(0 as bigint) as k, cast(null as timestamp) as minute, cast(null as bigint) as call_id, cast(null as varchar) as refused_by,
    cast(0 as bigint) as n, cast(0 as bigint) as used, cast(0 as bigint) as spent
  from (select distinct day from c) d
  union all
  select day, k, minute, call_id, why, n + case when why is null then 1 else 0 end, used + case when why is null then tokens else 0 end,
    spent + case when why is null then tokens else 0 end
  from (
    select x.*, case when used + tokens > 200 then 'minute_tokens' when spent + tokens > 6000 then 'day_tokens' when n >= 5 then 'requests' end as why
    from (
      select c.day, c.k, c.minute, c.call_id, c.tokens, s.spent, case when s.minute = c.minute then s.n else 0 end as n,
        case when s.minute = c.minute then s.used else 0 end as used
      from s join c on c.day = s.day and c.k = s.k + 1) x) y)
select call_id, refused_by is null as admitted, refused_by, n as minute_requests, used as minute_tokens, spent as day_tokens
from s where call_id is not null""",
    "request_budget": f"""
with calls as (select conv_id as call_id, to_timestamp(conv_id) as ts, sum({_WORDS}) as tokens from conversations group by 1, 2),
r as ({_RUNNING})
select * from r where minute_requests > 30 or minute_tokens > 20000 or day_tokens > 500000""",
    "error_triage": f"""
select event_id as call_id, {_ACTION} as action, case when event_type = 'error' and value <> 0 then value end as wait_seconds from events""",
    "error_report": f"""
select {_ACTION} as action, count(*) as errors, max(case when event_type = 'error' and value <> 0 then value end) as longest_wait
from events group by 1""",
}
