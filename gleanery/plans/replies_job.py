"""Replies to records, cost and totals."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.functions import fixed
from gleanery.operators.listings import unwrap_records
from gleanery.operators.replies import parse_replies
from gleanery.operators.usage import call_cost, run_totals
from gleanery.sources.sinks import write_run


def reply_records(replies: DataFrame, key: str = "page_id") -> DataFrame:
    """Records of the replies that parsed: ``key, pos, record, reason``."""
    parsed = parse_replies(replies)
    return unwrap_records(parsed.where("ok"), key)


def listing_documents(replies: DataFrame, key: str = "page_id", reply: str = "reply") -> DataFrame:
    """The replies that parsed as listing documents ``file, text``, named as a listing scan expects them.

    That is what the merge reads: the table can be handed on as it is, without
    going through loose files.
    """
    name = F.concat(F.lit(fixed.LISTING_PREFIX + "_"), F.col(key).cast("string"), F.lit(fixed.LISTING_SUFFIX))
    parsed = parse_replies(replies, reply=reply).where("ok")
    return parsed.select(name.alias("file"), F.to_json("doc").alias("text"))


def write_replies(replies: DataFrame, folder: str, key: str = "page_id", run_key: str | None = None) -> str:
    """Replies, whether they parsed, and their records' documents below ``folder``, one part for each ``run_key``."""
    kept = [run_key] if run_key else []
    parsed = parse_replies(replies)
    return write_run(parsed.select(key, *kept, "ok", F.to_json("doc").alias("document")), folder, "parquet", run_key)


def reply_costs(
    replies: DataFrame, prices: Mapping[str, tuple[float, float]] | DataFrame = fixed.MODEL_PRICES
) -> DataFrame:
    """Replies with tokens and cost; a failed reply counts nothing."""
    return call_cost(parse_replies(replies), prices).drop("doc")


def reply_totals(
    replies: DataFrame, prices: Mapping[str, tuple[float, float]] | DataFrame = fixed.MODEL_PRICES
) -> DataFrame:
    """One row: calls, tokens, cost and failed pages of the run, in one pass over the replies."""
    return run_totals(parse_replies(replies), prices, counts={"failed": ~F.col("ok")})
