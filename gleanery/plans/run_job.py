"""One run: seeds and pages to a written folder of numbered pages and requests, and its totals once replies are there."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.functions import fixed
from gleanery.functions.urls import run_key
from gleanery.operators.replies import parse_replies
from gleanery.operators.usage import run_totals
from gleanery.plans.pages_job import pages_job
from gleanery.session import written
from gleanery.sources.sinks import write_run

_COUNTS = ("calls", "input_tokens", "output_tokens", "cost", "unpriced_calls", "failed")


@dataclass(frozen=True)
class PagesRun:
    """Where a run was written: its name, the pages' text and the requests, each one folder per run."""

    name: str | None
    pages: str
    requests: str


def write_pages(
    seeds: DataFrame,
    pages: DataFrame,
    folder: str,
    fields: Sequence[str] = (),
    started: datetime | None = None,
    nav_class: str | None = fixed.PAGINATION_CLASS,
    max_depth: int | None = None,
    mode: str = "errorifexists",
) -> PagesRun:
    """Run the pages job and write what it makes, under the run's name: site of the first seed and start time.

    Below ``folder``, ``pages`` holds ``file_no, seed_pos, url, markdown`` and
    ``requests`` holds ``file_no, seed_pos, system_prompt, user_prompt``, both by
    ``run``. A page that could not be fetched keeps its number, without text. The
    job runs once; both tables are written from its result. Without seeds nothing
    is written under a run's name and ``name`` is null.
    """
    spark = seeds.sparkSession
    when = F.lit(started or datetime.now()).cast("timestamp")
    first = seeds.orderBy("seed_pos").select(run_key(F.col("url"), when).alias("run")).first()  # one row
    name = first["run"] if first else None
    made = written(pages_job(seeds, pages, fields, nav_class, max_depth), "requests")
    made = made.withColumn("run", F.lit(name).cast("string"))
    target = folder.rstrip("/")
    texts = write_run(made.select("run", "file_no", "seed_pos", "url", "markdown"), f"{target}/pages", "parquet", "run", mode)
    asked = made.select("run", "file_no", "seed_pos", "system_prompt", "user_prompt")
    return PagesRun(name, texts, write_run(asked, f"{target}/requests", "parquet", "run", mode))


def run_report(
    requests: DataFrame, replies: DataFrame, prices: Mapping[str, tuple[float, float]] | DataFrame = fixed.MODEL_PRICES
) -> DataFrame:
    """``seed_pos, pages, calls, input_tokens, output_tokens, cost, unpriced_calls, failed``: a run's totals per seed.

    ``replies`` (``page_id, reply, model, input_tokens, output_tokens``) answer the
    request whose ``file_no`` they name; several replies to one request all count,
    replies to none do not. A failed reply counts no tokens. A seed without replies
    has zeros.
    """
    asked = requests.select(F.col("file_no").alias("page_id"), "seed_pos")
    parsed = parse_replies(replies).select("page_id", "model", "ok", "input_tokens", "output_tokens")
    totals = run_totals(parsed.join(asked, "page_id"), prices, by=["seed_pos"], counts={"failed": ~F.col("ok")})
    pages = requests.groupBy("seed_pos").agg(F.count("*").alias("pages"))
    joined = pages.join(totals, "seed_pos", "left")
    return joined.select("seed_pos", "pages", *[F.coalesce(c, F.lit(0)).cast(totals.schema[c].dataType).alias(c) for c in _COUNTS])
