"""Fetched pages as a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.session import sized, written


def read_pages(spark: SparkSession, path: str, columns: Sequence[str] = ("page_id", "url", "html")) -> DataFrame:
    """The page table; name only the columns a job needs, html is by far the widest."""
    return spark.read.parquet(path).select(*columns)


def seed_list(spark: SparkSession, urls: Sequence[str]) -> DataFrame:
    """``seed_pos, url`` in the given order, duplicates kept."""
    return spark.createDataFrame(list(enumerate(urls)), "seed_pos int, url string")


def pages_of_seeds(seeds: DataFrame, pages: DataFrame) -> DataFrame:
    """Seeds with their fetched page; a seed without one keeps its row with null page columns.

    Found and missing seeds are joined apart, as an outer join could not
    broadcast the seeds and would move every page. Missing ones need addresses only.
    """
    columns = [c for c in pages.columns if c != "url"]
    found = pages.join(sized(seeds), "url").select("seed_pos", "url", *columns)
    missing = seeds.join(pages.select("url"), "url", "left_anti").select("seed_pos", "url")
    return found.unionByName(missing, allowMissingColumns=True)


def first_seen(pages: DataFrame) -> DataFrame:
    """One page per URL, the one with the lowest id, should a URL have been fetched twice.

    Only addresses and ids are compared; the pages stay in place unless very
    many addresses were fetched twice.
    """
    twice = (
        pages.groupBy("url")
        .agg(F.min("page_id").alias("_first"), F.count("*").alias("_times"))
        .where(F.col("_times") > 1)
        .drop("_times")
    )
    marked = pages.join(sized(written(twice, "twice")), "url", "left")
    return marked.where(F.coalesce(F.col("page_id") == F.col("_first"), F.lit(True))).select(*pages.columns)
