"""Following links: breadth-first rounds as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery import session
from gleanery.operators.ordering import number_rows
from gleanery.session import scratch_path, sized, written


def crawl_frontier(
    seeds: DataFrame, links: DataFrame, max_depth: int | None = None, ordered: bool = False
) -> DataFrame:
    """Every URL reached from each seed: ``seed_pos, url, depth``.

    ``seeds(seed_pos, url)``, ``links(src_url, pos, dst_url)``. Each seed has
    its own visited set; equal seeds reach the same URLs, so each start URL is
    followed once and the result is handed to all its seeds at the end. With
    ``ordered`` a column ``rank`` gives the visiting order inside one seed and
    depth (parent's order, then place on the parent page).

    Each round is written below one folder of the shared storage, which as a
    whole is the visited table, so the plan of a round does not grow with the
    number of rounds. Whatever is small, by its count, is broadcast: a frontier
    to the links, few candidates to a long visited table. Neither of the large
    tables is shuffled then, however many rounds there are; a large round
    shuffles both sides.
    """
    spark = seeds.sparkSession
    # Read every round: written once, so that no round repeats the work of finding the links.
    links = written(links.select("src_url", "pos", "dst_url").where(F.col("dst_url").isNotNull()), "links")
    folder = scratch_path(spark, "crawl")
    schema = "root bigint, url string, depth int, rank bigint"

    def keep(round_rows: DataFrame, depth: int, rank) -> DataFrame:
        shaped = round_rows.select(
            F.col("root").cast("bigint"), "url", F.lit(depth).alias("depth"), rank.cast("bigint").alias("rank")
        )
        return written(shaped, "round", f"{folder}/round_{depth:06d}")

    starts = seeds.groupBy("url").agg(F.min("seed_pos").alias("root"))
    frontier = keep(starts, 0, F.lit(0))
    depth = 0
    reached = total = frontier.count()
    while reached and (max_depth is None or depth < max_depth):
        depth += 1
        visited = spark.read.schema(schema).parquet(f"{folder}/round_*").select("root", "url")
        ahead = sized(frontier.select("root", F.col("url").alias("src_url"), "rank"), reached)
        via = F.min(F.struct("rank", "pos")).alias("via") if ordered else F.first(F.lit(0)).alias("via")
        found = links.join(ahead, "src_url").groupBy("root", F.col("dst_url").alias("url")).agg(via)
        new = _unvisited(found, visited, total, small_round=reached <= session.SMALL_ROWS)
        rank = F.lit(0)
        if ordered:
            new = new.repartitionByRange("root", "via").sortWithinPartitions("root", "via")
            rank = F.monotonically_increasing_id()
        frontier = keep(new, depth, rank)
        reached = frontier.count()
        total += reached
    visited = spark.read.schema(schema).parquet(f"{folder}/round_*")
    mates = seeds.select(F.col("url").alias("start"), "seed_pos")
    owners = frontier.sparkSession.read.schema(schema).parquet(f"{folder}/round_{0:06d}")
    owners = owners.select("root", F.col("url").alias("start")).join(mates, "start").select("root", "seed_pos")
    columns = ["seed_pos", "url", "depth"] + (["rank"] if ordered else [])
    return visited.join(sized(owners), "root").select(*columns)


def _unvisited(found: DataFrame, visited: DataFrame, total: int, small_round: bool) -> DataFrame:
    """Candidates not visited before.

    A small visited table is broadcast. To a large one, after a small frontier,
    the candidates are written and counted; if they are few, the table is only
    scanned for them.
    """
    key = ["root", "url"]
    if total <= session.SMALL_ROWS or not small_round:
        return found.join(sized(visited, total), key, "left_anti")
    found = written(found, "found")
    if found.count() > session.SMALL_ROWS:
        return found.join(visited, key, "left_anti")
    known = visited.join(F.broadcast(found.select(*key)), key, "left_semi")
    return found.join(F.broadcast(known), key, "left_anti")  # no more rows than the candidates


def visit_numbers(visits: DataFrame) -> DataFrame:
    """File number of each visited page, in visiting order over all seeds; failed pages count too."""
    return number_rows(visits, ["seed_pos", "depth", "rank"], "file_no").drop("rank")


def first_page(pages: DataFrame, order: list[str]) -> DataFrame:
    """The page that comes first in ``order``, whole.

    The key is found on the order columns alone. Its values then filter the
    wide rows inside the scan, where file statistics rule most of them out.
    """
    key = pages.select(F.min(F.struct(*order)).alias("key"))
    for name in order:
        pages = pages.where(F.col(name).eqNullSafe(key.select(F.col("key")[name]).scalar()))
    return pages
