"""URL filters: rules by host and path, and trust that spreads over links between hosts.

Hosts that rules allow are seeds of trust, hosts that rules block are seeds of
distrust, each by the share of its pages the rules decide. Trust follows links
(personalised PageRank); distrust follows them backwards, as who links to
blocked hosts is suspect: by the share of a host's own links to other hosts, the
less the more it is trusted. A page no rule fits gets the verdict of its host.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.operators.links import every_link
from gleanery.session import written

DAMPING = 0.85
ROUNDS = 30
SETTLED = 1e-6  # largest change of a score at which the rounds end
LIMIT = 0.5  # distrust from which a host is blocked, a blocked seed without links having 1


class Rule(NamedTuple):
    verdict: str  # allow or block
    host: str
    path: str  # starts with a slash

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"


# The rules in force.
RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    host = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_column(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Name and verdict of the longest rule that fits, as a struct; null if none does."""
    chosen = F.lit(None).cast("struct<name:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: len(r.name)):  # the longest is asked first
        under = (host == rule.host) | host.endswith("." + rule.host)
        chosen = F.when(
            under & path.startswith(rule.path),
            F.struct(F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict")),
        ).otherwise(chosen)
    return chosen


def host_edges(pages: DataFrame) -> DataFrame:
    """``src, dst, links``: how many links of one host's pages, anywhere on them, lead to another host."""
    links = every_link(pages.select("page_id", "url", "html"))
    hosts = links.select(url_host(F.col("src_url")).alias("src"), url_host(F.col("dst_url")).alias("dst"))
    return hosts.where("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("links"))


def spread(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """``host, score`` for hosts that seeds (``host, weight``) reach over edges (``src, dst, share``).

    Every round is a table in the shared folder. A score is (1 - damping) times the
    weight plus what flows in; divided by (1 - damping) at the end, so that a seed
    without links keeps its weight.
    """
    scores = written(seeds.select("host", F.col("weight").alias("score")).where("score > 0"), "scores")
    for _ in range(rounds):
        # Sums are made before the shuffle: a host linked from everywhere is one row per task.
        flow = scores.join(edges, scores["host"] == edges["src"]).select(
            F.col("dst").alias("host"), (F.col("score") * F.col("share") * damping).alias("score")
        )
        fresh = seeds.select("host", F.col("weight").alias("score")).union(flow)
        following = written(fresh.groupBy("host").agg(F.sum("score").alias("score")).where("score > 0"), "scores")
        change = (
            following.join(scores.withColumnRenamed("score", "old"), "host", "left")
            .agg(F.max(F.abs(F.col("score") - F.coalesce("old", F.lit(0.0)))))
            .collect()[0][0]
        )  # one number
        scores = following
        if change is None or change <= SETTLED:
            break
    return scores


def host_scores(judged: DataFrame, pages: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """``host, trust, distrust`` for hosts that any seed reaches. ``judged`` has host and the rules' verdict.

    Distrust is the blocked share of the host's pages, and for the rest of it
    ``damping`` times the distrust its links lead to, divided by 1 + trust.
    """
    shares = written(
        judged.groupBy("host").agg(
            F.avg(F.when(F.col("by_rule") == "allow", 1.0).otherwise(0.0)).alias("allowed"),
            F.avg(F.when(F.col("by_rule") == "block", 1.0).otherwise(0.0)).alias("blocked"),
        ),
        "hosts",
    )
    edges = written(host_edges(pages), "edges")
    out = edges.groupBy("src").agg(F.sum("links").alias("all"))
    forward = edges.join(out, "src").select("src", "dst", (F.col("links") / F.col("all")).alias("share"))
    forward = written(forward, "forward")
    trust = written(spread(shares.select("host", F.col("allowed").alias("weight")), forward, damping, rounds), "trust")
    # Distrust is a share of the linking host's own links, so others that link alike do not lessen it.
    # What a host lacks of being blocked itself is left for it, which keeps it at 1 at most.
    scored = shares.select("host", "blocked").join(trust.withColumnRenamed("score", "trust"), "host", "full")
    left = (1 - F.coalesce("blocked", F.lit(0.0))) / (1 + F.coalesce("trust", F.lit(0.0)))
    taken = scored.select(F.col("host").alias("src"), left.alias("taken"))
    backward = forward.join(taken, "src", "left").select(
        F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("share") * F.coalesce("taken", F.lit(1.0))).alias("share")
    )
    distrust = spread(
        shares.select("host", F.col("blocked").alias("weight")), written(backward, "backward"), damping, rounds
    )
    return trust.select("host", F.col("score").alias("trust")).join(
        distrust.select("host", F.col("score").alias("distrust")), "host", "full"
    )


def judge_urls(
    pages: DataFrame,
    rules: Sequence[Rule] = RULES,
    limit: float = LIMIT,
    damping: float = DAMPING,
    rounds: int = ROUNDS,
) -> DataFrame:
    """``page_id, host, path, rule, verdict, trust, distrust``: one row per row of ``pages``.

    The longest rule that fits decides. Without one, a page is blocked if the
    distrust of its host is at least ``limit`` and above its trust, else allowed.
    A null url, or one without ``://``, has empty host and path, no rule and is
    allowed; a null html has no links; a null page_id stays null; repeated rows
    give repeated rows and count as often; other columns are ignored.
    """
    host, path = url_host(pages["url"]), url_path(pages["url"])
    parts = pages.select(pages["page_id"].cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    ruled = parts.withColumn("chosen", rule_column(F.col("host"), F.col("path"), rules)).select(
        "page_id", "host", "path", F.col("chosen.name").alias("rule"), F.col("chosen.verdict").alias("by_rule")
    )
    scores = written(host_scores(ruled.where("host <> ''"), pages, damping, rounds), "host-scores")
    # One host may hold a third of all pages: its one row of scores is repeated for each salt.
    salted = scores.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    joined = ruled.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(16)).cast("int")).join(
        salted, ["host", "salt"], "left"
    )
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    by_graph = F.when((distrust >= limit) & (distrust > trust), "block").otherwise("allow")
    return joined.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("by_rule", by_graph).alias("verdict"),
        trust.alias("trust"),
        distrust.alias("distrust"),
    )
