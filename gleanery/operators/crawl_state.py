"""A crawl that is kept up to date: new seeds and links change the depths they reach, and nothing else is worked out again.

The state is two tables in one folder, both partitioned by a hash of an address:
links by where they start, depths by what was reached. A round reads the partitions
that its own addresses fall into, so what it reads shrinks with its frontier. Depths
only ever fall; a better one is appended, and the least one of an address counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.session import scratch_path, sized, written

BUCKETS = 64
_LINKS = "bucket int, src_url string, dst_url string"
_DEPTHS = "bucket int, root string, url string, depth int"


def bucket_of(url: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(buckets)).cast("int")


class CrawlState:
    """The links known so far and how deep each address lies below each seed."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        self.work: str | None = None

    def _read(self, path: str, schema: str) -> DataFrame:
        # Nothing written yet: an empty table, as its folder cannot be read.
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def _table(self, name: str, schema: str) -> DataFrame:
        """What the state holds, and what the batch under way has added."""
        held = self._read(f"{self.folder}/{name}", schema)
        return held.unionByName(self._read(f"{self.work}/{name}", schema)) if self.work else held

    def _append(self, rows: DataFrame, folder: str) -> None:
        rows.hint("rebalance", F.col("bucket")).write.mode("append").partitionBy("bucket").parquet(folder)

    def _near(self, name: str, schema: str, rows: DataFrame, url: str) -> DataFrame:
        """Partitions of a table that the addresses of ``rows`` fall into."""
        met = rows.select(bucket_of(F.col(url), self.buckets).alias("bucket")).distinct().collect()  # at most ``buckets``
        return self._table(name, schema).where(F.col("bucket").isin([r["bucket"] for r in met]))

    def _better(self, found: DataFrame) -> DataFrame:
        """Least depths of ``found`` (``root, url, depth``) that are new or below those known."""
        found = found.groupBy("root", "url").agg(F.min("depth").alias("depth"))
        found = written(found, "found")
        near = self._near("depths", _DEPTHS, found, "url")
        known = near.groupBy("root", "url").agg(F.min("depth").alias("known"))
        joined = found.join(known, ["root", "url"], "left")
        return joined.where(F.col("known").isNull() | (F.col("depth") < F.col("known"))).drop("known")

    def _below(self, reached: DataFrame, links: DataFrame) -> DataFrame:
        ahead = reached.select("root", F.col("url").alias("src_url"), (F.col("depth") + 1).alias("depth"))
        return links.join(sized(ahead), "src_url").select("root", F.col("dst_url").alias("url"), "depth")

    def add(self, seeds: DataFrame, links: DataFrame) -> int:
        """Take in new seeds (``url``) and links (``src_url, dst_url``); the number of rounds it took.

        What is known already may come again. A round follows the links of addresses
        whose depth has changed in the round before.
        """
        new = links.where(F.col("src_url").isNotNull() & F.col("dst_url").isNotNull())
        new = new.select(bucket_of(F.col("src_url"), self.buckets).alias("bucket"), "src_url", "dst_url").distinct()
        new = written(new, "links")
        starts = seeds.where(F.col("url").isNotNull()).select(F.col("url").alias("root"), "url", F.lit(0).alias("depth"))
        # The batch grows beside the state, which takes it in at the end: one that failed is simply added again.
        self.work = scratch_path(self.spark, "crawl")
        try:
            # Known addresses that got links: their depths stay, what lies behind the new links may change.
            grown = self._near("depths", _DEPTHS, new, "src_url").groupBy("root", "url").agg(F.min("depth").alias("depth"))
            self._append(new, f"{self.work}/links")
            changed = written(self._better(starts.union(self._below(grown, new.select("src_url", "dst_url")))), "changed")
            rounds = 0
            while not changed.isEmpty():
                rounds += 1
                bucket = bucket_of(F.col("url"), self.buckets).alias("bucket")
                self._append(changed.select(bucket, "root", "url", "depth"), f"{self.work}/depths")
                near = self._near("links", _LINKS, changed, "url").select("src_url", "dst_url")
                changed = written(self._better(self._below(changed, near)), "changed")
            done = self._read(f"{self.work}/depths", _DEPTHS)
            # Depths first: without the links they stand for, the batch adds nothing when it comes again.
            self._append(done, f"{self.folder}/depths")
            self._append(new, f"{self.folder}/links")
        finally:
            self.work = None
        return rounds

    def depths(self) -> DataFrame:
        """``root, url, depth`` of all addresses reached."""
        return self._table("depths", _DEPTHS).groupBy("root", "url").agg(F.min("depth").alias("depth"))
