"""Session and shared-folder helpers."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "gleanery", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs expect; anything in ``conf`` wins."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Keys of different listings may differ in case only; of a repeated key the last value counts.
        "spark.sql.caseSensitive": "true",
        "spark.sql.variant.allowDuplicateKeys": "true",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, taken from ``spark.checkpoint.dir``.

    Only a local session may fall back on a temporary folder: on a cluster a
    machine-local folder would be lost with its executor.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        current = sc.getCheckpointDir()
        if current:
            # Spark keeps each session's checkpoints in a child of the folder it was given.
            configured = current.rsplit("/", 1)[0]
        elif sc.master == "local" or sc.master.startswith("local["):
            configured = tempfile.mkdtemp(prefix="gleanery-")
        else:
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, for a table written once and read back."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


@contextmanager
def _held(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def exact_names(spark: SparkSession):
    """Run actions with names compared letter by letter, whatever the session's setting."""
    return _held(spark, "spark.sql.caseSensitive", "true")


def written(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """The rows as a table in the shared folder: a plan that starts at its files.

    It outlives any executor, is never worked out twice, is read by column, and
    its size on disk is known to the planner. A VARIANT is written as one value:
    finding columns to take out of it costs more than the few reads here gain.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, label)
    with _held(spark, "spark.sql.variant.inferShreddingSchema", "false"):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


SMALL_ROWS = 100_000  # narrow rows (keys, URLs) that may be broadcast


def sized(rows: DataFrame, count: int | None = None) -> DataFrame:
    """Narrow rows for a join: broadcast if they were counted and found few, as they are otherwise."""
    count = rows.count() if count is None else count
    return F.broadcast(rows) if count <= SMALL_ROWS else rows
