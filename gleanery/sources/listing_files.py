"""Listing documents as files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions import fixed


def scan_listing_files(
    spark: SparkSession,
    folder: str,
    prefix: str = fixed.LISTING_PREFIX,
    suffix: str = fixed.LISTING_SUFFIX,
    wholetext: bool = True,
) -> DataFrame:
    """Documents of a folder: ``file, text``. Only direct children ``prefix*suffix`` are read.

    ``wholetext`` reads one document per file, so a file must fit in a task;
    without it each line is a document, which splits and suits many small ones.
    Spark plans no task for a file of zero bytes, so such a file is not listed.
    """
    try:
        files = spark.read.text(f"{folder.rstrip('/')}/{prefix}*{suffix}", wholetext=wholetext)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "file string, text string")
    return files.select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))
