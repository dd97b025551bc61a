"""Pages as they arrive: the per-page step of the pages job on a file stream.

Every part of that step works on a single row, so the stream needs no state and
no watermark, and gives the rows the batch job gives.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from gleanery.operators.pages import page_markdown
from gleanery.operators.replies import listing_schema, prompt_table

PAGE_SCHEMA = "page_id bigint, url string, html string"


def arriving_pages(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(PAGE_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def arriving_prompts(pages: DataFrame, fields: Sequence[str] = ()) -> DataFrame:
    return prompt_table(page_markdown(pages), listing_schema(fields), ["page_id", "url", "markdown"])


def append_to(table: DataFrame, folder: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append to a parquet folder; each page is written exactly once per checkpoint."""
    writer = table.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start(folder)
