"""What the operators share: words, document keys, Arrow helpers."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LAST_ID = 2**63 - 1  # where a null doc_id sorts


# Shuffle files go once the table they led to is written; Arrow batches stay small, as whole texts travel.
_SETTINGS = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
}


def small_batches(spark: SparkSession) -> None:
    """Settings of operators that move whole texts, some of them very long."""
    for key, value in _SETTINGS.items():
        if spark.conf.get(key) != value:
            spark.conf.set(key, value)


Batches = Iterator[pa.RecordBatch]


def _trim() -> None:
    """Hand memory that is free back to the machine: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if give_back:
        give_back(0)


def frugal(work: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``work`` of a map task, after which its worker keeps no free memory."""

    @wraps(work)
    def run(batches: Batches) -> Batches:
        try:
            yield from work(batches)
        finally:
            _trim()

    return run


def column_of(table: DataFrame, name: str) -> Column:
    """A column by its exact name, whatever signs are in it."""
    return table["`" + name.replace("`", "``") + "`"]


def row_of(table: DataFrame) -> Column:
    """All columns as a struct ``row``, so that no name clashes with those worked with."""
    return F.struct(*[column_of(table, c) for c in table.columns]).alias("row")


def text_bytes(text: str | Column = "text") -> Column:
    """The text as UTF-8 bytes; null as no bytes. Python then receives bytes without decoding them."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary")


def doc_key(docs: DataFrame) -> list[Column]:
    """``d`` (doc_id, null last), ``tie`` (parts rows that share a doc_id but not the text) and ``body``.

    Whole repeated rows share all three: they are one document.
    """
    return [
        F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST_ID)).alias("d"),
        F.shiftright(F.xxhash64(docs["text"]), 32).cast("int").alias("tie"),
        text_bytes(docs["text"]).alias("body"),
    ]


def words_of(body: bytes) -> list[bytes]:
    """Runs of ``[^\\x20\\x09-\\x0D]``: what bytes.split() parts at is exactly that white space."""
    return body.split()


def pieces_of(batch: pa.RecordBatch, most_bytes: int, column: str = "body") -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most_bytes``; a longer row stands alone."""
    sizes = pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > most_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(size)
    if start < batch.num_rows:
        yield batch.slice(start)


def mixed(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values, so that their order says nothing of their content."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every range, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)
