"""Listing documents to one cleaned, unified table."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from gleanery.operators.columns import Mapping, clean_columns, column_sample, unify_columns
from gleanery.operators.listings import (
    FlatColumn,
    classify_documents,
    discover_columns,
    flatten_listings,
    normalize_records,
    rejected_documents,
)
from gleanery.operators.replies import mapping_entries, mapping_list, mapping_prompt
from gleanery.session import written
from gleanery.sources.listing_files import scan_listing_files
from gleanery.sources.sinks import write_if_rows, write_run


def cleaned_table(classified: DataFrame, key: str = "file", columns: Sequence[FlatColumn] | None = None) -> DataFrame:
    """Classified documents to cleaned columns: ``key, pos`` and one column per leaf path."""
    records = flatten_listings(classified, key)
    return clean_columns(normalize_records(records, columns=list(columns) if columns is not None else None))


def combined_table(
    documents: DataFrame, mapping: Mapping = (), key: str = "file", columns: Sequence[FlatColumn] | None = None
) -> DataFrame:
    """Documents ``(key, text)`` to the combined table: ``key, pos`` and one column per leaf path.

    Cleaning comes before unification: a column that only becomes ``price``
    through the mapping is not cleaned.
    """
    return unify_columns(cleaned_table(classify_documents(documents), key, columns), mapping)


def _parsed(spark: SparkSession, folder: str, wholetext: bool) -> tuple[DataFrame, list[FlatColumn]]:
    """The documents of a folder, parsed, classified and written without their text, and the columns of their records.

    These are looked for in the written table, so that the records need no table of their own.
    """
    found = classify_documents(scan_listing_files(spark, folder, wholetext=wholetext)).drop("text")
    classified = written(found, "classified")
    return classified, discover_columns(flatten_listings(classified))


class Cleaned(NamedTuple):
    path: str | None  # of the cleaned table; None when there are no rows
    rejects: DataFrame
    request: DataFrame  # the prompt for a column mapping, one row; none without rows


def clean_job(spark: SparkSession, folder: str, output: str, wholetext: bool = True) -> Cleaned:
    """Scan a run folder, write the cleaned table below ``output`` and ask for a column mapping.

    Documents are parsed once: records and rejects come from one written table.
    """
    classified, columns = _parsed(spark, folder, wholetext)
    rejects = rejected_documents(classified)
    path = write_if_rows(cleaned_table(classified, columns=columns), output, "parquet")
    if path is None:
        return Cleaned(None, rejects, spark.createDataFrame([], "system_prompt string, user_prompt string"))
    table = spark.read.parquet(path)
    return Cleaned(path, rejects, mapping_prompt(column_sample(table, table.columns[:2])))


def unify_job(spark: SparkSession, cleaned: str, replies: DataFrame, output: str, key: str = "id") -> str:
    """Unify the columns of a cleaned table by a mapping reply and write the result.

    Without a usable mapping nothing is unified: the path of the cleaned table
    is returned as it is. Of several replies that with the lowest ``key`` counts.
    Replies are worked out once: what they answer may have gone through the whole table.
    """
    entries = written(mapping_entries(replies, key), "mapping")
    first = entries.agg({key: "min"}).first()[0]
    mapping = mapping_list(entries.where(entries[key] == first)) if first is not None else []
    if not mapping:
        return cleaned
    return write_run(unify_columns(spark.read.parquet(cleaned), mapping), output, "parquet")


def merge_job(
    spark: SparkSession, folder: str, output: str, mapping: Mapping = (), wholetext: bool = True
) -> tuple[str | None, DataFrame]:
    """Scan a run folder, write the combined table below ``output`` if it has rows.

    Returns the path written (None when nothing was) and the table of rejected
    documents.
    """
    classified, columns = _parsed(spark, folder, wholetext)
    table = unify_columns(cleaned_table(classified, columns=columns), mapping)
    return write_if_rows(table, output, "parquet"), rejected_documents(classified)
