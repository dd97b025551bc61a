"""From raw documents to token ids: rules, near duplicates, repeated strings, benchmark leaks, encoding.

Every stage works on what the one before kept, written as Parquet and read again.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm import benchmark, pieces, quality, simhash, suffixes
from gleanery.queries.tables import table
from gleanery.session import scratch_path

VOCABULARY = "piece_bpe_32k.model"


def _counted(docs: DataFrame) -> DataFrame:
    """Texts have changed: ``n_chars`` follows them."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without the boilerplate lines of their host."""
    return _counted(quality.keep_good(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates by SimHash: the one with the smallest doc_id."""
    return simhash.one_of_each(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without strings that documents with a smaller doc_id hold too."""
    return _counted(suffixes.cut_text(docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item."""
    return benchmark.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids`` and digests of ids and decoded text."""
    coded = pieces.encode_decode(docs, public_tokenizers.path(VOCABULARY))
    return pieces.digests(coded, "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("benchmark decontamination", decontaminate),
    ("sentencepiece encoding", encode),
]

ORACLE_SQL = None  # suffix arrays, alignments and pieces have no SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
