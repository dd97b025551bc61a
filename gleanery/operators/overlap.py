"""Which columns hold the same values: evidence for a mapping, from one sketch per column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.operators.columns import named
from gleanery.session import written

ENTRIES = 14  # binary logarithm of the values a sketch keeps: exact up to 16384, an error of 0.8 % beyond


def column_sketches(table: DataFrame, columns: Sequence[str] | None = None, entries: int = ENTRIES) -> DataFrame:
    """``column, sketch``: a mergeable sketch of each column's different values, read as text, in one aggregation."""
    names = list(columns if columns is not None else table.columns)
    if not names:
        return table.sparkSession.createDataFrame([], "column string, sketch binary")
    found = table.agg(*[F.theta_sketch_agg(named(c).cast("string"), entries).alias(f"s{i}") for i, c in enumerate(names)])
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"s{i}").alias("sketch")) for i, c in enumerate(names)])
    return found.select(F.explode(each).alias("each")).select("each.*")


def column_overlap(
    table: DataFrame, columns: Sequence[str] | None = None, entries: int = ENTRIES, least: float = 0.0
) -> DataFrame:
    """``column_a, column_b, distinct_a, distinct_b, common, containment, similarity``: pairs that share values.

    ``common`` estimates how many different values both hold, ``containment`` is its
    share of the smaller column, ``similarity`` of their union; pairs of a containment
    of ``least`` or more, if they share any. Values are compared as text; nulls count
    nowhere. Sketches of up to ``2 ** entries`` values are exact; of larger ones the
    relative error is about ``2 ** (-entries / 2)`` of the union, whatever the table's size.
    """
    sketches = written(column_sketches(table, columns, entries), "sketches")
    # Every column names its later partners, one row each: as many as the schema has pairs.
    names = F.array(*[F.lit(c) for c in (columns if columns is not None else table.columns)])
    left = sketches.select(
        F.col("column").alias("column_a"),
        F.col("sketch").alias("a"),
        F.explode(F.filter(names, lambda x: x > F.col("column"))).alias("column_b"),
    )
    right = sketches.select(F.col("column").alias("column_b"), F.col("sketch").alias("b"))
    distinct_a, distinct_b = F.theta_sketch_estimate("a"), F.theta_sketch_estimate("b")
    counted = left.join(right, "column_b").select(
        "column_a",
        "column_b",
        distinct_a.alias("distinct_a"),
        distinct_b.alias("distinct_b"),
        F.theta_sketch_estimate(F.theta_intersection("a", "b")).alias("common"),
    )
    shared = counted.where("common > 0")
    smaller = F.least("distinct_a", "distinct_b")
    return shared.select(
        "*",
        F.least(F.col("common") / smaller, F.lit(1.0)).alias("containment"),
        (F.col("common") / (F.col("distinct_a") + F.col("distinct_b") - F.col("common"))).alias("similarity"),
    ).where(F.col("containment") >= least)


def mapping_evidence(overlap: DataFrame, most: int = 3) -> DataFrame:
    """``column, partners``: for each column the ``most`` others it shares the greatest part of its values with."""
    both = overlap.select("column_a", "column_b", "similarity").union(overlap.select("column_b", "column_a", "similarity"))
    near = F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("far"), F.col("column_b").alias("name"))))
    # One entry for each other column of the table.
    return both.groupBy(F.col("column_a").alias("column")).agg(F.transform(F.slice(near, 1, most), lambda x: x["name"]).alias("partners"))
