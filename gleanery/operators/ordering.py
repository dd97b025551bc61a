"""Global order without a global task: range-sorted chunks, numbers, running sums."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.session import written

_ROW_BITS = 33  # monotonically_increasing_id: partition above, row in partition below


def ordered_chunks(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Sort all rows by ``order`` and add ``chunk`` and ``chunk_pos``.

    Chunks are range partitions: a later chunk holds only later rows, and since
    the whole order key decides, equal leading values spread over chunks. The
    rows are written once, as sampling could draw the boundaries differently on
    a second evaluation. Pass narrow rows.
    """
    if "_rid" in rows.columns:
        raise ValueError("_rid is taken")
    placed = (
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_rid", F.monotonically_increasing_id())
        .withColumn("chunk", F.shiftright("_rid", _ROW_BITS).cast("int"))
        .withColumn("chunk_pos", F.col("_rid").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)))
        .drop("_rid")
    )
    return written(placed, "chunks")


def number_rows(rows: DataFrame, order: Sequence[str], name: str = "n") -> DataFrame:
    """Consecutive numbers from 1 in ``order``. The only table joined back has one row per chunk."""
    placed = ordered_chunks(rows, order)
    before = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("chunk")
        .agg(F.count("*").alias("rows"))
        .select("chunk", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    )
    return (
        placed.join(F.broadcast(starts), "chunk")  # one row per partition
        .withColumn(name, F.col("start") + F.col("chunk_pos") + 1)
        .drop("chunk", "chunk_pos", "start")
    )


def running_sums(
    rows: DataFrame, order: Sequence[str], sums: Mapping[Sequence[str], Mapping[str, Column]]
) -> DataFrame:
    """Running sums that restart per key: ``{key columns: {name: value}}``.

    The keys must follow the order (as minute and day follow a time order), so
    that each key is one run of rows. A run may hold any share of the rows: it
    is cut over chunks, summed inside each chunk, and what its earlier chunks
    hold is added. Only the first run of a chunk can have earlier chunks, so
    the table joined back has at most one row per chunk.
    """
    values = {name: value for named in sums.values() for name, value in named.items()}
    placed = ordered_chunks(rows.select("*", *[v.alias(f"_v_{n}") for n, v in values.items()]), order)

    result = placed.repartition("chunk")
    for keys, named in sums.items():
        inside = Window.partitionBy("chunk", *keys).orderBy("chunk_pos").rowsBetween(Window.unboundedPreceding, 0)
        result = result.withColumns({n: F.sum(f"_v_{n}").over(inside) for n in named})
    for keys, named in sums.items():
        earlier = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        carried = (
            placed.groupBy("chunk", *keys)
            .agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in named])
            .select(
                "chunk",
                *keys,
                F.count("*").over(earlier).alias("_before"),
                *[F.sum(f"_t_{n}").over(earlier).alias(f"_c_{n}") for n in named],
            )
            .where(F.col("_before") > 0)
        )
        result = (
            result.join(F.broadcast(carried), ["chunk", *keys], "left")  # one row per chunk
            .withColumns({n: F.col(n) + F.coalesce(F.col(f"_c_{n}"), F.lit(0)) for n in named})
            .drop("_before", *[f"_c_{n}" for n in named])
        )
    return result.drop("chunk", "chunk_pos", *[f"_v_{n}" for n in values])
