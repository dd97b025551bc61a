"""Shards cut from a Hilbert curve over several metadata dimensions.

Documents that are close in ingest order, size and source are close on the
curve, so a run of it covers a small box and a filter on any of these columns
skips most files. Columns only: no text is moved and no Python runs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.operators.ordering import number_rows

SHARDS = 24
BITS = 8  # cells along each dimension, as a power of two


def hilbert_index(cells: Sequence[Column], bits: int = BITS) -> Column:
    """Place of a cell on the Hilbert curve through a cube with ``2**bits`` cells along each dimension.

    The cell's coordinates are turned into the curve's digits plane by plane from
    the highest bit: each plane flips or exchanges the lower bits of the first
    coordinate, then the planes are Gray coded and interleaved.
    """
    n = len(cells)
    if n < 2 or n * bits > 62:
        raise ValueError("two dimensions or more, 62 bits at most together")
    one = F.lit(1).cast("long")
    point = F.array(*[c.cast("long") for c in cells])

    def bit(step: Column) -> Column:
        return F.call_function("shiftleft", one, F.lit(bits - 1) - F.floor(step / n).cast("int"))

    def turn(x: Column, step: Column) -> Column:
        q, i = bit(step), (step % n).cast("int")
        low = q - 1
        own = F.get(x, i)
        first = F.get(x, F.lit(0))
        swapped = first.bitwiseXOR(own).bitwiseAND(low)
        head = F.when(own.bitwiseAND(q) != 0, first.bitwiseXOR(low)).otherwise(first.bitwiseXOR(swapped))
        # Where the bit is set only the first coordinate changes.
        return F.transform(
            x,
            lambda v, j: F.when(j == 0, head)
            .when((j == i) & (own.bitwiseAND(q) == 0), v.bitwiseXOR(swapped))
            .otherwise(v),
        )

    turned = F.aggregate(F.sequence(F.lit(0), F.lit((bits - 1) * n - 1)), point, turn) if bits > 1 else point

    def gray(x: Column) -> Column:
        coded = F.aggregate(
            F.sequence(F.lit(1), F.lit(n - 1)),
            x,
            lambda a, i: F.transform(
                a, lambda v, j: F.when(j == i, v.bitwiseXOR(F.get(a, (i - 1).cast("int")))).otherwise(v)
            ),
        )
        return F.transform(F.array(coded), finish)[0]

    def finish(x: Column) -> Column:
        last = F.get(x, F.lit(n - 1))
        planes = F.sequence(F.lit(bits - 1), F.lit(1), F.lit(-1)) if bits > 1 else F.array().cast("array<int>")
        flips = F.aggregate(
            planes,
            F.lit(0).cast("long"),
            lambda t, b: F.when(
                last.bitwiseAND(F.call_function("shiftleft", one, b)) != 0,
                t.bitwiseXOR(F.call_function("shiftleft", one, b) - 1),
            ).otherwise(t),
        )
        flipped = F.transform(F.array(flips), lambda t: F.transform(x, lambda v: v.bitwiseXOR(t)))[0]
        return F.transform(F.array(flipped), interleaved)[0]

    def interleaved(x: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(0), F.lit(n * bits - 1)),
            F.lit(0).cast("long"),
            lambda h, s: (h * 2).bitwiseOR(
                F.call_function(
                    "shiftright", F.get(x, (s % n).cast("int")), F.lit(bits - 1) - F.floor(s / n).cast("int")
                ).bitwiseAND(one)
            ),
        )

    return F.transform(F.array(turned), gray)[0]


def place(docs: DataFrame, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard, curve``: one row per row of ``docs``.

    Dimensions: doc_id between its least and greatest value, size on a log scale,
    and source by a hash. Rows are ordered by curve index, doc_id and a hash of
    the text, and cut into ``shards`` runs whose counts are at most one apart: law
    ``rows``, so ``grown_shard`` is null. ``size`` is the UTF-8 bytes of the text
    (null: none) plus 8; ``slot`` numbers the rows of a shard from 0. A null
    doc_id or source lies in cell 0; repeated rows take neighbouring slots; with
    fewer rows than shards some shards stay empty. Other columns are ignored.
    """
    if shards < 1:
        raise ValueError("one shard at least")
    doc_id = docs["doc_id"].cast("long")
    span = docs.agg(F.min(doc_id).alias("low"), F.max(doc_id).alias("high"), F.count("*").alias("n")).collect()[0]
    cells = 1 << bits
    low, width, total = span["low"] or 0, max(1, (span["high"] or 0) - (span["low"] or 0)), span["n"]
    ingest = F.floor((doc_id.cast("double") - low) / width * (cells - 1))
    size = F.coalesce(F.octet_length(docs["text"]), F.lit(0)).cast("long") + 8
    magnitude = F.least(F.floor(F.log2(size) * (cells / 32.0)), F.lit(cells - 1))
    origin = F.crc32(docs["source"].cast("binary")) % cells
    grid = [F.coalesce(c.cast("long"), F.lit(0)) for c in (ingest, magnitude, origin)]
    narrow = docs.select(
        doc_id.alias("doc_id"),
        size.alias("size"),
        F.crc32(F.coalesce(docs["text"], F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(docs["text"]).alias("tie"),
        *[c.alias(f"cell{i}") for i, c in enumerate(grid)],
    )
    curved = narrow.withColumn("curve", hilbert_index([F.col(f"cell{i}") for i in range(len(grid))], bits))
    ranked = number_rows(curved.drop(*[f"cell{i}" for i in range(len(grid))]), ["curve", "doc_id", "tie"], "n")
    rank = F.col("n") - 1
    shard = F.expr(f"(n - 1) * {shards} div {max(total, 1)}")
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")  # the rank a shard begins at
    return (
        ranked.withColumn("shard", shard.cast("int"))
        .withColumn("slot", rank - first)
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("rows").alias("law"),
            "shard",
            F.col("slot").cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            "curve",
        )
    )
