import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gleanery.llm.shards import hilbert_index, place

SCHEMA = "doc_id long, text string, source string, shard string, curve string"


@pytest.mark.parametrize(("dims", "bits"), [(2, 1), (2, 4), (3, 2), (3, 3), (4, 2)])
def test_the_curve_visits_every_cell_by_single_steps(spark, dims, bits):
    side = 2**bits
    cells = [F.expr(f"cast(floor(id / {side**i}) % {side} as bigint)").alias(f"c{i}") for i in range(dims)]
    grid = spark.range(side**dims).select(*cells)
    curve = hilbert_index([F.col(f"c{i}") for i in range(dims)], bits)
    order = sorted((r["h"], tuple(r)[:dims]) for r in grid.withColumn("h", curve).collect())
    assert [h for h, _ in order] == list(range(side**dims))
    for (_, a), (_, b) in zip(order, order[1:], strict=False):
        assert sum(abs(x - y) for x, y in zip(a, b, strict=True)) == 1


def test_bad_parameters(spark):
    with pytest.raises(ValueError):
        hilbert_index([F.lit(1)])
    with pytest.raises(ValueError):
        place(spark.createDataFrame([], SCHEMA), 0)


def check(rows, got, shards=24):
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    by = Counter(r["shard"] for r in got)
    assert set(by) <= set(range(shards))
    counts = [by[s] for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    for s in range(shards):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(by[s]))
    assert {(r["law"], r["grown_shard"]) for r in got} == {("rows", None)}
    ordered = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    assert [r["curve"] for r in ordered] == sorted(r["curve"] for r in got)


@pytest.mark.parametrize("n", [1, 5, 24, 25, 500])
def test_counts_slots_and_order(spark, many_chunks, n):
    odd = [None, "", "x" * 100_000, "é" * 7]
    rows = [(None if i % 11 == 5 else i // 2, odd[i % 4] if i % 3 else f"text {i}") for i in range(n)]
    rows = rows + rows[: n // 5]
    frame = spark.createDataFrame([(i, t, [None, "a", "b"][i % 3 if i else 0], "x", "y") for i, t in rows], SCHEMA)
    check(rows, place(frame).collect())


def test_no_rows(spark):
    assert place(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_over_all_documents(spark):
    from gleanery.llm.queries import op5_hilbert_shards

    folder = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    check(rows, op5_hilbert_shards(spark, folder).collect())
