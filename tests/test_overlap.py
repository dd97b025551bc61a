from gleanery.operators.overlap import column_overlap, mapping_evidence


def pairs(frame):
    return {(r.column_a, r.column_b): r for r in frame.collect()}


def test_exact_below_the_sketch_size(spark):
    rows = [(i, str(i % 50), float(i), None, f"x{i}") for i in range(100)]
    df = spark.createDataFrame(rows, "id long, price string, cost double, `my col.x` string, other string")
    got = pairs(column_overlap(df.repartition(5)))
    assert set(got) == {("id", "price")}
    r = got["id", "price"]
    assert (r.distinct_a, r.distinct_b, r.common, r.containment, r.similarity) == (100, 50, 50, 1.0, 0.5)
    assert pairs(column_overlap(df.limit(0))) == {} and pairs(column_overlap(df, [])) == {}


def test_large_columns_within_the_stated_error(spark):
    df = spark.range(200_000).selectExpr("id as a", "id + 50000 as b", "id + 150000 as c", "id % 3 as d", "id + 10000000 as e")
    got = pairs(column_overlap(df, entries=12))
    exact = {("a", "b"): 150_000, ("a", "c"): 50_000, ("b", "c"): 100_000, ("a", "d"): 3}
    for pair, common in exact.items():  # every true pair of size is found
        if common > 1000:
            assert abs(got[pair].common - common) < 4 * 2**-6 * 350_000
            assert abs(got[pair].distinct_a - 200_000) < 4 * 2**-6 * 200_000
    assert not any("e" in pair for pair in got)
    assert set(pairs(column_overlap(df, entries=12, least=0.6))) >= {("a", "b")}


def test_partners_of_each_column(spark):
    df = spark.createDataFrame([(i, i, i * 2) for i in range(40)], "price long, cost long, twice long")
    got = {r.column: r.partners for r in mapping_evidence(column_overlap(df), 1).collect()}
    assert got == {"price": ["cost"], "cost": ["price"], "twice": ["cost"]}
