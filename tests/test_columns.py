from pyspark.sql import functions as F

from conftest import rows
from gleanery.operators.columns import clean_columns, column_sample, has_rows, preview, price_rejects, unify_columns


def test_unify_keeps_rows_aligned(spark):
    df = spark.createDataFrame([(0, None, 9), (1, 1, None), (2, 2, 7)], "k int, p int, c int")
    got = unify_columns(df, [("new", ["p", "c", "absent"])]).orderBy("k")
    assert got.columns == ["k", "new"] and [r.new for r in got.collect()] == [9, 1, 2]


def test_unify_new_name_that_is_an_old_name(spark):
    df = spark.createDataFrame([(None, "b", "t"), ("a", "x", None)], "price string, cost string, title string")
    got = unify_columns(df, [("price", ["price", "cost"]), ("name", ["title"]), ("none", ["absent"])])
    assert sorted(got.columns) == ["name", "price"]
    assert sorted(rows(got.select("price", "name")), key=str) == [("a", None), ("b", "t")]


def test_unify_mixed_types_and_later_entries(spark):
    df = spark.createDataFrame([(None, 2, [1]), ("a", 3, None)], "`d.s` string, n int, l array<int>")
    got = unify_columns(df, [("x", ["d.s", "n"]), ("y", ["x", "l"])])
    assert got.columns == ["y"] and sorted(rows(got)) == [("2",), ("a",)]
    assert got.count() == df.count()


PRICES = {
    "$12": "€12.00",
    "£3": "€3.00",
    "€4.5": "€4.50",
    " 7 ": "€7.00",
    "1,234.50": None,
    "free": None,
    "": None,
    "1d": None,
    "nan": None,
    "-0.001": "€-0.00",
    "1e3": "€1000.00",
    "12345678901234567": "€12345678901234568.00",
}


def test_clean_price_text(spark):
    df = spark.createDataFrame([(p,) for p in [*PRICES, None]], "price string")
    got = clean_columns(df.withColumn("p", F.col("price")))
    assert {r.p: r.price for r in got.collect()} == {**PRICES, None: None}
    assert rows(price_rejects(df)) == [(len(PRICES), 5)]


def test_clean_price_rounds_like_two_decimal_formatting(spark):
    values = [0.125, 2.675, 1.005, 0.005, 1e16, -0.001, 123456.785, 0.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, price double")
    assert [r.price for r in clean_columns(df).orderBy("i").collect()] == [f"€{v:.2f}" for v in values]


def test_clean_only_touches_known_columns(spark):
    df = spark.createDataFrame([(" http://a ", "http://b", "$1")], "image_url string, other string, cost string")
    assert rows(clean_columns(df)) == [("https://a", "http://b", "$1")]
    assert rows(clean_columns(df, price="cost", urls=["other"])) == [(" http://a ", "https://b", "€1.00")]
    assert clean_columns(df.select("other")).columns == ["other"]


def test_samples_and_preview(spark):
    df = spark.createDataFrame([(i, None if i == 1 else f"v{i}") for i in range(9, -1, -1)], "i int, `a.b` string")
    assert rows(column_sample(df, ["i"], 3)) == [("i", "[0,1,2]"), ("a.b", '["v0",null,"v2"]')]
    assert [r.i for r in preview(df, ["i"], 4).collect()] == [0, 1, 2, 3]
    assert rows(has_rows(df, "t")) == [("t", True)] and rows(has_rows(df.where("i < 0"), "t")) == [("t", False)]
