import json

from gleanery.operators.paths import frequent_columns, normalize_many, path_catalog
from pyspark.sql import functions as F


def records(spark, *objects):
    df = spark.createDataFrame([(i, json.dumps(o)) for i, o in enumerate(objects)], "i int, t string")
    return df.select("i", F.parse_json("t").alias("record"))


SAMPLE = (
    {"a": 1, "b": {"c": "x", "d": {"e": 1.5}}, "l": [1, 2]},
    {"a": 2, "b": {"c": "y"}, "n": None, "o": {}},
    {"a": 3, "b": "text", "x.y": 1, "x": {"y": 2}},
    {"a": 4, "b": {"c": True}, "dots": {"k.1": 5}},
    {},
)


def test_catalogue_counts_every_path(spark):
    got = {(tuple(r.path), r.kind): r.records for r in path_catalog(records(spark, *SAMPLE)).collect()}
    assert got == {
        (("a",), "BIGINT"): 4, (("b",), "OBJECT"): 3, (("b",), "STRING"): 1, (("b", "c"), "STRING"): 2,
        (("b", "c"), "BOOLEAN"): 1, (("b", "d"), "OBJECT"): 1, (("b", "d", "e"), "DECIMAL"): 1, (("l",), "ARRAY"): 1,
        (("n",), "VOID"): 1, (("o",), "OBJECT"): 1, (("x.y",), "BIGINT"): 1, (("x",), "OBJECT"): 1, (("x", "y"), "BIGINT"): 1,
        (("dots",), "OBJECT"): 1, (("dots", "k.1"), "BIGINT"): 1,
    }


def test_frequent_paths_are_columns_and_the_rest_is_one_variant(spark):
    got = normalize_many(records(spark, *SAMPLE), most=3).orderBy("i")
    assert got.columns == ["i", "rest", "a", "b", "b.c"]
    rows = [(r["a"], r["b"], r["b.c"], json.loads(r["rest"].toJson()) if r["rest"] else None) for r in got.collect()]
    assert rows == [
        (1, None, "x", {"b.d.e": 1.5, "l": [1, 2]}),
        (2, None, "y", None),
        (3, "text", None, {'["x.y"]': 1, "x.y": 2}),
        (4, None, "true", {'["dots","k.1"]': 5}),
        (None, None, None, None),
    ]


def test_carried_columns_and_no_records(spark):
    df = records(spark, {"rest": 1, "i": 2}).withColumn("rest", F.lit("mine"))
    got = normalize_many(df.select("i", "rest", "record"), most=5)
    assert got.count() == 1 and {"rest", "i"} <= set(got.columns) and len(got.columns) == 5
    none = normalize_many(records(spark, {"a": 1}).limit(0))
    assert none.columns == ["i", "rest"] and none.collect() == []


def test_the_driver_gets_the_chosen_columns_only(spark):
    many = spark.range(20_000).select(
        F.col("id").alias("i"), F.parse_json(F.concat(F.lit('{"a": 1, "k'), F.col("id").cast("string"), F.lit('": 2}'))).alias("record")
    )
    catalog = path_catalog(many)
    assert catalog.count() == 20_001
    assert [c.path for c in frequent_columns(catalog, 1)] == [("a",)]
    wide = normalize_many(many, most=1)
    assert wide.columns == ["i", "rest", "a"]
    assert wide.where(F.to_json("rest") == F.concat(F.lit('{"k'), F.col("i").cast("string"), F.lit('":2}'))).count() == 20_000
