import json
import random

import pytest
from pyspark.sql import functions as F

from gleanery.functions.jsontext import parse_json_text, with_json
from gleanery.operators.listings import (
    classify_documents,
    discover_columns,
    flatten_listings,
    good_documents,
    normalize_records,
    rejected_documents,
    unwrap_records,
)

FILES = {
    "sorted_data_1.json": ('{"listings":[{"a":1,"b":"x"},{"c":true}]}', "ok"),
    "sorted_data_2.json": ('[{"listings":[{"a":1}]}]', "not an object"),
    "sorted_data_3.json": ("{ }", "empty"),
    "sorted_data_4.json": ("{bad", "undecodable"),
    "sorted_data_5.json": ('{"listings":"s"}', "listings not a list"),
    "sorted_data_6.json": ('{"x":1}', "no listings"),
    "sorted_data_7.json": ('{"listings":[]}', "ok"),
    "sorted_data_8.json": ('{"listings":[{"a":1}]} trailing', "undecodable"),
    "sorted_data_9.json": ("", "undecodable"),
    "sorted_data_a.json": ("0", "empty"),
    "sorted_data_b.json": ('""', "empty"),
    "sorted_data_c.json": ("[]", "empty"),
    "sorted_data_d.json": ("null", "empty"),
    "sorted_data_e.json": ("7", "not an object"),
    "sorted_data_f.json": ('{"listings":null}', "listings not a list"),
    "sorted_data_g.json": ("[0]", "not an object"),
}


def documents(spark):
    return spark.createDataFrame([(k, v[0]) for k, v in FILES.items()], "file string, text string")


def test_good_and_rejects_are_all(spark):
    found = classify_documents(documents(spark))
    assert {r.file: r.reason for r in found.collect()} == {k: v[1] for k, v in FILES.items()}
    assert good_documents(found).count() + rejected_documents(found).count() == len(FILES)


def test_flatten_golden(spark):
    got = flatten_listings(classify_documents(documents(spark))).select("file", "pos", F.to_json("record").alias("r"))
    assert sorted(tuple(r) for r in got.collect()) == [
        ("sorted_data_1.json", 0, '{"a":1,"b":"x"}'),
        ("sorted_data_1.json", 1, '{"c":true}'),
    ]


@pytest.mark.parametrize("text", ['{"a":1}', " [1, 2]\n", '"x"', "null", "-1.5e3", '{"a":1}x', "1 2", "1,2", "1] [2", "]", "", "{", "'a'", "[1,]"])
def test_only_whole_texts_parse(spark, text):
    try:
        json.loads(text)
        valid = True
    except ValueError:
        valid = False
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(parse_json_text(F.col("t")).isNotNull()).first()[0] is valid
    assert (with_json(df, "t", "doc").where("doc is not null").count() == 1) is valid


def normalized(spark, *records, **options):
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "i int, t string")
    df = with_json(df, "t", "record").drop("t")
    return normalize_records(df, **options).orderBy("i").drop("i")


def test_normalize_golden(spark):
    got = normalized(spark, {"a": 1, "d": {"w": 1, "z": {"q": 2}}, "l": [1, 2]}, {"b": "x"})
    assert set(got.columns) == {"a", "b", "d.w", "d.z.q", "l"}
    first, second = (r.asDict() for r in got.collect())
    assert first == {"a": 1, "b": None, "d.w": 1, "d.z.q": 2, "l": [1, 2]}
    assert second == {"a": None, "b": "x", "d.w": None, "d.z.q": None, "l": None}


def test_normalize_mixed_kinds_at_one_path(spark):
    got = normalized(
        spark,
        {"a": {"b": {"c": 1}}, "m": 1, "n": 1, "e": {}},
        {"a": 5, "m": "text", "n": 2.5, "l": [{"k": 1}]},
        {"a": {"b": "deep"}, "m": [1, {"z": None}], "n": None, "l": [[1], None]},
        {"a": "s", "m": True, "n": 23.0, "l": []},
    )
    cells = [r.asDict() for r in got.collect()]
    assert [c["a"] for c in cells] == [None, "5", None, "s"]
    assert [c["a.b"] for c in cells] == [None, None, "deep", None]
    assert [c["a.b.c"] for c in cells] == [1, None, None, None]
    assert [c["m"] for c in cells] == ["1", "text", '[1,{"z":null}]', "true"]
    assert [c["n"] for c in cells] == [1.0, 2.5, None, 23.0]
    assert [c["l"] for c in cells] == [None, '[{"k":1}]', "[[1],null]", "[]"]
    assert "e" not in cells[0]


def test_normalize_unusual_keys_and_no_rows(spark):
    record = {"it's": 1, 'q"t': {"x y": 2, "b`t": 3}, "a.b": 4, "$": 5, "": 6, "OBJECT<": "o"}
    cells = normalized(spark, record, {"a": {"b": 7}}).collect()
    assert cells[0].asDict() == {"it's": 1, 'q"t.x y': 2, 'q"t.b`t': 3, "a.b": 4, "$": 5, "": 6, "OBJECT<": "o"}
    assert cells[1]["a.b"] == 7
    nothing = spark.createDataFrame([], "i int, t string")
    assert discover_columns(with_json(nothing, "t", "record")) == []


def random_record(rng, depth=0):
    kinds = [None, True, 3, 2.5, "t", "", [1, 2], [], [{"k": 1}], -7, 10**12]
    record = {}
    for name in rng.sample("abcd", rng.randint(0, 4)):
        record[name] = random_record(rng, depth + 1) if depth < 3 and rng.random() < 0.4 else rng.choice(kinds)
    return record


def leaves(record, path=()):
    for name, value in record.items():
        if isinstance(value, dict):
            yield from leaves(value, (*path, name))
        else:
            yield ".".join((*path, name)), value


def object_paths(record, path=()):
    for name, value in record.items():
        if isinstance(value, dict):
            yield ".".join((*path, name))
            yield from object_paths(value, (*path, name))


@pytest.mark.parametrize("seed", range(5))
def test_normalize_random_records_loses_nothing(spark, seed):
    rng = random.Random(seed)
    records = [random_record(rng) for _ in range(60)]
    expected = [dict(leaves(r)) for r in records]
    got = [r.asDict() for r in normalized(spark, *records).collect()]
    names = {name for e in expected for name in e}
    # A path that holds objects and, besides, only nulls is no column of its own: null is a missing object.
    objects = {name for r in records for name in object_paths(r)}
    hollow = {n for n in names & objects if all(e.get(n) is None for e in expected)}
    assert set(got[0]) == names - hollow
    for name in got[0]:
        values = [e.get(name) for e in expected]
        cells = [g[name] for g in got]
        kinds = {type(v) for v in values if v is not None}
        if kinds <= {int, float} or len(kinds) == 1 and kinds != {list}:
            assert cells == values
        else:  # kinds differ, or arrays that may hold objects: text is itself, other values are JSON
            shown = [c if c is None or isinstance(c, str) else json.dumps(c) for c in cells]
            for value, cell in zip(values, shown):
                assert cell == value if value is None or isinstance(value, str) else json.loads(cell) == value


def test_keys_that_differ_in_case(spark):
    both = ({"Price": 1}, {"price": 2})
    assert {c for c in normalized(spark, *both).columns} == {"Price", "price"}
    spark.conf.set("spark.sql.caseSensitive", "false")
    try:
        got = normalized(spark, *both)
        assert got.columns[-2:] == ["Price", "price (2)"]
        assert sorted((tuple(r)[-2:] for r in got.collect()), key=repr) == [(1, None), (None, 2)]
    finally:
        spark.conf.set("spark.sql.caseSensitive", "true")


def test_paths_named_like_carried_columns(spark):
    df = spark.createDataFrame([("f", 0, '{"file": "x", "pos": 7, "_pos": 8}')], "file string, pos int, t string")
    got = normalize_records(df.select("file", "pos", F.try_parse_json("t").alias("record")))
    assert got.first().asDict() == {"_file": "f", "__pos": 0, "file": "x", "pos": 7, "_pos": 8}


def test_what_follows_a_document_makes_it_no_json(spark):
    texts = ['{"listings":[]},"end of text"', '{"listings":[]},"end of text"] junk', '{"listings":[]}, 5', '{"listings":[]}']
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "file string, text string")
    got = classify_documents(df).orderBy("file").collect()
    assert [r.reason for r in got] == ["undecodable"] * 3 + ["ok"]


def test_non_numbers_are_null(spark):
    texts = ['{"listings":[{"a": NaN, "b": "NaN, x", "c": -Infinity, "d": [NaN,1]}]}', '{"listings":[NaN x]}', '{"listings": nan}']
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "file string, text string")
    got = classify_documents(df).orderBy("file").collect()
    assert [r.reason for r in got] == ["ok", "undecodable", "undecodable"]
    assert json.loads(got[0].listings[0].toJson()) == {"a": None, "b": "NaN, x", "c": None, "d": [None, 1]}


UNWRAP = [
    ('{"a":[1,2],"b":[3,4]}', [{"a": 1, "b": 3}, {"a": 2, "b": 4}]),
    ('{"a":[1,2],"b":[3]}', "lengths differ"),
    ('{"a":1,"b":2}', "no rows"),
    ('{"listings":[{"x":1},{"x":2}]}', [{"x": 1}, {"x": 2}]),
    ('[{"x":1}]', [{"x": 1}]),
    ("5", "not records"),
    ('"[{\\"y\\":1}]"', [{"y": 1}]),
    ('{"a":[1,2],"b":7}', [{"a": 1, "b": 7}, {"a": 2, "b": 7}]),
    ("{}", []),
    ('{"q":{"a":[1],"b":["z"]}}', [{"a": 1, "b": "z"}]),
    ('{"q":3}', "not records"),
    ('"zz"', "undecodable"),
    ("nope", "undecodable"),
    ('{"a":[],"b":[]}', []),
    ('{"a":[null],"b":[{"c":1}]}', [{"a": None, "b": {"c": 1}}]),
]


def test_unwrap_every_shape(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(UNWRAP)], "i int, t string")
    got = unwrap_records(with_json(df, "t", "doc"), "i")
    found = {}
    for r in got.select("i", "pos", "reason", F.to_json("record").alias("r")).orderBy("i", "pos").collect():
        if r.reason == "ok":
            found.setdefault(r.i, []).append(json.loads(r.r))
        else:
            found[r.i] = r.reason
    assert [found.get(i, []) for i in range(len(UNWRAP))] == [e for _, e in UNWRAP]
