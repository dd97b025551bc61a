import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import rows
from gleanery.operators.replies import (
    fenced_json,
    listing_schema,
    listings_schema,
    mapping_entries,
    mapping_list,
    parse_replies,
    prompt_table,
    system_text,
    typed_listings,
)


def test_listing_schema(spark):
    record = listing_schema(["name", "price"])
    assert [(f.name, f.dataType, f.nullable) for f in record] == [("name", T.StringType(), False), ("price", T.StringType(), False)]
    container = listings_schema(record)
    assert container.names == ["listings"] and container["listings"].dataType.elementType == record


def test_prompts(spark):
    text = system_text(listing_schema(["name", "price"]))
    assert '                "name": "string",\n"price": "string"\n            }\n        ]\n    } ' in text
    assert "FIELDS" not in text and text.startswith("\n    You are")
    df = spark.createDataFrame([(1, "# T")], "page_id int, markdown string")
    row = prompt_table(df, listing_schema([])).first()
    assert row.user_prompt == "Extract the following information from the provided text:\nPage content:\n\n# T"


def test_failed_replies_count_nothing(spark):
    data = [
        (1, '{"listings":[{"name":"a","price":"1"},{"name":2},{}]}', 10, 5),
        (2, "Sorry, no", 10, 5),
        (3, '{"listings":[]} extra', 10, 5),
        (4, '{"other":1}', None, 5),
        (5, None, 10, 5),
    ]
    df = spark.createDataFrame(data, "page_id int, reply string, input_tokens bigint, output_tokens bigint")
    got = parse_replies(df, listing_schema(["name", "price"])).orderBy("page_id")
    assert rows(got.select("ok", "input_tokens", "output_tokens", "missing_fields")) == [
        (True, 10, 5, 4),
        (False, 0, 0, None),
        (False, 0, 0, None),
        (True, 0, 5, None),
        (False, 0, 0, None),
    ]


def test_field_names_with_quotes(spark):
    record = listing_schema(["it's", "a`b"])
    df = spark.createDataFrame([(1, '{"listings":[{"it\'s":"x","a`b":"y"},{}]}')], "page_id int, reply string")
    assert parse_replies(df, record).first().missing_fields == 2
    got = typed_listings(parse_replies(df, record), record).orderBy("pos")
    assert rows(got.drop("page_id", "pos")) == [("x", "y", True), (None, None, False)]


def test_a_mapping_may_be_long_and_repeat_keys(spark):
    many = "{" + ",".join(f'"n{i}":"o{i}"' for i in range(12_000)) + ',"n0":"last"}'
    entries = mapping_entries(spark.createDataFrame([(1, many)], "i int, reply string"), "i")
    found = mapping_list(entries)
    assert len(found) == 12_000 and found[0] == ("n0", ["last"]) and found[-1] == ("n11999", ["o11999"])


def test_fenced(spark):
    df = spark.createDataFrame([(1, 'x\n```json\n{"k":1}\n```'), (2, "```json\n{k\n```"), (3, "x")], "i int, reply string")
    got = fenced_json(df).orderBy("i").select("body", F.to_json("doc"))
    assert rows(got) == [('{"k":1}', '{"k":1}'), ("{k", None), (None, None)]


def test_mapping_golden(spark):
    replies = ['{"price":["cost","amt"],"name":"title"}', '["x"]', "bad{", '{"n":null}', '{"z":"b","a":["q"],"n":3}']
    df = spark.createDataFrame(list(enumerate(replies)), "i int, reply string")
    entries = mapping_entries(df, "i")
    assert sorted((r.i, r.ord, r.new_col, r.old_cols) for r in entries.collect()) == [
        (0, 0, "price", ["cost", "amt"]),
        (0, 1, "name", ["title"]),
        (4, 0, "z", ["b"]),
        (4, 1, "a", ["q"]),
    ]
    assert mapping_list(entries.where("i = 4")) == [("z", ["b"]), ("a", ["q"])]
    assert list(json.loads(replies[0])) == ["price", "name"]
