"""Prompts for, and replies from, batch extraction."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.functions import fixed
from gleanery.functions.jsontext import with_json
from gleanery.functions.naming import let
from gleanery.functions.text import first_fence
from gleanery.operators.columns import named
from gleanery.operators.listings import is_kind, value_at


def listing_schema(names: Sequence[str]) -> T.StructType:
    """A record of required text fields."""
    return T.StructType([T.StructField(name, T.StringType(), False) for name in names])


def listings_schema(record: T.StructType) -> T.StructType:
    """The container: one field ``listings`` holding records."""
    return T.StructType([T.StructField("listings", T.ArrayType(record, False), False)])


def system_text(record: T.StructType) -> str:
    """The system prompt for a record schema."""
    fields = fixed.FIELD_SEPARATOR.join(f'"{field.name}": "{field.dataType.typeName()}"' for field in record)
    return fixed.SYSTEM_TEXT.replace("FIELDS", fields)


def prompt_table(
    pages: DataFrame, record: T.StructType, keep: Sequence[str] = ("page_id",), text: str = "markdown"
) -> DataFrame:
    """One request per page: the ``keep`` columns, ``system_prompt`` and ``user_prompt``."""
    return pages.select(
        *keep,
        F.lit(system_text(record)).alias("system_prompt"),
        F.concat(F.lit(fixed.USER_PREFIX), F.col(text)).alias("user_prompt"),
    )


def parse_replies(replies: DataFrame, record: T.StructType | None = None, reply: str = "reply") -> DataFrame:
    """Whole reply to JSON: adds ``doc`` and ``ok``; a failed reply counts no tokens.

    With a record schema, ``missing_fields`` counts the required fields that
    are absent or not text, over all listings of the reply.
    """
    parsed = with_json(replies, reply, "doc").withColumn("ok", F.col("doc").isNotNull())
    tokens = [c for c in ("input_tokens", "output_tokens") if c in replies.columns]
    parsed = parsed.withColumns(
        {c: F.when(F.col("ok"), F.coalesce(F.col(c), F.lit(0).cast("bigint"))).otherwise(F.lit(0).cast("bigint")) for c in tokens}
    )
    if record is None:
        return parsed

    def missing(listing):
        absent = [
            F.when(is_kind(value_at(listing, (name,)), "STRING"), 0).otherwise(1)
            for name in record.fieldNames()
        ]
        return sum(absent, F.lit(0))

    listings = F.try_variant_get("doc", "$.listings", "array<variant>")
    count = F.aggregate(listings, F.lit(0), lambda total, listing: total + missing(listing))
    return parsed.withColumn("missing_fields", count)


def typed_listings(parsed: DataFrame, record: T.StructType, key: str = "page_id") -> DataFrame:
    """Listings of parsed replies as rows of the declared schema: ``key, pos, conforms`` and its fields.

    A field that is absent or not text is null, and the row does not conform.
    """
    listings = F.try_variant_get("doc", "$.listings", "array<variant>")
    rows = parsed.select(key, F.posexplode(listings).alias("pos", "_listing"))

    def cell(name: str):
        value = value_at(F.col("_listing"), (name,))
        return F.when(is_kind(value, "STRING"), F.try_variant_get(value, "$", "string")).alias(name)

    cells = rows.select(key, "pos", *[cell(name) for name in record.fieldNames()])
    whole = [named(name).isNotNull() for name in record.fieldNames()]
    return cells.withColumn("conforms", reduce(and_, whole, F.lit(True)))


def fenced_json(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """First fenced block of each reply: adds ``body`` (null when none) and ``doc``."""
    return with_json(replies.withColumn("body", first_fence(F.col(reply))), "body", "doc")


def mapping_entries(replies: DataFrame, key: str, reply: str = "reply") -> DataFrame:
    """Column mappings from replies: ``key, ord, new_col, old_cols`` in reply order.

    A reply that is not an object gives nothing; a single name is a list of one.
    """
    keys = F.array_distinct(F.json_object_keys(reply))  # a map has no order; of equal keys the last value counts
    held = let(
        F.try_variant_get("doc", "$", "map<string,variant>"),
        lambda values: F.transform(
            keys, lambda name: F.struct(name.alias("new_col"), F.try_element_at(values, name).alias("value"))
        ),
    )
    value = F.col("entry.value")
    old_cols = F.when(is_kind(value, "STRING"), F.array(F.try_variant_get(value, "$", "string"))).otherwise(
        F.try_variant_get(value, "$", "array<string>")
    )
    return (
        with_json(replies, reply, "doc")
        .where(is_kind(F.col("doc"), "OBJECT"))
        .select(key, F.posexplode(held).alias("ord", "entry"))
        .select(key, "ord", F.col("entry.new_col").alias("new_col"), old_cols.alias("old_cols"))
        .where(F.col("old_cols").isNotNull())
    )


def mapping_prompt(samples: DataFrame) -> DataFrame:
    """The request for a column mapping, from ``column, sample`` rows: one row, no row without samples.

    One small row per column of a table is all that is brought together.
    """
    names = F.to_json(F.array("column"))  # quoted as JSON, in brackets
    quoted = F.substring(names, F.lit(2), F.length(names) - 2)
    lines = F.array_sort(F.collect_list(F.concat(quoted, F.lit(": "), F.col("sample"))))
    return (
        samples.agg(lines.alias("lines"))
        .where(F.size("lines") > 0)
        .select(
            F.lit(fixed.MAPPING_SYSTEM_TEXT).alias("system_prompt"),
            F.concat(F.lit("{"), F.array_join("lines", ", "), F.lit("}")).alias("user_prompt"),
        )
    )


def mapping_list(entries: DataFrame) -> list[tuple[str, list[str]]]:
    """One mapping for the driver, which holds the column list it is about as well."""
    rows = entries.orderBy("ord").select("new_col", "old_cols").collect()
    return [(row.new_col, list(row.old_cols)) for row in rows]
