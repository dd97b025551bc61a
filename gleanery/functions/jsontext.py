"""JSON text to VARIANT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.naming import let

# A number JSON does not have, where a value may stand.
_NON_NUMBER = r"(?<=[:\[,\s])-?(?:NaN|Infinity)(?=\s*[,\]}])"


def framed_json(text: Column) -> Column:
    """The text parsed as the first of two array elements, and the second: ``doc, mark``.

    ``try_parse_json`` stops after the first value and ignores what follows.
    Inside an array the text must be one whole value for the second element to
    be found where it belongs; ``unframed`` looks for it. That element is a hash
    of the text, as no fixed one is safe: a text may end an array of its own
    early, with any element it likes. Texts that fail are tried once more with NaN
    and infinities as null.
    """

    def parsed(mark: Column) -> Column:
        def framed(body: Column) -> Column:
            return F.try_parse_json(F.concat(F.lit("["), body, F.lit(","), mark.cast("string"), F.lit("]")))

        odd = F.when(F.rlike(text, F.lit(_NON_NUMBER)), framed(F.regexp_replace(text, _NON_NUMBER, "null")))
        return F.struct(F.coalesce(framed(text), odd).alias("doc"), mark.alias("mark"))

    return let(F.xxhash64(text), parsed)


def unframed(framed: Column, path: str = "", kind: str = "variant") -> Column:
    """A path of the framed value; null when the text was not exactly one JSON value."""
    whole = F.try_variant_get(framed["doc"], "$[1]", "bigint") == framed["mark"]
    return F.when(whole, F.try_variant_get(framed["doc"], f"$[0]{path}", kind))


def parse_json_text(text: Column) -> Column:
    """The text as one JSON value; null when it is anything else."""
    return let(framed_json(text), lambda framed: unframed(framed))


def once(table: DataFrame, value: Column, name: str) -> DataFrame:
    """Add a column that is worked out once per row.

    A plain projection would be copied into every filter and projection above
    it. These rows come out of a generator, which nothing is moved across.
    """
    return table.select("*", F.explode(F.array(value)).alias(name))


def with_json(table: DataFrame, text: str, name: str) -> DataFrame:
    """Add the parsed text, parsed once per row."""
    framed = once(table, framed_json(F.col(text)), "_framed")
    return once(framed, unframed(F.col("_framed")), name).drop("_framed")
