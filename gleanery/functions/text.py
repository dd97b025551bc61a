"""Text columns: whitespace, tokens, URL removal, fences, HTML entities."""

from __future__ import annotations

import html
import html.entities
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.functions import fixed
from gleanery.functions.naming import let

# Whitespace as Unicode text tools see it: the White_Space property plus the
# four separator controls. Java's bare \s is ASCII only, hence (?U).
SPACE = r"\s\x1c-\x1f"
TOKEN = rf"(?U)[^{SPACE}]+"
LEADING_TOKEN = rf"(?U)[{SPACE}]*[^{SPACE}]+"


def strip_space(text: Column) -> Column:
    """Drop whitespace of any kind from both ends."""
    return F.regexp_replace(text, rf"(?U)^[{SPACE}]+|[{SPACE}]+$", "")


def token_count(text: Column) -> Column:
    """Number of whitespace-separated words."""
    return F.size(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))).cast("bigint")


def token_cut(text: Column, max_tokens: int = fixed.TOKEN_CUT) -> Column:
    """Keep the text up to the end of its ``max_tokens``-th word, else all of it.

    A text of n characters has at most (n + 1) / 2 words, so short texts never
    reach the regex.
    """
    pieces = F.regexp_extract_all(text, F.lit(LEADING_TOKEN), F.lit(0))
    return (
        F.when(F.length(text) < 2 * max_tokens, text)
        .when(F.size(pieces) <= max_tokens, text)
        .otherwise(F.array_join(F.slice(pieces, 1, max_tokens), ""))
    )


def remove_urls(text: Column) -> Column:
    return F.regexp_replace(text, fixed.URL_PATTERN, "")


def first_fence(reply: Column) -> Column:
    """Body of the first fenced JSON block, stripped; null when none or blank."""
    return F.nullif(strip_space(F.regexp_extract(reply, fixed.FENCE_PATTERN, 1)), F.lit(""))


def _entity_table() -> Column:
    """Entity name -> text as one constant map, taken from the HTML5 names Python ships."""
    table = {name[:-1]: text for name, text in html.entities.html5.items() if name.endswith(";")}
    table.update({f"#{n}": html.unescape(f"&#{n};") for n in [0, *range(128, 160)]})
    return F.from_json(F.lit(json.dumps(table)), "map<string,string>")


def _code_point(number: Column) -> Column:
    valid = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")).otherwise("�")


def unescape_entities(text: Column) -> Column:
    """Decode ``&name;``, ``&#10;`` and ``&#x0a;``; anything else stays as written.

    Texts without an ampersand skip the work. The common names are tested
    before the long table.
    """
    table = _entity_table()
    reference = r"^(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);"

    def number(name: Column) -> Column:
        is_hex = F.lower(F.substring(name, 2, 1)) == "x"

        def value_of(digits: Column) -> Column:
            n = F.when(is_hex, F.conv(digits, 16, 10)).otherwise(digits).try_cast("bigint")
            return F.when(digits == "", F.lit(0).cast("bigint")).when(F.length(digits) > 8, F.lit(1 << 32)).otherwise(n)

        written = F.substr(name, F.when(is_hex, F.lit(3)).otherwise(F.lit(2)))
        return let(F.regexp_replace(written, "^0+", ""), value_of)

    def numeric(n: Column) -> Column:
        listed = (n == 0) | n.between(128, 159)  # the only numbers in the table
        named = F.when(listed, F.try_element_at(table, F.concat(F.lit("#"), n.cast("string"))))
        return F.coalesce(named, _code_point(n))

    def value(name: Column) -> Column:
        return (
            F.when(name == "", F.lit(None).cast("string"))
            .when(name == "amp", "&")
            .when(name == "lt", "<")
            .when(name == "gt", ">")
            .when(name == "quot", '"')
            .when(name == "nbsp", "\u00a0")
            .when(name.startswith("#"), let(number(name), numeric))
            .otherwise(F.try_element_at(table, name))
        )

    def decode(piece: Column) -> Column:
        def replaced(name: Column) -> Column:
            return F.concat(value(name), F.substr(piece, F.length(name) + F.lit(2)))

        return F.coalesce(let(F.regexp_extract(piece, reference, 1), replaced), F.concat(F.lit("&"), piece))

    def decoded(parts: Column) -> Column:
        rest = F.transform(F.slice(parts, F.lit(2), F.size(parts)), decode)
        return F.array_join(F.concat(F.slice(parts, 1, 1), rest), "")

    def when_needed(whole: Column) -> Column:
        return F.when(F.contains(whole, F.lit("&")), let(F.split(whole, "&", -1), decoded)).otherwise(whole)

    return let(text, when_needed)
