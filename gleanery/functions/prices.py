"""Price columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.functions import fixed
from gleanery.functions.text import SPACE, strip_space

_NUMBER = rf"(?U)^[{SPACE}]*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?[{SPACE}]*$"


def price_value(price: Column) -> Column:
    """Currency signs out, rest to double; null when the rest is not a plain number."""
    bare = F.translate(price.cast("string"), fixed.CURRENCY_SIGNS, "")
    return F.when(F.rlike(bare, F.lit(_NUMBER)), strip_space(bare).try_cast("double"))


def clean_price(price: Column) -> Column:
    """``€`` and two decimals; null stays null and so does a price that cannot be read."""
    return F.concat(F.lit(fixed.PRICE_SIGN), F.call_function("format_number", price_value(price), F.lit("0.00")))


def price_rejected(price: Column) -> Column:
    """True for a price that is present but cannot be read."""
    return price.isNotNull() & price_value(price).isNull()
