"""Cleaning, sampling and unifying the columns of a combined table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.functions import fixed
from gleanery.functions.prices import clean_price, price_rejected
from gleanery.functions.urls import clean_url

Mapping = Sequence[tuple[str, Sequence[str]]]


def named(name: str) -> Column:
    """The column of exactly that name; dots are part of it."""
    return F.col("`" + name.replace("`", "``") + "`")


def clean_columns(
    table: DataFrame, price: str = fixed.PRICE_COLUMN, urls: Sequence[str] = fixed.URL_COLUMNS
) -> DataFrame:
    """Clean the price column and the URL columns that exist; the others stay."""
    cleaned = {price: clean_price(named(price))} if price in table.columns else {}
    cleaned.update({u: _clean_urls(table, u) for u in urls if u in table.columns})
    return table.withColumns(cleaned) if cleaned else table


def _clean_urls(table: DataFrame, name: str) -> Column:
    """Text and lists of text are cleaned; a column of another type holds no URL and stays."""
    kind = table.schema[name].dataType
    if isinstance(kind, T.StringType):
        return clean_url(named(name))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
        return F.transform(named(name), clean_url)
    return named(name)


def price_rejects(table: DataFrame, price: str = fixed.PRICE_COLUMN) -> DataFrame:
    """How many prices are present, and how many of them cannot be read."""
    return table.agg(
        F.count(named(price)).alias("prices"), F.count_if(price_rejected(named(price))).alias("rejects")
    )


def preview(table: DataFrame, order: Sequence[str], rows: int = fixed.PREVIEW_ROWS) -> DataFrame:
    return table.orderBy(*order).limit(rows)


def column_sample(
    table: DataFrame, order: Sequence[str], rows: int = fixed.MAPPING_SAMPLE, columns: Sequence[str] | None = None
) -> DataFrame:
    """First ``rows`` values of each column, nulls included, as JSON: ``column, sample``.

    Top-k first (each task keeps ``rows`` rows), so what is collected per
    column is ``rows`` values.
    """
    columns = list(columns or table.columns)
    key = F.struct(*[named(o) for o in order]).alias("k")
    top = table.orderBy(*[named(o) for o in order]).limit(rows)
    held = top.agg(
        F.array_sort(
            F.collect_list(F.struct(key, F.struct(*[named(c).alias(f"c{i}") for i, c in enumerate(columns)]).alias("v")))
        ).alias("held")
    )
    def sample(place: int) -> Column:
        return F.to_json(F.transform("held", lambda row: row["v"][f"c{place}"]))

    samples = [F.struct(F.lit(name).alias("column"), sample(i).alias("sample")) for i, name in enumerate(columns)]
    return held.select(F.explode(F.array(*samples)).alias("s")).select("s.*")


def unify_columns(table: DataFrame, mapping: Mapping) -> DataFrame:
    """Fold old columns into new ones, entry by entry, row by row.

    The new column takes the first non-null old value in mapping order; old
    columns go, except one that has the new name. Absent columns are ignored.
    """
    held = {f.name: (named(f.name), f.dataType) for f in table.schema}
    for new, olds in mapping:
        present = [o for o in dict.fromkeys(olds) if o in held]
        if not present:
            continue
        types = [held[o][1] for o in present]
        same = all(t == types[0] for t in types)
        values = [held[o][0] if same else _as_text(*held[o]) for o in present]
        folded = (F.coalesce(*values), types[0] if same else T.StringType())
        if new in held:
            held[new] = folded
        for o in present:
            if o != new:
                del held[o]
        held[new] = folded
    return table.select(*[value.alias(name) for name, (value, _) in held.items()])


def _as_text(value: Column, kind: T.DataType) -> Column:
    nested = kind.typeName() in ("array", "struct", "map", "variant")
    return F.to_json(value) if nested else value.cast("string")


def has_rows(table: DataFrame, name: str) -> DataFrame:
    """The empty gate as a table: ``table_name, has_rows``. Reads up to the first row."""
    return table.select(F.lit(1).alias("one")).limit(1).agg(
        F.lit(name).alias("table_name"), (F.count("one") > 0).alias("has_rows")
    )
