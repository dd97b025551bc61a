"""Listing documents to records to columns."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.functions.jsontext import framed_json, once, parse_json_text, unframed
from gleanery.functions.naming import let
from gleanery.session import exact_names, written


def is_kind(value: Column, kind: str) -> Column:
    """False, not null, for a missing value."""
    return F.coalesce(F.schema_of_variant(value).startswith(kind), F.lit(False))


def classify_documents(documents: DataFrame, text: str = "text") -> DataFrame:
    """Parse each document and say what it is good for: adds ``listings`` and ``reason``.

    ``ok`` documents go on with their list of records; every other reason is a
    reject, kept in the table. Only rejects pay for finding out why.
    """
    framed = once(documents, framed_json(F.col(text)), "_framed")
    listed = once(framed, unframed(F.col("_framed"), ".listings", "array<variant>"), "listings")
    doc = unframed(F.col("_framed"))
    # Cheap looks at one place come before tests that go through the whole document.
    reason = (
        F.when(F.col("listings").isNotNull(), "ok")
        .when(doc.isNull(), "undecodable")
        .when(unframed(F.col("_framed"), ".listings").isNotNull(), "listings not a list")
        .when(unframed(F.col("_framed"), "[0]").isNotNull(), "not an object")
        .when(F.to_json(doc).isin("{}", "[]", "null", "0", "0.0", "-0", '""', "false"), "empty")
        .when(~is_kind(doc, "OBJECT"), "not an object")
        .otherwise("no listings")
    )
    return listed.withColumn("reason", reason).drop("_framed")


def good_documents(classified: DataFrame) -> DataFrame:
    return classified.where(F.col("reason") == "ok").drop("reason")


def rejected_documents(classified: DataFrame, key: str = "file") -> DataFrame:
    return classified.where(F.col("reason") != "ok").select(key, "reason")


def flatten_listings(classified: DataFrame, key: str = "file") -> DataFrame:
    """One row per element of ``listings``: ``key, pos, record``."""
    # Only good documents have a list to explode.
    return classified.select(key, F.posexplode("listings").alias("pos", "record"))


def _as_list(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def _as_columns(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>")


def _found(records: Column | None, reason: str) -> Column:
    records = F.array(F.lit(None).cast("variant")) if records is None else records
    return F.struct(records.alias("records"), F.lit(reason).alias("reason"))


def _from_columns(columns: Column) -> Column:
    """Records of an object of columns: row by row, scalars repeated."""

    def by_length(lists: Column) -> Column:
        sizes = F.array_distinct(
            F.transform(F.filter(F.map_values(lists), lambda a: a.isNotNull()), lambda a: F.size(a))
        )

        def row(position: Column) -> Column:
            cells = F.transform(
                F.map_keys(columns),
                lambda name: F.when(lists[name].isNotNull(), F.get(lists[name], position)).otherwise(columns[name]),
            )
            return F.to_variant_object(F.map_from_arrays(F.map_keys(columns), cells))

        def judged(lengths: Column) -> Column:
            rows = F.when(lengths[0] > 0, F.transform(F.sequence(F.lit(0), lengths[0] - 1), row))
            rows = F.coalesce(rows, F.array().cast("array<variant>"))
            return (
                F.when(F.size(lengths) == 0, _found(None, "no rows"))
                .when(F.size(lengths) > 1, _found(None, "lengths differ"))
                .otherwise(_found(rows, "ok"))
            )

        return let(sizes, judged)

    # An object inside a column has no rows to align with the others.
    nested = F.exists(F.map_values(columns), lambda v: is_kind(v, "OBJECT"))
    return (
        F.when(F.size(columns) == 0, _found(F.array().cast("array<variant>"), "ok"))
        .when(nested, _found(None, "no rows"))
        .otherwise(let(F.transform_values(columns, lambda _, v: _as_list(v)), by_length))
    )


def _shape(value: Column, inside=lambda value: _found(None, "not records"), single: bool = True) -> Column:
    """Records and reason of a value that may be a list or an object; ``inside`` judges the others."""

    def of_object(columns: Column) -> Column:
        held = _from_columns(columns)
        if single:
            only = F.element_at(F.map_values(columns), 1)
            held = F.when(F.size(columns) == 1, let(only, lambda v: _shape(v, single=False))).otherwise(held)
        return F.when(columns.isNull(), inside(value)).otherwise(held)

    def of_list(elements: Column) -> Column:
        return F.when(elements.isNotNull(), _found(elements, "ok")).otherwise(let(_as_columns(value), of_object))

    return let(_as_list(value), of_list)


def unwrap_records(replies: DataFrame, key: str, doc: str = "doc") -> DataFrame:
    """Records of replies of any accepted shape: ``key, pos, record, reason``.

    An object with one key stands for its value; a list gives its elements; an
    object of columns gives one record per row, scalars repeated, when all its
    lists have the same length. JSON text inside a JSON string is parsed first.
    Other replies give one row without a record and a ``reason``. The shapes are
    tried in this order, so a plain list costs one look.
    """

    def parsed_text(value: Column) -> Column:
        text = F.try_variant_get(value, "$", "string")
        opened = let(
            parse_json_text(text), lambda v: F.when(v.isNull(), _found(None, "undecodable")).otherwise(_shape(v))
        )
        return F.when(is_kind(value, "STRING"), opened).otherwise(_found(None, "not records"))

    value = F.col(doc)
    judged = F.when(value.isNull(), _found(None, "undecodable")).otherwise(_shape(value, parsed_text))
    return (
        replies.select(key, F.inline(F.array(judged)))
        .select(key, "reason", F.posexplode("records").alias("pos", "record"))
        .select(key, "pos", "record", "reason")
    )


@dataclass(frozen=True)
class FlatColumn:
    """A column to read from records.

    ``mixed``: objects at that path belong to longer paths and are skipped.
    ``as_json``: other values than text are kept as JSON text.
    """

    path: tuple[str, ...]
    type: T.DataType
    mixed: bool = False
    as_json: bool = False

    @property
    def name(self) -> str:
        return ".".join(self.path)


def _schema(text: str) -> T.DataType:
    """Spark type of a variant schema text; only the word for an object differs."""
    ddl = re.sub(r"`(?:[^`]|``)*`|\bOBJECT<", lambda m: m[0] if m[0][0] == "`" else "STRUCT<", text)
    return T.StructType.fromDDL(f"v {ddl}")[0].dataType


def _cell(path: tuple[str, ...], found: T.DataType, mixed: bool = False) -> FlatColumn:
    kind = _cell_type(found)
    return FlatColumn(path, kind, mixed, isinstance(kind, T.StringType) and not isinstance(found, T.StringType))


def _cell_type(found: T.DataType) -> T.DataType:
    if isinstance(found, T.DecimalType):
        # 23.0 is read as a decimal without scale; only integers too long for bigint stay decimal.
        return found if found.scale == 0 and found.precision > 20 else T.DoubleType()
    if isinstance(found, T.ArrayType):
        element = found.elementType
        if isinstance(element, (T.StructType, T.VariantType, T.ArrayType, T.NullType)):
            return T.StringType()
        return T.ArrayType(_cell_type(element))
    if isinstance(found, (T.NullType, T.VariantType)):
        return T.StringType()
    return found


def value_at(record: Column, path: tuple[str, ...], kind: str = "variant") -> Column:
    """The value at a key path. Keys a path text cannot quote are looked up one by one."""
    value, steps = record, "$"
    for key in path:
        if "'" in key or "\\" in key:
            held = F.try_variant_get(value, steps, "map<string,variant>")
            value, steps = F.try_element_at(held, F.lit(key)), "$"
        else:
            steps += f"['{key}']"
    return F.try_variant_get(value, steps, kind)


def discover_columns(records: DataFrame, record: str = "record") -> list[FlatColumn]:
    """Leaf paths over all records, with types: the union of keys.

    One aggregation (partial on each task, one text on the driver, as large as
    the set of distinct paths). Where a path holds both objects and other
    values one more pass looks into just those paths, per level of such mixing.
    Null counts as a missing object there, not as another value.
    """
    found: list[FlatColumn] = []
    pending: list[tuple[str, ...]] = []

    def walk(path: tuple[str, ...], kind: T.DataType) -> None:
        if isinstance(kind, T.StructType):
            for field in kind.fields:
                walk((*path, field.name), field.dataType)
        elif isinstance(kind, T.VariantType):
            pending.append(path)
        elif path:  # an element that is no object has no columns
            found.append(_cell(path, kind))

    # Schemas merged without regard to case would lose one of two keys.
    with exact_names(records.sparkSession):
        walk((), _schema(records.agg(F.schema_of_variant_agg(record)).first()[0]))
        while pending:
            level, pending = pending, []
            looks = []
            for i, path in enumerate(level):
                value = value_at(F.col(record), path)
                looks.append(F.schema_of_variant_agg(F.when(is_kind(value, "OBJECT"), value)).alias(f"o{i}"))
                looks.append(F.schema_of_variant_agg(F.when(~is_kind(value, "OBJECT"), value)).alias(f"s{i}"))
            seen = records.agg(*looks).first()
            for i, path in enumerate(level):
                objects, others = _schema(seen[f"o{i}"]), _schema(seen[f"s{i}"])
                has_objects = isinstance(objects, T.StructType)
                if path:
                    found.append(_cell(path, others, mixed=has_objects))
                if has_objects:
                    walk(path, objects)
    return sorted(found, key=lambda c: c.path)


def _read(record: Column, column: FlatColumn) -> Column:
    kind = column.type.simpleString()
    if not (column.mixed or column.as_json):
        return value_at(record, column.path, kind)

    def shown(value: Column) -> Column:
        cell = F.try_variant_get(value, "$", kind)
        if column.as_json:
            cell = F.when(is_kind(value, "STRING"), cell).when(~is_kind(value, "VOID"), F.to_json(value))
        return F.when(~is_kind(value, "OBJECT"), cell) if column.mixed else cell

    return let(value_at(record, column.path), shown)


def normalize_records(
    records: DataFrame, record: str = "record", columns: list[FlatColumn] | None = None
) -> DataFrame:
    """Records to typed columns named by dotted path; missing values are null.

    Arrays stay one cell: typed for plain elements, JSON text otherwise. Without
    ``columns`` the records are read more than once, first to find them; they
    are written for that, parsed, so that no pass goes back to the documents. A
    carried column whose name is also a path gets underscores in front; of paths
    that differ in case only, the later ones get a number unless the session
    tells names apart by case.
    """
    if columns is None:
        records = written(records, "records")
        columns = discover_columns(records, record)
    by_name: dict[str, list[FlatColumn]] = {}
    for column in columns:
        by_name.setdefault(column.name, []).append(column)
    keep = [c for c in records.columns if c != record]
    sensitive = records.sparkSession.conf.get("spark.sql.caseSensitive") == "true"
    shown = _free_names(by_name, sensitive, lambda name, n: f"{name} ({n})")
    carried = _free_names(keep, sensitive, lambda name, n: "_" * (n - 1) + name, set(shown.values()))
    # {"a.b": 1} and {"a": {"b": 2}} name the same column; the nested value wins.
    cells = [
        F.coalesce(*[_read(F.col(record), c) for c in sorted(same, key=lambda c: -len(c.path))]).alias(shown[name])
        if len(same) > 1
        else _read(F.col(record), same[0]).alias(shown[name])
        for name, same in by_name.items()
    ]
    return records.select(*[records[name].alias(carried[name]) for name in keep], *cells)


def _free_names(
    names: Iterable[str], sensitive: bool, again: Callable[[str, int], str], taken: set[str] = frozenset()
) -> dict[str, str]:
    """A name for each that no other has; ``again`` gives the n-th attempt."""
    used = {n if sensitive else n.lower() for n in taken}
    result = {}
    for name in names:
        attempt, n = name, 1
        while (attempt if sensitive else attempt.lower()) in used:
            n += 1
            attempt = again(name, n)
        used.add(attempt if sensitive else attempt.lower())
        result[name] = attempt
    return result
