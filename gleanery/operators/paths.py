"""Records of very many different paths: a catalogue of paths as a table, frequent ones as columns, the rest in one VARIANT.

The union of all keys may be larger than any schema should be. Here it is only
ever a table: counted level by level, objects being opened one level at a time. The
driver gets the paths that were chosen, a number the caller names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.operators.listings import FlatColumn, is_kind, normalize_records
from gleanery.session import written

COLUMNS = 200
REST = "rest"
_NUMBERS = ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")


def _children(value: Column) -> Column:
    return F.when(is_kind(value, "OBJECT"), F.try_variant_get(value, "$", "map<string,variant>"))


def path_catalog(records: DataFrame, record: str = "record") -> DataFrame:
    """``path array<string>, kind, records, depth``: every path, the kinds of values there and in how many records.

    One pass for each level of nesting, over what is nested that deep. ``kind`` is
    the name of a variant type; an object has a row of its own.
    """
    level = records.select(F.array().cast("array<string>").alias("path"), F.col(record).alias("value"))
    found: list[DataFrame] = []
    while True:
        opened = level.select("path", F.explode(_children(F.col("value"))).alias("key", "value"))
        opened = opened.select(F.concat("path", F.array("key")).alias("path"), "value")
        kind = F.regexp_extract(F.schema_of_variant("value"), "^[A-Z]+", 0)
        counted = opened.groupBy("path", kind.alias("kind")).agg(F.count("*").alias("records"))
        found.append(written(counted.withColumn("depth", F.size("path")), "paths"))
        if found[-1].where("kind = 'OBJECT'").isEmpty():
            return reduce(DataFrame.unionByName, found)
        level = written(opened.where(is_kind(F.col("value"), "OBJECT")), "level")


def frequent_columns(catalog: DataFrame, most: int = COLUMNS) -> list[FlatColumn]:
    """The ``most`` paths found in the most records, as columns; the path decides between equals."""
    leaves = catalog.where("kind not in ('OBJECT', 'VOID')").groupBy("path").agg(
        F.sum("records").alias("records"), F.collect_set("kind").alias("kinds")
    )
    objects = catalog.where("kind = 'OBJECT'").select("path", F.lit(True).alias("mixed"))
    top = leaves.orderBy(F.desc("records"), "path").limit(most).join(objects, "path", "left")
    return sorted((_column(tuple(r["path"]), set(r["kinds"]), bool(r["mixed"])) for r in top.collect()), key=lambda c: c.path)


def _column(path: tuple[str, ...], kinds: set[str], mixed: bool) -> FlatColumn:
    if kinds == {"BIGINT"}:
        return FlatColumn(path, T.LongType(), mixed)
    if kinds <= set(_NUMBERS):
        return FlatColumn(path, T.DoubleType(), mixed)
    if kinds == {"BOOLEAN"}:
        return FlatColumn(path, T.BooleanType(), mixed)
    return FlatColumn(path, T.StringType(), mixed, as_json=kinds != {"STRING"})


def _leaves(record: Column, depth: int) -> Column:
    """``path, value`` of everything in a record that is no object, objects opened ``depth`` levels deep."""

    def opened(path: Column, value: Column) -> Column:
        entries = F.map_entries(F.try_variant_get(value, "$", "map<string,variant>"))
        return F.transform(entries, lambda e: F.struct(F.concat(path, F.array(e["key"])).alias("path"), e["value"].alias("value")))

    found = F.when(is_kind(record, "OBJECT"), opened(F.array().cast("array<string>"), record))
    for _ in range(depth - 1):
        found = F.flatten(
            F.transform(
                found,
                lambda e: F.when(is_kind(e["value"], "OBJECT"), opened(e["path"], e["value"])).otherwise(F.array(e)),
            )
        )
    return F.filter(found, lambda e: ~is_kind(e["value"], "OBJECT") & ~is_kind(e["value"], "VOID"))


def _shown(path: Column) -> Column:
    """Dotted, or as a JSON list where a key holds a dot itself."""
    return F.when(F.exists(path, lambda x: F.contains(x, F.lit("."))), F.to_json(path)).otherwise(F.array_join(path, "."))


def normalize_many(records: DataFrame, record: str = "record", most: int = COLUMNS) -> DataFrame:
    """Records to the typed columns of their ``most`` most frequent paths, and ``rest``: a VARIANT of all other values by path.

    Paths of several kinds, and lists, are JSON text. Nulls and empty objects are
    in neither. ``rest`` is null where nothing is left; carried columns keep their
    names unless a path has them, as with ``normalize_records``.
    """
    records = written(records, "records")
    catalog = path_catalog(records, record)
    columns = frequent_columns(catalog, most)
    deepest = catalog.agg(F.max("depth")).collect()[0][0] or 1  # one number
    keep = [c for c in records.columns if c != record]
    chosen = F.array(*[F.array(*[F.lit(k) for k in c.path]) for c in columns]) if columns else F.array().cast("array<array<string>>")
    left = F.filter(_leaves(F.col(record), deepest), lambda e: ~F.array_contains(chosen, e["path"]))
    entries = F.transform(left, lambda e: F.struct(_shown(e["path"]).alias("key"), e["value"].alias("value")))
    rest = F.when(F.size(entries) > 0, F.to_variant_object(F.map_from_entries(entries)))
    name = REST
    while name in keep or name in {c.name for c in columns}:
        name = f"_{name}"
    widened = records.select(*keep, record, rest.alias(name))
    return normalize_records(widened, record, columns)
