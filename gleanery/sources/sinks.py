"""Run outputs: one folder per run key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_FORMATS = {
    "raw": ("text", {}),
    "json": ("json", {"ignoreNullFields": "false"}),
    "csv": ("csv", {"header": "true", "escape": '"'}),
    "parquet": ("parquet", {}),
}


def write_run(
    table: DataFrame, folder: str, kind: str, run_key: str | None = None, mode: str = "errorifexists"
) -> str:
    """Write ``table`` below ``folder`` as ``kind`` (raw, json, csv or parquet); returns the path.

    With ``run_key`` naming a column, each run gets its own ``run_key=...``
    folder in one pass; rows are first brought together by key so that a run is
    a few files, and the rebalance splits a run that is too large for a task.
    For csv, arrays and structs become JSON text. ``raw`` takes the only other
    column as text.
    """
    source, options = _FORMATS[kind]
    if kind == "csv":
        nested = [f.name for f in table.schema if f.dataType.typeName() in ("array", "struct", "map", "variant")]
        table = table.withColumns({name: F.to_json(F.col(f"`{name}`")) for name in nested})
    path = f"{folder.rstrip('/')}/{kind}"
    if run_key:
        table = table.hint("rebalance", F.col(run_key))
    writer = table.write.mode(mode).format(source).options(**options)
    if run_key:
        writer = writer.partitionBy(run_key)
    writer.save(path)
    return path


def write_if_rows(table: DataFrame, folder: str, kind: str, **options) -> str | None:
    """``write_run`` unless the table is empty; finding that out stops at the first row."""
    if table.isEmpty():
        return None
    return write_run(table, folder, kind, **options)
