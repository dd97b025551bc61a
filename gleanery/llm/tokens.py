"""Token counts by a two-tier lookup in the map stage.

A first pass finds frequent pre-tokens: every task counts its own in bounded
memory and passes on at most ``per_task`` of them, so nothing but these short
lists is shuffled. The lengths of at most ``table_size`` of them are broadcast.
The second pass splits each text, takes lengths from that table, and encodes the
rest once per worker, in a cache that is emptied when full. Pre-tokens
themselves are never shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import pieces_of, small_batches, text_bytes

# Fixed value: how byte-level vocabularies of this kind part a text before merging.
PRETOKEN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
TABLE_SIZE = 65_536  # entries broadcast
PER_TASK = 16_384  # entries a task passes on
COUNTED = 200_000  # distinct pre-tokens a task counts at a time
CACHED = 400_000  # lengths a worker keeps besides the table
_SLICE = 4 << 20

_PARTS = regex.compile(PRETOKEN)


@lru_cache(maxsize=2)
def _encoder(path: str):
    """The vocabulary of a worker, read once. It must be byte-level without a normaliser."""
    import json

    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    before = spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space"):
        raise ValueError(f"{path}: a byte-level vocabulary without normaliser and prefix space is needed")
    added = [t["content"] for t in spec.get("added_tokens", [])]
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", [])):
        raise ValueError(f"{path}: added tokens that take in their surroundings are not supported")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    special = regex.compile("|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True))) if added else None
    return tokenizer, special


def _lengths(tokenizer, parts: list[str]) -> list[int]:
    return [len(x.ids) for x in tokenizer.encode_batch(parts, add_special_tokens=False)]


def _split(text: str, special) -> tuple[list[str], int]:
    """The pre-tokens of a text, and how many special strings stand between them."""
    if special is None or not special.search(text):
        return _PARTS.findall(text), 0
    between = special.split(text)
    return [p for piece in between for p in _PARTS.findall(piece)], len(between) - 1


def frequent_pretokens(
    docs: DataFrame, path: str, table_size: int = TABLE_SIZE, per_task: int = PER_TASK
) -> DataFrame:
    """``pre, n``: frequent pre-tokens and how often tasks counted them, at most ``table_size`` rows.

    Counts are lower bounds where a task met more distinct ones than it keeps;
    they only choose the table and never enter a result.
    """
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, special = _encoder(path)
        counts: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                counts.update(_split(text, special)[0])
                if len(counts) > COUNTED:
                    counts = Counter(dict(counts.most_common(COUNTED // 2)))
        kept = counts.most_common(per_task)
        yield pa.RecordBatch.from_pydict(
            {"pre": pa.array([k for k, _ in kept], pa.string()), "n": pa.array([v for _, v in kept], pa.int64())}
        )

    texts = docs.select(F.coalesce(docs["text"], F.lit("")).alias("text"))
    counted = texts.mapInArrow(count, "pre string, n long")
    return counted.groupBy("pre").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "pre").limit(table_size)


def count_tokens(docs: DataFrame, path: str, limit: int = 512, table_size: int = TABLE_SIZE) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit``: one row per row of ``docs``.

    ``path`` names a byte-level vocabulary file that every worker can read.
    Special strings inside a text are one token each. A null or empty text has 0
    bytes and 0 tokens; a null doc_id stays null; repeated rows give repeated
    rows; other columns of ``docs`` are ignored.
    """
    spark = docs.sparkSession
    common = [r["pre"] for r in frequent_pretokens(docs, path, table_size).collect()]  # at most table_size
    tokenizer, _ = _encoder(path)
    shared = spark.sparkContext.broadcast(dict(zip(common, _lengths(tokenizer, common), strict=True)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, special = _encoder(path)
        frequent = shared.value
        cache: dict[str, int] = {}
        for batch in batches:
            for part in pieces_of(batch, _SLICE):
                split = [_split(x.decode(), special) for x in part.column("body").to_pylist()]
                missing = [p for p in {p for parts, _ in split for p in parts} if p not in frequent and p not in cache]
                if len(cache) + len(missing) > CACHED:
                    cache.clear()
                    missing = [p for p in {p for parts, _ in split for p in parts} if p not in frequent]
                cache.update(zip(missing, _lengths(tokenizer, missing), strict=True))
                tokens = [
                    n + sum(frequent[p] if p in frequent else cache[p] for p in parts) for parts, n in split
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pc.binary_length(part.column("body")).cast(pa.int64()),
                        pa.array(tokens, pa.int64()),
                    ],
                    ["doc_id", "n_bytes", "n_tokens"],
                )

    small_batches(spark)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_bytes(docs["text"]).alias("body"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long").withColumn(
        "over_limit", F.col("n_tokens") > limit
    )
