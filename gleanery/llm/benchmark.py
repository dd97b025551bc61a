"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

One pass over the texts joins passages to test items where n-grams of the items
meet, and counts in how many documents each of these seeds stands. Each item's
rarer half of them are its rare seeds, however common a leak is. The words around
passages that hold one are aligned with the item: copies score 1, edited ones
less, chance little.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from gleanery.llm.common import doc_key, frugal, pieces_of, ranges, row_of, small_batches, text_bytes, words_of
from gleanery.session import written

GRAM = 3  # words of a seed
SEEDS = 2  # different seeds a passage needs, one of them rare
SCORE = 0.5  # share of the best possible alignment score from which a passage is a copy
RUN = 13  # words of an item in a row from which a passage is a copy, however long the item
BROADCAST_IDS = 1_000_000  # keys of leaking documents that may be broadcast
BLOCK_BYTES = 8 << 20  # text of the items that are looked up at a time
MATCH, MISMATCH, GAP = 2, -1, -1
_SLICE = 3 << 20
_CACHED = 300_000
_FILTER_BITS = 20
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_U = np.uint64
_PLACES = 32  # bits of the start that travels with a score


class _Words(dict):
    """A hash of each written word without case and outer punctuation; 0 for none left."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > _CACHED:
            self.clear()
        plain = _EDGES.sub("", word.decode(errors="replace").lower())
        value = self[word] = xxhash.xxh3_64_intdigest(plain.encode()) if plain else 0
        return value


def hashed_words(bodies: list[bytes], table: _Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words that have letters or digits, whose text they are of, and which word there."""
    split = [words_of(b) for b in bodies]
    counts = np.array([len(w) for w in split], np.int64)
    hashes = np.fromiter(map(table.__getitem__, chain.from_iterable(split)), np.uint64, counts.sum())
    kept = np.flatnonzero(hashes)
    text = np.repeat(np.arange(len(split)), counts)[kept]
    return hashes[kept], text, kept - (np.cumsum(counts) - counts)[text]


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every ``n`` consecutive words."""
    if len(hashes) < n:
        return hashes[:0]
    out = hashes[: len(hashes) - n + 1].copy()
    for i in range(1, n):
        out *= _U(0x9E3779B97F4A7C15)
        out += hashes[i : len(hashes) - n + 1 + i]
    return out + _U(n)


@dataclass
class Items:
    """A block of test items, of bounded size, for lookup in every task."""

    ids: list
    words: list[np.ndarray]
    seeds: np.ndarray  # sorted hashes of all n-grams
    lengths: np.ndarray  # n-gram sizes in use: items of few words have shorter ones
    first: np.ndarray  # seed -> its items, as ranges of ``owners``
    owners: np.ndarray
    filter: np.ndarray
    sizes: np.ndarray  # words of each item
    rare: np.ndarray | None = None  # item and seed pairs, as one number

    @classmethod
    def of(cls, rows: list[tuple[object, bytes]], n: int) -> Items:
        table = _Words()
        words = [hashed_words([body], table)[0] for _, body in rows]
        of = [np.unique(grams(w, min(n, len(w)))) if len(w) else w for w in words]
        seeds, inverse = np.unique(np.concatenate([*of, np.empty(0, np.uint64)]), return_inverse=True)
        owner = np.repeat(np.arange(len(of)), [len(x) for x in of])
        order = np.lexsort((owner, inverse))
        bits = np.zeros(1 << _FILTER_BITS, bool)
        bits[(seeds >> _U(64 - _FILTER_BITS)).astype(np.int64)] = True
        sizes = np.unique([min(n, len(w)) for w in words if len(w)]).astype(np.int64)
        first = np.searchsorted(inverse[order], np.arange(len(seeds) + 1))
        return cls([i for i, _ in rows], words, seeds, sizes, first, owner[order], bits, np.array([len(w) for w in words]))

    def hits(self, hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places where a seed starts, within one text, and which seed, in order."""
        places, found = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for n in self.lengths.tolist():
            own = grams(hashes, n)
            maybe = np.flatnonzero(self.filter[(own >> _U(64 - _FILTER_BITS)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.seeds, own[maybe]), len(self.seeds) - 1)
            sure = (self.seeds[at] == own[maybe]) & (text[maybe] == text[maybe + n - 1])
            places.append(maybe[sure])
            found.append(at[sure])
        places, found = np.concatenate(places), np.concatenate(found)
        order = np.argsort(places, kind="stable")
        return places[order], found[order]

    def choose_rare(self, documents: np.ndarray) -> None:
        """The half of each item's seeds that stand in the fewest documents, ties included."""
        seed = np.repeat(np.arange(len(self.seeds)), np.diff(self.first))
        order = np.lexsort((documents[seed], self.owners))
        owner, seed = self.owners[order], seed[order]
        starts = np.searchsorted(owner, np.arange(len(self.ids)))
        ends = np.searchsorted(owner, np.arange(len(self.ids)), "right")
        middle = np.minimum(starts + np.maximum(ends - starts - 1, 0) // 2, len(seed) - 1)
        keep = documents[seed] <= documents[seed[middle]][owner]
        self.rare = np.sort(owner[keep] * len(self.seeds) + seed[keep])


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman: best local score, first word and end of the passage it lies in.

    A row for each word of the item. A score carries the place its alignment starts
    at, so one row is kept; gaps in the passage's words are one running maximum.
    """
    m = len(passage)
    steps = np.arange(m + 1, dtype=np.int64) * (-GAP) << _PLACES
    fresh = np.arange(m + 1, dtype=np.int64)  # score 0, starting here
    row = fresh.copy()
    best, end = 0, 0
    for word in item:
        change = np.where(passage == word, MATCH, MISMATCH).astype(np.int64) << _PLACES
        here = fresh.copy()
        diagonal = row[:-1] + change
        here[1:] = np.maximum(here[1:], np.maximum(diagonal, row[1:] + (GAP << _PLACES)))
        here = np.maximum.accumulate(here + steps) - steps
        here = np.maximum(here, fresh)
        row = here
        top = int(np.argmax(row >> _PLACES))
        if int(row[top]) >> _PLACES > best >> _PLACES:
            best, end = int(row[top]), top
    return best >> _PLACES, best & ((1 << _PLACES) - 1), end


def longest_run(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """The most words in a row that both have, and one past the last of them in the passage."""
    row, best, end = np.zeros(len(passage) + 1, np.int64), 0, 0
    for word in item:
        row[1:] = np.where(passage == word, row[:-1] + 1, 0)
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
    return best, end


def passages(
    items: Items, length: int, places: np.ndarray, found: np.ndarray, seeds: int
) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """Item, first word, end and different seeds of each stretch of a text worth an alignment, rarity aside."""
    counts = items.first[found + 1] - items.first[found]
    item = items.owners[ranges(items.first[found], counts)]
    place, seed = np.repeat(places, counts), np.repeat(found, counts)
    order = np.lexsort((place, item))
    item, place, seed = item[order], place[order], seed[order]
    size = items.sizes[item]
    # Hits of an item stay together while no more than the item's length lies between them.
    new = np.append(True, (item[1:] != item[:-1]) | (place[1:] - place[:-1] > size[1:]))
    edges = np.append(np.flatnonzero(new), len(item))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        n, own = int(size[a]), np.unique(seed[a:b])
        if len(own) >= min(seeds, max(1, n - GRAM + 1)):
            yield int(item[a]), max(0, int(place[a]) - n), min(length, int(place[b - 1]) + 2 * n), own


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple[object, bytes]]]:
    """The test items in blocks of about ``block_bytes``, whatever their number: the stated query set."""
    rows = items.where(items["text"].isNotNull() & items["item_id"].isNotNull()).select(
        _item_id(items).alias("item_id"), text_bytes(items["text"]).alias("body")
    ).distinct()
    total = rows.agg(F.sum(F.octet_length("body"))).collect()[0][0] or 0  # one number
    n = max(1, math.ceil(total / block_bytes))
    for i in range(n):
        block = rows.where(F.pmod(F.xxhash64("item_id", "body"), F.lit(n)) == i).collect()  # one block
        if block:
            yield sorted((r["item_id"], bytes(r["body"])) for r in block)


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    n: int = GRAM,
    seeds: int = SEEDS,
    score: float = SCORE,
    run: int = RUN,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``doc_id, item_id, score, start, words, seeds, run``: passages of documents that copy a test item or part of one.

    ``score`` is the alignment's share of what an exact copy of the item gets, from
    ``score`` on, or lower where ``run`` words of the item follow each other in
    the passage; ``start`` and ``words`` say where the passage lies in the document. Words are compared without case and outer punctuation. Items are
    looked up in blocks, so any number of them will do. Documents and items without
    text, and items without id, match nothing; a null doc_id stays null; repeated
    rows give repeated rows, repeated items one; other columns are ignored.
    """
    return _contaminated(docs, items, n, seeds, score, run, block_bytes).drop("d", "tie")


def _contaminated(
    docs: DataFrame, items: DataFrame, n: int, seeds: int, score: float, run: int, block_bytes: int
) -> DataFrame:
    """The passages with the key (``d, tie``) of their row."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.where(docs["text"].isNotNull()).select(docs["doc_id"].cast("long").alias("doc_id"), *doc_key(docs))
    kind = items.select(_item_id(items)).schema[0].dataType.simpleString()
    schema = f"doc_id long, d long, tie int, item_id {kind}, score double, start long, words long, seeds int, run int"
    result = spark.createDataFrame([], schema)
    for block in _blocks(items, block_bytes):
        held = Items.of(block, n)
        if not len(held.seeds):
            continue
        result = result.union(_of_block(rows, held, n, seeds, score, run, schema))
    return result


_FOUND = "doc_id long, d long, tie int, item int, words binary, places binary, seeds array<int>, n long"


def _of_block(rows: DataFrame, held: Items, n: int, seeds: int, least: float, run: int, schema: str) -> DataFrame:
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(held)  # a block
    kinds = pa.schema(
        [
            ("doc_id", pa.int64()), ("d", pa.int64()), ("tie", pa.int32()), ("item", pa.int32()),
            ("words", pa.binary()), ("places", pa.binary()), ("seeds", pa.list_(pa.int32())), ("n", pa.int64()),
        ]
    )

    @frugal
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Stretches with seeds; at the end, as rows without an item, in how many texts each seed stands."""
        block, table = shared.value, _Words()
        documents = np.zeros(len(block.seeds), np.int64)
        for batch in batches:
            for part in pieces_of(batch, _SLICE):
                out, ids = [], list(zip(*(part.column(k).to_pylist() for k in range(3)), strict=True))
                hashes, text, place = hashed_words(part.column("body").to_pylist(), table)
                places, found = block.hits(hashes, text)
                pairs = np.unique(text[places] * len(block.seeds) + found)
                documents += np.bincount(pairs % len(block.seeds), minlength=len(block.seeds))
                edges = np.append(np.flatnonzero(np.diff(text[places], prepend=-1)), len(places))
                for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    t = text[places[x]]
                    begin, end = np.searchsorted(text, (t, t + 1))
                    for i, a, b, own in passages(block, int(end - begin), places[x:y] - begin, found[x:y], seeds):
                        words = slice(begin + a, begin + b)
                        # No alignment matches more of the item's words than stand in the stretch,
                        # and a run of words has all its seeds.
                        matched = np.isin(block.words[i], hashes[words]).sum()
                        if matched < least * block.sizes[i] and (matched < run or len(own) < run - n + 1):
                            continue
                        held = (hashes[words].tobytes(), place[words].astype(np.int32).tobytes())
                        out.append((*ids[t], i, *held, own.tolist(), 0))
                if out:
                    yield pa.RecordBatch.from_pylist([dict(zip(kinds.names, r, strict=True)) for r in out], schema=kinds)
        seen = np.flatnonzero(documents).tolist()
        counts = [(None, None, None, None, None, None, [s], int(documents[s])) for s in seen]
        yield pa.RecordBatch.from_pylist([dict(zip(kinds.names, r, strict=True)) for r in counts], schema=kinds)

    found = written(rows.mapInArrow(find, _FOUND), "passages")
    counted = found.where("item is null").groupBy(F.col("seeds")[0].alias("seed")).agg(F.sum("n").alias("n")).collect()
    documents = np.zeros(len(held.seeds), np.int64)  # one number for each seed of the block
    documents[[r["seed"] for r in counted]] = [r["n"] for r in counted]
    held.choose_rare(documents)
    chosen = spark.sparkContext.broadcast(held)
    result = pa.schema(
        [
            ("doc_id", pa.int64()), ("d", pa.int64()), ("tie", pa.int32()), ("item_id", _arrow_type(held.ids[0])),
            ("score", pa.float64()), ("start", pa.int64()), ("words", pa.int64()), ("seeds", pa.int32()), ("run", pa.int32()),
        ]
    )

    @frugal
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = chosen.value
        for batch in batches:
            out = []
            for *key, i, words, places, own in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                # Seeds of a whole run are as good as a rare one: few texts have them together.
                whole = len(own) >= run - n + 1
                if not whole and not np.isin(i * len(block.seeds) + np.array(own), block.rare).any():
                    continue
                item, place = block.words[i], np.frombuffer(places, np.int32)
                passage = np.frombuffer(words, np.uint64)
                points, start, end = align(item, passage)
                share = points / (MATCH * len(item))
                longest, last = longest_run(item, passage) if whole or share >= least else (0, 0)
                if share < least:
                    if longest < run:
                        continue
                    start, end = last - longest, last
                first, last = int(place[start]), int(place[end - 1])
                out.append((*key, block.ids[i], share, first, last - first + 1, len(own), longest))
            yield pa.RecordBatch.from_pylist([dict(zip(result.names, r, strict=True)) for r in out], schema=result)

    return found.where("item is not null").drop("n").mapInArrow(score, schema)


def _arrow_type(value: object) -> pa.DataType:
    return pa.int64() if isinstance(value, int) else pa.string()


def _item_id(items: DataFrame) -> Column:
    """Ids of any integer type as long, all others as text."""
    kind = items.schema["item_id"].dataType
    return items["item_id"].cast("long" if isinstance(kind, IntegralType) else "string")


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no passage of a test item, with all their columns.

    Each row is judged by its own text, whatever other rows share its id.
    """
    found = _contaminated(docs, items, GRAM, SEEDS, SCORE, RUN, BLOCK_BYTES)
    leaked = written(found.select("d", "tie").distinct(), "leaked")
    if leaked.count() <= BROADCAST_IDS:  # counted: the texts then stay where they are
        leaked = F.broadcast(leaked)
    d, tie, _ = doc_key(docs)
    rows = docs.select(row_of(docs), d, tie)
    kept = rows.join(leaked, ["d", "tie"], "left_anti")
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])
