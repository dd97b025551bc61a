"""How quality filters interact in every order, by sorted posting lists.

Each document is read once and becomes a few bits: which filters it fails and how
it is labelled. Sorted by part and id these become posting lists of failing ids
for a range of ids, one list per filter. What a filter removes behind others is
its list without theirs: a galloping merge over the range. Sizes of the
differences add up over ranges, and every order of the filters is a sum of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from itertools import chain, combinations, permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.common import LAST_ID, frugal, pieces_of, small_batches, text_bytes, words_of
from gleanery.session import written

_SLICE = 4 << 20
_RANGE = 1 << 17  # ids whose posting lists are merged at a time
_STRIDE = 4096  # ids of the leading list that gallop through the others together
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_CONTINUED = bytes(range(0x80, 0xC0))  # bytes within a character
_SYMBOLS = b"#$%&*|"


@dataclass(frozen=True)
class Text:
    """What filters look at."""

    body: bytes
    words: list[bytes]

    @property
    def characters(self) -> int:
        return len(self.body.translate(None, _CONTINUED))

    def without(self, some: bytes) -> int:
        return len(self.body.translate(None, some))


def too_short(text: Text) -> bool:
    return len(text.words) < 100


def repetitive(text: Text) -> bool:
    return 100 * len(set(text.words)) < 80 * len(text.words)


def shouting(text: Text) -> bool:
    return 100 * (len(text.body) - text.without(_UPPER)) > 10 * text.characters


def symbols(text: Text) -> bool:
    return text.without(_SYMBOLS) < len(text.body)


FILTERS: dict[str, Callable[[Text], bool]] = {"A": too_short, "B": repetitive, "C": shouting, "D": symbols}
COPIES = "E"  # the filter that fails copies of a text of a smaller id
GOOD, TOXIC = 1 << 8, 1 << 9  # bits beside those of the filters


def failing_bits(docs: DataFrame, filters: Mapping[str, Callable[[Text], bool]] = FILTERS) -> DataFrame:
    """``part, doc_id, d, key, bits``: one row per row of ``docs``, with a digest of the text and a bit per filter failed."""
    small_batches(docs.sparkSession)
    rules = list(filters.values())

    @frugal
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in pieces_of(batch, _SLICE):
                keys, bits = [], []
                for body in rows.column("body").to_pylist():
                    text = Text(body, words_of(body))
                    bits.append(sum(bool(rule(text)) << i for i, rule in enumerate(rules)))
                    keys.append(hashlib.sha256(body).digest())
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns[:3], pa.array(keys, pa.binary()), pa.array(bits, pa.int32())],
                    ["part", "doc_id", "d", "key", "bits"],
                )

    doc_id = docs["doc_id"].cast("long")
    rows = docs.select(
        F.coalesce(docs["lang"], F.lit("")).alias("part"),
        doc_id.alias("doc_id"),
        F.coalesce(doc_id, F.lit(LAST_ID)).alias("d"),
        text_bytes(docs["text"]).alias("body"),
    )
    return rows.mapInArrow(judge, "part string, doc_id long, d long, key binary, bits int")


def with_copies(rows: DataFrame, bit: int) -> DataFrame:
    """``rows`` with a bit set for copies of a text that stands under a smaller id, in whatever part."""
    # Folded where they are read: a text held by a third of the rows is one row of each task.
    several = rows.groupBy("key").agg(F.min("d").alias("least"), F.max("d").alias("most")).where("least < most")
    joined = rows.join(several.select("key", "least"), "key", "left")
    copy = F.when(F.col("d") > F.col("least"), F.lit(bit)).otherwise(F.lit(0))
    return joined.withColumn("bits", F.col("bits").bitwiseOR(copy)).drop("least", "key")


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with bits for a label of good quality and of toxicity; of several labels of an id any will do."""
    named = labels.where(labels["doc_id"].isNotNull()).select(
        labels["doc_id"].cast("long").alias("doc_id"),
        F.when(labels["quality"] == 1, F.lit(GOOD)).otherwise(F.lit(0)).alias("good"),
        F.when(labels["toxic"] == 1, F.lit(TOXIC)).otherwise(F.lit(0)).alias("toxic"),
    )
    named = named.groupBy("doc_id").agg((F.max("good") + F.max("toxic")).alias("label")).where("label > 0")
    joined = rows.join(named, "doc_id", "left")
    return joined.withColumn("bits", F.col("bits").bitwiseOR(F.coalesce("label", F.lit(0)))).drop("label")


def gallop(ids: np.ndarray, start: int, beyond: int) -> int:
    """The first place from ``start`` on that holds more than ``beyond``, by doubling steps."""
    step, low = 1, start
    while low + step < len(ids) and ids[low + step] <= beyond:
        low += step
        step *= 2
    return low + int(np.searchsorted(ids[low : low + step + 1], beyond, "right"))


def difference(lead: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """The ids of ``lead`` that stand in none of the ``others``, all ascending: a k-way merge by galloping."""
    places, kept = [0] * len(others), []
    for a in range(0, len(lead), _STRIDE):
        part = lead[a : a + _STRIDE]
        for k, ids in enumerate(others):
            if not len(part):
                break
            begin = gallop(ids, places[k], int(part[0]) - 1) if places[k] < len(ids) else len(ids)
            end = gallop(ids, begin, int(part[-1])) if begin < len(ids) else begin
            places[k] = begin
            window = ids[begin:end]
            if len(window):
                at = np.minimum(np.searchsorted(window, part), len(window) - 1)
                part = part[window[at] != part]
        kept.append(part)
    return np.concatenate(kept) if kept else lead


def subsets(n: int, without: int) -> Iterator[int]:
    """Every set of the other filters, as bits."""
    rest = [i for i in range(n) if i != without]
    for chosen in chain.from_iterable(combinations(rest, k) for k in range(n)):
        yield sum(1 << i for i in chosen)


def range_counts(bits: np.ndarray, n: int) -> Iterator[tuple[int, int, int, int, int]]:
    """Filter, set of others, and of the ids that only it fails: how many, good ones, toxic ones."""
    lists = [np.flatnonzero(bits & (1 << i)) for i in range(n)]
    for i, lead in enumerate(lists):
        for others in subsets(n, i):
            marks = bits[difference(lead, [lists[j] for j in range(n) if others >> j & 1])]
            yield i, others, len(marks), int(np.count_nonzero(marks & GOOD)), int(np.count_nonzero(marks & TOXIC))


def posting_counts(rows: DataFrame, n: int) -> DataFrame:
    """``part, filter, others, n, good, toxic``: documents failing a filter and none of the others, over all id ranges.

    A row with filter -1 has the documents of the part.
    """

    @frugal
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        for part, bits in _ranges(batches):
            found.append((part, -1, 0, len(bits), 0, 0))
            found.extend((part, *row) for row in range_counts(bits, n) if row[2])
            if len(found) > 10_000:
                yield _batch(found)
                found = []
        yield _batch(found)

    # Ranges of ids of a part: a part of any share of the rows lies in as many tasks as it needs.
    spread = rows.repartitionByRange("part", "d", "spread").sortWithinPartitions("part", "d", "spread")
    counted = spread.select("part", "bits").mapInArrow(
        count, "part string, filter int, others int, n long, good long, toxic long"
    )
    return counted.groupBy("part", "filter", "others").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def _batch(found: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    columns = list(zip(*found, strict=True)) or [()] * len(kinds)
    names = ["part", "filter", "others", "n", "good", "toxic"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray]]:
    """The bits of ids in order, a bounded range of one part at a time."""
    of, held, size = None, [], 0
    for batch in batches:
        parts = batch.column(0).dictionary_encode()
        codes, bits = parts.indices.to_numpy(), batch.column(1).to_numpy()
        edges = np.append(np.flatnonzero(np.diff(codes, prepend=-1)), len(codes))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            part = parts.dictionary[int(codes[a])].as_py()
            if held and (part != of or size + b - a > _RANGE):
                yield of, np.concatenate(held)
                held, size = [], 0
            of = part
            held.append(bits[a:b])
            size += b - a
    if held:
        yield of, np.concatenate(held)


def every_step(parts: DataFrame, names: str) -> DataFrame:
    """``parts`` with ``filter_order, step, filter, others``: a row for every order and step."""
    order = F.explode(F.array(*[F.lit("".join(x)) for x in permutations(names)]))
    letters = F.split("filter_order", "")
    rows = parts.withColumn("filter_order", order).select("*", F.posexplode(letters).alias("place", "letter"))
    bit = lambda letter: F.pow(F.lit(2), F.instr(F.lit(names), letter) - 1).cast("int")
    before = F.slice(letters, F.lit(1), F.col("place"))
    return rows.select(
        *parts.columns,
        "filter_order",
        (F.col("place") + 1).alias("step"),
        (F.instr(F.lit(names), F.col("letter")) - 1).alias("filter"),
        F.aggregate(before, F.lit(0), lambda acc, x: acc + bit(x)).alias("others"),
    )


def audit(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Callable[[Text], bool]] = FILTERS) -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``.

    One row for each part (language), order of the filters and step. The filters are
    those of ``filters``, named by one letter each, and ``E``, which fails a
    text that a smaller doc_id holds too. ``kept`` documents are left after the step,
    ``removed`` go in it, ``redundant`` ones fail its filter but went before,
    ``unique_fails`` fail no other filter; ``good_lost`` and ``toxic_lost`` are
    removed ones labelled so; ``shapley`` adds up what the filter removes in all
    orders. A null text is an empty one, a null language the part ``''``; null
    doc_ids come last, copy each other not, and have no label; repeated rows count
    each but are no copies of each other, sharing their id; of several labels of an
    id any that is set counts. Other columns are ignored. No documents: no rows.
    """
    names = "".join(filters) + COPIES
    if len(set(names)) != len(names) or any(len(x) != 1 for x in filters) or len(names) > 8:
        raise ValueError("filters are named by different single letters other than E, seven at most")
    n = len(names)
    rows = written(failing_bits(docs, filters), "bits")
    marked = with_labels(with_copies(rows, 1 << (n - 1)), labels)
    # Rows that share part and id spread over ranges as well.
    marked = written(marked.withColumn("spread", F.monotonically_increasing_id()), "marked")
    counts = written(posting_counts(marked, n), "postings")

    held = counts.where("filter >= 0")
    weights = [factorial(k) * factorial(n - 1 - k) for k in range(n)]
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), F.bit_count("others") + 1)
    whole = F.bit_count("others") == n - 1
    of_filter = held.groupBy("part", "filter").agg(
        F.sum(F.when(F.col("others") == 0, F.col("n"))).alias("fails"),
        F.sum(F.when(whole, F.col("n"))).alias("unique_fails"),
        F.sum(F.col("n") * weight).alias("shapley"),
    )
    parts = counts.where("filter = -1").select("part", F.col("n").alias("documents"))
    joined = every_step(parts, names).join(held, ["part", "filter", "others"], "left")
    joined = joined.join(of_filter, ["part", "filter"], "left")
    so_far = Window.partitionBy("part", "filter_order").orderBy("step")  # as many rows as filters
    removed, fails, unique, good, toxic, shapley = (
        F.coalesce(c, F.lit(0)).cast("long") for c in ("n", "fails", "unique_fails", "good", "toxic", "shapley")
    )
    return joined.select(
        "part",
        "filter_order",
        "step",
        (F.col("documents") - F.sum(removed).over(so_far)).alias("kept"),
        removed.alias("removed"),
        (fails - removed).alias("redundant"),
        unique.alias("unique_fails"),
        good.alias("good_lost"),
        toxic.alias("toxic_lost"),
        shapley.alias("shapley"),
    )
