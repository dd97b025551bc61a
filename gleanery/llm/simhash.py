"""Near duplicates by SimHash, candidates found by pigeonring filtering.

A fingerprint is cut into ``distance + 1`` segments on a ring. If two of them
differ in at most ``distance`` bits, some segment starts a chain of consecutive
segments whose differing bits, added up, stay within a proportional budget at
every length: none in the first, at most one in the first two, and so on. Equal
first segments and next segments at most one bit apart make the key that
candidates meet by; the rest of the chain is checked before the whole distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.common import doc_key, frugal, pieces_of, row_of, small_batches, words_of
from gleanery.session import sized, written

SHINGLE = 4
SEED = 42
DISTANCE = 4
_SLICE = 4 << 20
_BLOCK = 1024  # fingerprints compared with as many at a time
_LINK_ROWS = 50_000
KEY_ROWS = 8192  # rows of a key that are compared in one task
_U = np.uint64


def shingle_hashes(body: bytes, shingle: int = SHINGLE, seed: int = SEED) -> list[int]:
    """Hashes of all word shingles in order, of the whole text if it is shorter; none without words."""
    words = words_of(body.lower())  # bytes: A-Z only
    if not words:
        return []
    text = b" ".join(words)
    if len(words) <= shingle:
        return [xxhash.xxh64_intdigest(text, seed)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    first = np.append(0, ends[:-shingle]).tolist()
    return [xxhash.xxh64_intdigest(text[a : b - 1], seed) for a, b in zip(first, ends[shingle - 1 :].tolist())]


def majority(hashes: list[int] | np.ndarray) -> int:
    """The bits set in over half the hashes; 0 for none."""
    table = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
    counts = np.unpackbits(table, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(body: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The bits set in over half the hashes of all word shingles; 0 without words."""
    return majority(shingle_hashes(body, shingle, seed))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``doc_id, d, tie, fp``: the fingerprint of each row as the 64 bits of a long."""
    small_batches(docs.sparkSession)

    @frugal
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch, _SLICE):
                found = [fingerprint(b, shingle, seed) for b in part.column("body").to_pylist()]
                prints = pa.array(np.array(found, np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], prints], ["doc_id", "d", "tie", "fp"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), *doc_key(docs))
    return rows.mapInArrow(work, "doc_id long, d long, tie int, fp long")


def segments(distance: int) -> list[tuple[int, int]]:
    """Shift and width of ``distance + 1`` segments that make up the 64 bits."""
    n = distance + 1
    edges = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def chain_places(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``key, place in fps, probe``: where each fingerprint waits and where it looks.

    At each start it waits under its own two segments, and looks under those in
    which one set bit of the second is cleared: of two that differ there in one
    bit, one has it set.
    """
    parts, keys, places, probes = segments(distance), [], [], []
    every = np.arange(len(fps))
    for i, (shift, width) in enumerate(parts):
        after, wide = parts[(i + 1) % len(parts)]
        head = (fps >> _U(shift)) & _U((1 << width) - 1)
        tail = (fps >> _U(after)) & _U((1 << wide) - 1)
        base = (_U(i) << _U(32)) | (head << _U(wide))
        keys.append(base | tail)
        places.append(every)
        probes.append(np.zeros(len(fps), bool))
        for bit in range(wide):
            has = (tail >> _U(bit)) & _U(1) == 1
            keys.append((base | (tail ^ _U(1 << bit)))[has])
            places.append(every[has])
            probes.append(np.ones(int(has.sum()), bool))
    return np.concatenate(keys), np.concatenate(places), np.concatenate(probes)


def chain_keys(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``key, fp, probe`` of every place."""
    keys, places, probes = chain_places(fps, distance)
    return keys, fps[places], probes


def linked(a: np.ndarray, b: np.ndarray, start: np.ndarray | int, distance: int) -> np.ndarray:
    """Whether the chain from segment ``start`` keeps its budget at every length; the last length is the distance."""
    parts = segments(distance)
    n = len(parts)
    differ = a ^ b
    bits = [np.bitwise_count((differ >> _U(s)) & _U((1 << w) - 1)) for s, w in parts]
    fits = np.zeros(differ.shape, bool)
    for i in range(n) if np.ndim(start) else [start]:
        total = np.zeros(differ.shape, np.uint8)
        ok = np.asarray(start == i) & np.ones(differ.shape, bool)
        for length in range(1, n + 1):
            total = total + bits[(i + length - 1) % n]
            ok &= total <= length * distance // n
        fits |= ok
    return fits


def star_edges(waiting: np.ndarray, looking: np.ndarray, start: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """The links of one key as stars: each fingerprint with the least it is linked to, directly or through others.

    That keeps every connection, with one row per fingerprint instead of one per pair.
    """
    nodes = np.concatenate([waiting, looking])
    labels = np.arange(len(nodes))
    changed = True
    while changed:
        changed = False
        for a in range(0, len(waiting), _BLOCK):
            rows = slice(a, min(a + _BLOCK, len(waiting)))
            for b in range(0, len(nodes), _BLOCK):
                cols = slice(b, b + _BLOCK)
                fits = linked(nodes[rows, None], nodes[None, cols], start, distance)
                low = np.where(fits, labels[None, cols], len(nodes)).min(axis=1)
                low = np.minimum(low, labels[rows])
                if (low < labels[rows]).any():
                    labels[rows] = low
                    changed = True
                low = np.where(fits, labels[rows, None], len(nodes)).min(axis=0)
                low = np.minimum(low, labels[cols])
                if (low < labels[cols]).any():
                    labels[cols] = low
                    changed = True
    moved = nodes != nodes[labels]
    return nodes[moved], nodes[labels][moved]


def _changes(groups: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return (groups[1:] != groups[:-1]) | (keys[1:] != keys[:-1])


def _key_edges(
    groups: np.ndarray, keys: np.ndarray, fps: np.ndarray, probes: np.ndarray, distance: int
) -> list[np.ndarray]:
    """Edges of whole groups, sorted. Small ones pair by pair for all at once, larger ones each in blocks."""
    out = []
    first = np.flatnonzero(np.append(True, _changes(groups, keys)))
    size = np.diff(np.append(first, len(keys)))
    starts = (keys[first] >> _U(32)).astype(np.int64)
    for n in range(2, 9):
        few = first[size == n]
        for i in range(n):
            for j in range(i + 1, n):
                a, b = few + i, few + j
                open_pair = ~(probes[a] & probes[b])
                a, b, at = a[open_pair], b[open_pair], starts[size == n][open_pair]
                fits = linked(fps[a], fps[b], at, distance)
                out.append(np.stack([fps[a][fits], fps[b][fits]]))
    for at, n, start in zip(first[size > 8], size[size > 8], starts[size > 8], strict=True):
        own, looks = fps[at : at + n], probes[at : at + n]
        if not looks.all():
            out.append(np.stack(star_edges(own[~looks], own[looks], int(start), distance)))
    return out


def links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``u, v``: links between different fingerprints (column ``fp``), enough to connect all that are connected."""

    @frugal
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, values, probes = chain_keys(batch.column(0).to_numpy().view(np.uint64), distance)
            table = [keys.view(np.int64), values.view(np.int64), probes]
            for at in range(0, len(keys), _LINK_ROWS):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x[at : at + _LINK_ROWS]) for x in table], ["key", "fp", "probe"]
                )

    @frugal
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def settle(whole: bool) -> pa.RecordBatch:
            nonlocal held
            groups, keys, fps, probes = (np.concatenate(x) for x in zip(*held, strict=True))
            # The last group may go on.
            end = len(keys) if whole else int(np.flatnonzero(np.append(True, _changes(groups, keys)))[-1])
            held = [[x[end:] for x in (groups, keys, fps, probes)]]
            none = [np.empty((2, 0), np.uint64)]
            found = _key_edges(groups[:end], keys[:end], fps[:end], probes[:end], distance) if end else []
            found = np.concatenate(none + found, 1)
            pairs = np.unique(np.stack([found.min(0, initial=2**64 - 1), found.max(0, initial=0)]), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(x.astype(np.uint64).view(np.int64)) for x in pairs], ["u", "v"])

        waiting = 0
        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            held.append([columns[0], columns[1].view(np.uint64), columns[2].view(np.uint64), columns[3]])
            waiting += batch.num_rows
            if waiting >= _LINK_ROWS:
                yield settle(whole=False)
                waiting = 0
        if held and sum(len(k) for _, k, *_ in held):
            yield settle(whole=True)

    keyed = distinct.select("fp").mapInArrow(spread, "key long, fp long, probe boolean")
    # Rows of a key that has more of them meet in every two of its blocks.
    large = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > KEY_ROWS)
    blocks = F.ceil(F.col("n") * 2 / KEY_ROWS).cast("int").alias("blocks")
    large = sized(written(large.select("key", blocks), "keys"))
    cut = keyed.join(large, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    cut = cut.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    cut = cut.select("key", "fp", "probe", "blocks", "block", other)
    # A key of one block is group 0; of two blocks the same ones meet each other where there are no others.
    one = (F.col("block") == F.col("other")) & (F.col("blocks") > 1)
    group = F.least("block", "other").cast("long") * F.col("blocks") + F.greatest("block", "other")
    groups = cut.where(~one).select(group.alias("group"), "key", "fp", "probe")
    met = groups.repartition("key", "group").sortWithinPartitions("key", "group")
    return met.mapInArrow(meet, "u long, v long")


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _to_least(edges: DataFrame, least: Column) -> DataFrame:
    """Each edge with ``m``, the least node around its ``u``."""
    around = edges.groupBy("u").agg(least.alias("m"))
    return edges.join(around, "u")


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the least node of its component, for every node of ``edges`` that is not one itself.

    Alternating stars: neighbours are hung on the least node around them, first
    the greater ones, then the lesser ones, until every component is a star.
    Each round is a table in the shared folder; nothing is collected.
    """
    current = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    while True:
        state = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0]  # two numbers
        if state == before:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
        large = _to_least(_both_ways(current), F.least(F.min("v"), F.col("u")))
        large = large.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _to_least(large, F.min("v"))
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        hung = small.union(large.groupBy("u").agg(F.min("v").alias("v")))
        current = written(hung.where("u <> v").distinct(), "stars")


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, distance: int = DISTANCE
) -> DataFrame:
    """``doc_id, fp, component_id``: one row per row of ``docs``.

    Fingerprints with at most ``distance`` differing bits are linked;
    ``component_id`` is the smallest doc_id that can be reached over links. Copies
    share a fingerprint, which is compared once. Rows without words have
    fingerprint 0 and are linked like any other. Null doc_ids stay null and are
    left out of the minimum; a component of nulls only has a null id. Repeated
    rows give repeated rows; other columns of ``docs`` are ignored.
    """
    if not 1 <= distance <= 15:
        raise ValueError("a distance of 1 to 15 bits")
    marked, rooted = _rooted(docs, shingle, seed, distance)
    ids = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = rooted.join(ids, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def _rooted(docs: DataFrame, shingle: int, seed: int, distance: int) -> tuple[DataFrame, DataFrame]:
    """The rows with their fingerprints; each fingerprint with its first row and its component's root."""
    marked = written(fingerprints(docs, shingle, seed), "fingerprints")
    first = marked.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.min(F.struct("d", "tie")).alias("first"))
    classes = written(first, "classes")
    roots = components(links(classes, distance))
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select(
        "fp", "doc_id", "first", F.coalesce("root", "fp").alias("root")
    )
    return marked, written(rooted, "roots")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, distance: int = DISTANCE) -> DataFrame:
    """One row of each component, with all columns: the one with the smallest doc_id, null ids last.

    Of rows that share that id the text's hash decides, of repeated rows any one stays.
    """
    return first_rows(docs, _rooted(docs, shingle, seed, distance)[1])


def first_rows(docs: DataFrame, rooted: DataFrame) -> DataFrame:
    """The first row of each root (``root, first``), with all columns."""
    kept = written(rooted.groupBy("root").agg(F.min("first").alias("first")).select("first.d", "first.tie"), "kept")
    d, tie, _ = doc_key(docs)
    keyed = docs.select(row_of(docs), d, tie)
    rows = keyed.join(kept, ["d", "tie"], "left_semi")
    number = F.row_number().over(Window.partitionBy("d", "tie").orderBy(F.lit(0)))
    return rows.withColumn("n", number).where("n = 1").select(*[F.col("row")[c].alias(c) for c in docs.columns])


def hex_digits(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
