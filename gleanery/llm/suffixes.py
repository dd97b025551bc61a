"""Removal of byte strings that repeat across documents, by suffix arrays.

Windows of bytes are partitioned by minimisers. In a bucket, strings that share a
long gram are sorted by one suffix array, built by grouping: groups of suffixes
with the same Lyndon prefix are taken in descending order, previous-smaller
pointers lead from them to the suffixes they refine, and one pass over the
groups emits their order. Windows that are neighbours in it and equal get the
smallest document that holds them.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from gleanery.llm.common import frugal, mixed, pieces_of, ranges
from gleanery.llm.windows import (
    Bucket,
    Scheme,
    Slice,
    covered,
    distinct_runs,
    gram_hashes,
    removals,
    sliding_min,
    span_hashes,
    with_spans,
)

BYTES = 50  # bytes of a window
GRAM = 12  # bytes of the grams that choose a bucket
ANCHOR = 32  # bytes of the grams that strings of one suffix array share
_SLICE = 3 << 19
_PLACES = 16  # bits of a position within the strings of a bucket, at least
_SALTED = mixed(np.arange(256, dtype=np.uint64) + np.uint64(1))


def suffix_array(text: Sequence[int]) -> list[int]:
    """Starts of the suffixes of ``text`` in ascending order; a shorter one comes before what it begins."""
    n = len(text)
    symbols = np.asarray(text)
    order = np.argsort(symbols, kind="stable")
    inverse = np.empty(n, np.int64)
    inverse[order] = np.arange(n)
    ordered = symbols[order]
    starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if n else np.empty(0, np.int64)
    sizes = np.zeros(n, np.int64)
    sizes[starts] = np.diff(np.append(starts, n))
    group = np.empty(n, np.int64)
    group[order] = np.repeat(starts, sizes[starts])
    order, inverse, group, sizes = order.tolist(), inverse.tolist(), group.tolist(), sizes.tolist()
    smaller = [-1] * n  # previous suffix of a lower group

    last = n - 1
    while last >= 0:
        start = group[order[last]]
        if start == last:  # a group of one: most are
            s = order[last]
            p = s - 1
            while p >= 0 and group[p] > start:
                p = smaller[p]
            smaller[s] = p
            if p >= 0:
                home = group[p]
                left = sizes[home] - 1
                if left:
                    _to_end(order, inverse, p, home + left)
                    sizes[home] = left
                    group[p] = home + left
                    sizes[home + left] = 1
        else:
            times: dict[int, int] = {}
            for s in sorted(order[start : last + 1]):
                p = s - 1
                while p >= 0 and group[p] >= start:
                    p = smaller[p]
                smaller[s] = p
                if p >= 0:
                    times[p] = times.get(p, 0) + 1
            classes = defaultdict(list)
            for p, k in times.items():
                classes[k].append(p)
            for k in sorted(classes, reverse=True):  # more copies of a greater string: greater
                moved: dict[int, int] = {}
                for p in classes[k]:
                    home = group[p]
                    sizes[home] -= 1
                    _to_end(order, inverse, p, home + sizes[home])
                    moved[home] = moved.get(home, 0) + 1
                to = {home: home + sizes[home] for home in moved}
                for home, count in moved.items():
                    sizes[to[home]] = count
                for p in classes[k]:
                    group[p] = to[group[p]]
        last = start - 1

    filled = list(range(n))  # next free place of the group that starts there
    done = bytearray(n)
    for i in range(-1, n):
        p = (order[i] if i >= 0 else n) - 1
        while p >= 0 and not done[p]:
            done[p] = 1
            home = group[p]
            order[filled[home]] = p
            filled[home] += 1
            p = smaller[p]
    return order


def _to_end(order: list[int], inverse: list[int], p: int, end: int) -> None:
    """Swap a suffix to the end of its group."""
    here, other = inverse[p], order[end]
    order[here], inverse[other] = other, here
    order[end], inverse[p] = p, end


def read_bytes(bodies: list[bytes]) -> Slice:
    data = np.frombuffer(b"".join(bodies), np.uint8)
    return Slice(_SALTED[data], np.array([len(b) for b in bodies], np.int64), data, None, 0)


def _fragments(data: np.ndarray, sizes: np.ndarray, k: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Strings cut where the leftmost smallest gram of their windows moves: string, start, windows, gram, its hash."""
    grams = gram_hashes(_SALTED[data], anchor)
    places = np.arange(len(grams), dtype=np.uint64)
    bits = np.uint64(max(_PLACES, len(grams).bit_length()))  # room for every place; the rest is left to the hash
    low = sliding_min((grams >> bits << bits) | places, k - anchor + 1)
    ends = np.cumsum(sizes)
    first, last = ends - sizes, ends - k + 1
    cut = np.ones(len(low), bool)
    cut[1:] = low[1:] != low[:-1]
    cut[first] = True
    cut[last[last < len(low)]] = True
    starts = np.flatnonzero(cut)
    counts = np.diff(np.append(starts, len(low)))
    string = np.searchsorted(first, starts, "right") - 1
    fits = starts < last[string]
    starts, counts, string = starts[fits], counts[fits], string[fits]
    place = (low[starts] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    return string, starts, counts, place, grams[place]


def first_documents(
    strings: list[tuple[bytes, int, bytes]], owners: list[int], windows: np.ndarray, k: int
) -> np.ndarray:
    """For each window of each string, one after the other, the smallest owner of an equal window, by one suffix array.

    A string is (bytes before, number of the gram, bytes after), the gram being one
    symbol; ``k`` symbols make a window.
    """
    n = len(strings)
    raw = b"".join([part for before, _, after in strings for part in (before, b"\0", after, b"\0")])
    text = np.frombuffer(raw, np.uint8) + np.int64(n)
    grams = np.array([gram for _, gram, _ in strings])
    before = np.array([len(x) for x, _, _ in strings])
    sizes = before + np.array([len(x) for _, _, x in strings]) + 2
    begins = np.cumsum(sizes) - sizes
    text[begins + before] = n + 256 + grams
    text[begins + sizes - 1] = np.arange(n)[::-1]  # terminators fall, so that none is part of what precedes it
    holds = np.full(len(text), -1, np.int64)
    where = ranges(begins, windows)
    holds[where] = np.repeat(np.arange(n), windows)
    order = np.array(suffix_array(text))
    order = order[holds[order] >= 0]
    equal = np.ones(len(order) - 1, bool)
    alike = np.arange(len(order) - 1)  # neighbours with the same symbols so far
    for j in range(k):
        same = text[order[alike + 1] + j] == text[order[alike] + j]
        equal[alike[~same]] = False
        alike = alike[same]
    run = np.append(0, np.cumsum(~equal))
    least = np.full(run[-1] + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, run, np.array(owners)[holds[order]])
    result = np.empty(len(text), np.int64)
    result[order] = least[run]
    return result[where]


def _spread(values: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """Whether rows with the same value have different owners."""
    _, group = np.unique(values, return_inverse=True)
    least = np.full(group.max(initial=-1) + 1, np.iinfo(np.int64).max)
    most = np.full(len(least), np.iinfo(np.int64).min)
    np.minimum.at(least, group, owners)
    np.maximum.at(most, group, owners)
    return (least < most)[group]


def shared_windows(held: Bucket, k: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, offsets and counts of the windows of a bucket that a document with a smaller id holds too."""
    rows, first = distinct_runs(held)
    whole = rows[held.d[rows] > held.d[first]]
    kept = rows[rows == first]
    kept = kept[_spread(held.low[kept], held.d[kept])]
    found, offsets, counts = _settled(held, kept, k, anchor)
    # The same string elsewhere in the same document shares its verdict.
    twins = np.flatnonzero((rows != first) & (held.d[rows] == held.d[first]))
    twins = twins[np.argsort(first[twins], kind="stable")]
    begins, ends = (np.searchsorted(first[twins], found, side) for side in ("left", "right"))
    many = ends - begins
    return (
        np.concatenate([whole, found, rows[twins[ranges(begins, many)]]]),
        np.concatenate([np.zeros(len(whole), np.int64), offsets, np.repeat(offsets, many)]),
        np.concatenate([held.windows[whole], counts, np.repeat(counts, many)]),
    )


def _settled(held: Bucket, kept: np.ndarray, k: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, offsets and numbers of windows that stand in a smaller document, for different strings."""
    nothing = (np.empty(0, np.int64),) * 3
    if not len(kept):
        return nothing
    sizes = held.size[kept]
    data = held.data[ranges(held.at[kept], sizes)]
    base = np.cumsum(sizes) - sizes
    string, start, count, place, grams = _fragments(data, sizes, k, anchor)
    owner = held.d[kept[string]]
    shared = _spread(grams, owner)
    string, start, count, place, owner = (x[shared] for x in (string, start, count, place, owner))
    if not len(start):
        return nothing
    # Unequal hashes tell unequal windows: strings without one that another document may hold are left out.
    hashes = span_hashes(_SALTED[data], ranges(start, count), np.full(count.sum(), k))
    shared = np.logical_or.reduceat(_spread(hashes, np.repeat(owner, count)), np.cumsum(count) - count)
    if not shared.any():
        return nothing
    string, start, count, place, owner = (x[shared] for x in (string, start, count, place, owner))
    raw = data.tobytes()
    numbers: dict[bytes, int] = {}
    texts: dict[tuple[bytes, int, bytes], int] = {}
    least: list[int] = []
    windows: list[int] = []
    members: list[int] = []
    for a, c, p, d in zip(start.tolist(), count.tolist(), place.tolist(), owner.tolist(), strict=True):
        gram = numbers.setdefault(raw[p : p + anchor], len(numbers))
        key = (raw[a:p], gram, raw[p + anchor : a + c + k - 1])
        i = texts.setdefault(key, len(texts))
        if i == len(least):
            least.append(d)
            windows.append(c)
        elif d < least[i]:
            least[i] = d
        members.append(i)
    strings = list(texts)
    held_by = np.bincount([gram for _, gram, _ in strings], minlength=len(numbers))
    earliest = np.repeat(least, windows)
    ends = np.cumsum(windows)
    several = [i for i, (_, gram, _) in enumerate(strings) if held_by[gram] > 1]
    if several:
        many = np.array(windows)[several]
        earliest[ranges(ends[several] - many, many)] = first_documents(
            [strings[i] for i in several], [least[i] for i in several], many, k - anchor + 1
        )
    gone = earliest[ranges(ends[members] - count, count)] < np.repeat(owner, count)
    edge = np.zeros(len(gone) + 1, bool)  # where another string begins
    edge[np.append(0, np.cumsum(count))] = True
    begins = np.flatnonzero(gone & (edge[:-1] | ~np.append(False, gone[:-1])))
    after = np.flatnonzero(gone & (edge[1:] | ~np.append(gone[1:], False))) + 1
    of = np.repeat(np.arange(len(count)), count)[begins]
    offset = (start - base[string] - np.cumsum(count) + count)[of] + begins
    return kept[string[of]], offset, after - begins


def remove_shared_bytes(docs: DataFrame, k: int = BYTES, m: int = GRAM, anchor: int = ANCHOR) -> DataFrame:
    """``doc_id, kept binary, n_bytes, n_removed, n_spans, rest``: one row per row of ``docs``.

    Texts are UTF-8 bytes. A byte goes if it is covered by a string of ``k`` bytes
    that also starts in a document with a smaller doc_id; strings never cross
    documents and are judged on the input. ``kept`` are the other bytes (a cut may
    fall inside a character), ``n_spans`` the maximal runs removed, ``rest`` a
    struct of the other columns of ``docs``. A null, empty or short text loses
    nothing. Null doc_ids come last in the order and count as one id. Rows that
    share a doc_id never remove from each other, and repeated rows all get the
    same result.
    """
    if not 1 <= m <= anchor <= k:
        raise ValueError("grams are at most as long as anchors, anchors as windows")
    spread = (k + (k - m) / 2) / ((k - m + 2) / 2)
    scheme = Scheme(read_bytes, k, m, within=False, spread=spread, slice_bytes=_SLICE, fine=anchor)
    joined = with_spans(docs, removals(docs, scheme, partial(shared_windows, k=k, anchor=anchor)))

    @frugal
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch, _SLICE):
                kept, sizes, removed, runs = [], [], [], []
                for body, starts, lengths in zip(*(part.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                    sizes.append(len(body))
                    count = 0
                    if starts:
                        gone = covered(len(body), starts, lengths)
                        count = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
                        body = np.frombuffer(body, np.uint8)[~gone].tobytes()
                    kept.append(body)
                    removed.append(sizes[-1] - len(body))
                    runs.append(count)
                numbers = [pa.array(x, pa.int64()) for x in (sizes, removed, runs)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(kept, pa.binary()), *numbers, part.column("rest")],
                    ["doc_id", "kept", "n_bytes", "n_removed", "n_spans", "rest"],
                )

    schema = StructType([StructField("doc_id", LongType()), StructField("kept", BinaryType())])
    for name in ("n_bytes", "n_removed", "n_spans"):
        schema.add(name, LongType())
    return joined.mapInArrow(keep, schema.add("rest", joined.schema["rest"].dataType))


def cut_text(docs: DataFrame, k: int = BYTES, m: int = GRAM, anchor: int = ANCHOR) -> DataFrame:
    """``docs`` with all their columns, ``text`` without what was removed; a null text becomes an empty one.

    What a cut leaves of a character is left out as well.
    """
    cut = remove_shared_bytes(docs, k, m, anchor)

    @frugal
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [b.decode(errors="ignore") for b in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), batch.column(1)], ["text", "rest"])

    schema = StructType([StructField("text", StringType()), cut.schema["rest"]])
    named = cut.select("kept", "rest").mapInArrow(decode, schema)
    return named.select(*["text" if c == "text" else F.col("rest")[c].alias(c) for c in docs.columns])
