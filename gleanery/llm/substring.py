"""Removal of repeated word windows by super-k-mer partitioning.

Consecutive windows that share a minimiser travel as one packed string to its
bucket. There equal strings fall to the earliest; the rest are cut into windows
and sorted, which counts every window exactly. A window whose words also start
earlier covers words that go.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gleanery.llm.common import frugal, mixed, pieces_of, words_of
from gleanery.llm.windows import Bucket, Scheme, Slice, covered, distinct_runs, removals, span_hashes, with_spans

WORDS = 20  # words of a window
GRAM = 5  # words of a gram
_SLICE = 3 << 20
_BLANK = 0x20
_SPACE = np.zeros(256, bool)
_SPACE[[*range(0x09, 0x0E), _BLANK]] = True
_SALTED = mixed(np.arange(256, dtype=np.uint64) + np.uint64(1))


def read_words(bodies: list[bytes]) -> Slice:
    data = np.frombuffer(b" ".join([*bodies, b""]), np.uint8)
    space = _SPACE[data]
    kept = ~space
    kept[1:] |= ~space[:-1]  # one white space after each word stays
    ends = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    limits = np.cumsum(np.fromiter(map(len, bodies), np.int64, len(bodies)) + 1)
    data, space = data[kept], space[kept]
    data[space] = _BLANK
    at = np.append(0, np.flatnonzero(space) + 1)
    return Slice(
        span_hashes(_SALTED[data], at[:-1], np.diff(at) - 1),
        np.diff(np.searchsorted(ends, limits), prepend=0),
        data,
        at,
        1,
    )


def earlier_windows(held: Bucket, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, offsets and counts of the windows of a bucket that also start earlier."""
    rows, first = distinct_runs(held)
    later = (held.d[rows] != held.d[first]) | (held.tie[rows] != held.tie[first]) | (held.start[rows] != held.start[first])
    whole = rows[later]
    kept = rows[rows == first]
    _, group, members = np.unique(held.low[kept], return_inverse=True, return_counts=True)
    open_rows = kept[(members[group] > 1) | (held.again[kept] > 0)]
    windows = []
    for row in open_rows.tolist():
        words = held.string(row).split(b" ")
        where = (int(held.d[row]), int(held.tie[row]), int(held.start[row]))
        for i in range(int(held.windows[row])):
            windows.append((b" ".join(words[i : i + k]), where[0], where[1], where[2] + i, row, i))
    windows.sort()
    single, before = [], (None,) * 4
    for window in windows:
        if window[0] != before[0]:
            before = window[:4]
        elif window[:4] != before:
            single.append(window[4:])
    found = np.array(single, np.int64).reshape(-1, 2)
    return (
        np.concatenate([whole, found[:, 0]]),
        np.concatenate([np.zeros(len(whole), np.int64), found[:, 1]]),
        np.concatenate([held.windows[whole], np.ones(len(found), np.int32)]),
    )


def remove_repeats(docs: DataFrame, k: int = WORDS, m: int = GRAM) -> DataFrame:
    """``doc_id, kept, n_words, n_removed``: one row per row of ``docs``.

    Words are runs of ``[^\\x20\\x09-\\x0D]``. A word goes if a window of ``k``
    words that covers it has the same words as one that starts earlier: in a
    smaller doc_id, or earlier in the same document. ``kept`` are the other words,
    joined by one space. A null, empty or short text loses nothing but its white
    space. Null doc_ids come last in the order. Rows that share a doc_id but not
    the text are ordered by a hash of the text; wholly repeated rows are one
    document and all get its result. Other columns of ``docs`` are ignored.
    """
    if not 1 <= m <= k:
        raise ValueError("a gram has at least one word and at most those of a window")
    scheme = Scheme(read_words, k, m, within=True, spread=3.0, slice_bytes=_SLICE)
    spans = removals(docs, scheme, partial(earlier_windows, k=k))

    @frugal
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch, _SLICE):
                kept, counts, removed = [], [], []
                for body, starts, lengths in zip(*(part.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                    words = words_of(body)
                    counts.append(len(words))
                    if starts:
                        gone = covered(len(words), starts, lengths)
                        words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                    kept.append(b" ".join(words).decode())
                    removed.append(counts[-1] - len(words))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(kept), pa.array(counts, pa.int64()), pa.array(removed, pa.int64())],
                    ["doc_id", "kept", "n_words", "n_removed"],
                )

    return with_spans(docs, spans).drop("rest").mapInArrow(keep, "doc_id long, kept string, n_words long, n_removed long")
