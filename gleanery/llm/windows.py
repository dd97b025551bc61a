"""Windows of consecutive tokens, partitioned by minimisers.

A window's minimiser is the smallest hash of the short grams in it. Consecutive
windows that share one form a run and travel as one packed string to the bucket
of that minimiser: equal windows have equal minimisers, so they always meet. A
minimiser found so often that its runs would fill a bucket is split: its windows
travel by the smallest of their longer grams, where the scheme has such, and by
the hash of the whole window, one by one, where that is found as often.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import column_of, doc_key, frugal, mixed, pieces_of, ranges, small_batches
from gleanery.session import written

_U = np.uint64
_STEP = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_BACK = pow(_STEP, -1, 2**64)
BUCKET_BYTES = 8 << 20  # packed bytes a bucket holds on average
PART_BYTES = 3 << 19  # of which so many are worked on at a time
HOT_BYTES = 1 << 20  # packed bytes of one minimiser beyond which its windows travel alone
MOST_HOT = 2_000_000  # minimisers that are looked up as hot, at most: 16 MB


_CELL_BITS = 20  # of a minimiser, that tell which stand alone in a bucket
_FLUSH = 32 << 20  # packed bytes a task gathers before it compresses them by bucket


@dataclass(frozen=True)
class Scheme:
    """``read`` turns documents into token hashes; windows hold ``k`` tokens, grams ``m``."""

    read: Callable[[list[bytes]], Slice]
    k: int
    m: int
    within: bool  # whether an earlier start in the same document counts, or only another document
    spread: float  # packed bytes for each byte of text, roughly
    slice_bytes: int
    fine: int = 0  # tokens of the longer grams that split hot minimisers; 0: their windows travel alone at once


@dataclass
class Slice:
    """Documents one after the other: hashes of their tokens, tokens per document, and where bytes lie."""

    tokens: np.ndarray
    counts: np.ndarray
    data: np.ndarray
    at: np.ndarray | None  # first byte of each token and one past the end plus ``gap``; None: a token is a byte
    gap: int


@dataclass
class Runs:
    """Runs of windows, as one row each."""

    doc: np.ndarray
    start: np.ndarray  # token within the slice
    windows: np.ndarray
    low: np.ndarray  # the minimiser, or the hash of a window that travels alone


_POWERS: dict[int, np.ndarray] = {}  # the longest of each step


def powers(n: int, step: int) -> np.ndarray:
    """1, step, step**2, ... of ``n`` powers."""
    out = _POWERS.get(step)
    if out is None or len(out) < n:
        out = np.empty(1 << max(16, (int(n) - 1).bit_length()), np.uint64)
        out[0] = 1
        filled = 1
        while filled < len(out):
            more = min(filled, len(out) - filled)
            out[filled : filled + more] = out[:more] * _U(pow(step, filled, 2**64))
            filled += more
        _POWERS[step] = out
    return out[:n]


def gram_hashes(tokens: np.ndarray, m: int) -> np.ndarray:
    """A scrambled hash of every ``m`` consecutive tokens, by joining halves."""
    held, size, joined, length = tokens, 1, None, 0
    while True:
        if m & size:
            if joined is None:
                joined = held
            else:
                n = len(tokens) - length - size + 1
                if n <= 0:
                    return np.empty(0, np.uint64)
                joined = joined[:n] * _U(pow(_STEP, size, 2**64)) + held[length : length + n]
            length += size
        if length == m:
            return mixed(joined)
        if len(held) <= size:
            return np.empty(0, np.uint64)
        held = held[:-size] * _U(pow(_STEP, size, 2**64)) + held[size:]
        size *= 2


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values."""
    if len(values) < width:
        return values[:0]
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def runs_of(part: Slice, k: int, m: int) -> tuple[Runs, np.ndarray]:
    """The runs of all documents, and the gram hashes they were cut by."""
    grams = gram_hashes(part.tokens, m)
    low = sliding_min(grams, k - m + 1)
    if not len(low):
        none = np.empty(0, np.int64)
        return Runs(none, none, none, np.empty(0, np.uint64)), grams
    ends = np.cumsum(part.counts)
    first = ends - part.counts
    last = np.maximum(first, ends - k + 1)  # one past a document's last window
    cut = np.zeros(len(low) + 1, bool)
    cut[1:-1] = low[1:] != low[:-1]
    cut[np.minimum(first, len(low))] = True
    cut[np.minimum(last, len(low))] = True
    cut[0] = True
    starts = np.flatnonzero(cut[:-1])
    counts = np.diff(np.append(starts, len(low)))
    doc = np.searchsorted(first, starts, "right") - 1
    fits = starts < last[doc]
    starts, counts, doc = starts[fits], counts[fits], doc[fits]
    return Runs(doc, starts, counts, low[starts]), grams


def span_hashes(tokens: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """One hash for the tokens of each span, whatever stands before it."""
    sums = np.zeros(len(tokens) + 1, np.uint64)
    np.cumsum(tokens * powers(len(tokens), _STEP), out=sums[1:])
    return mixed((sums[start + length] - sums[start]) * powers(len(tokens) + 1, _BACK)[start] + length.astype(np.uint64))


def first_equal(data: np.ndarray, at: np.ndarray, size: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For each byte span the first span with the same bytes. Hashes propose, the bytes decide."""
    _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    same = first[inverse]
    later = np.flatnonzero(same != np.arange(len(same)))
    unequal = later[size[later] != size[same[later]]]
    same[unequal] = unequal
    later = np.setdiff1d(later, unequal, assume_unique=True)
    if len(later):
        lengths = size[later]
        differ = data[ranges(at[later], lengths)] != data[ranges(at[same[later]], lengths)]
        if differ.any():
            wrong = later[np.add.reduceat(differ, np.cumsum(lengths) - lengths) > 0]
            same[wrong] = wrong
    return same


def _parted(runs: Runs, hot: np.ndarray) -> tuple[Runs, Runs]:
    """The runs whose minimisers are not hot, and those whose are."""
    is_hot = np.zeros(len(runs.low), bool)
    if len(hot):
        place = np.minimum(np.searchsorted(hot, runs.low), len(hot) - 1)
        is_hot = hot[place] == runs.low
    return tuple(Runs(runs.doc[x], runs.start[x], runs.windows[x], runs.low[x]) for x in (~is_hot, is_hot))


def _together(some: Runs, others: Runs) -> Runs:
    order = np.lexsort((np.concatenate([some.start, others.start]), np.concatenate([some.doc, others.doc])))
    return Runs(*(np.concatenate([getattr(some, x), getattr(others, x)])[order] for x in ("doc", "start", "windows", "low")))


def _alone(part: Slice, runs: Runs, k: int, hot: np.ndarray) -> Runs:
    """Runs of hot minimisers cut into single windows, each known by its own hash."""
    cool, runs = _parted(runs, hot)
    if not len(runs.low):
        return cool
    start = ranges(runs.start, runs.windows)
    low = span_hashes(part.tokens, start, np.full(len(start), k))
    return _together(cool, Runs(np.repeat(runs.doc, runs.windows), start, np.ones(len(start), np.int64), low))


def _fine_runs(part: Slice, runs: Runs, k: int, fine: int) -> Runs:
    """The windows of ``runs`` as runs that share the smallest of their longer grams."""
    first, windows = _joined(runs)
    length = windows + k - 1
    base = np.cumsum(length) - length
    tokens = part.tokens[ranges(runs.start[first], length)]
    cut = runs_of(Slice(tokens, length, part.data, None, 0), k, fine)[0]
    return Runs(runs.doc[first][cut.doc], (runs.start[first] - base)[cut.doc] + cut.start, cut.windows, cut.low)


def _split(part: Slice, runs: Runs, k: int, fine: int, hot: np.ndarray, fine_hot: np.ndarray) -> Runs:
    """Runs of hot minimisers cut into shorter ones. How a window is cut depends on its own tokens only."""
    if not fine:
        return _alone(part, runs, k, hot)
    cool, runs = _parted(runs, hot)
    if not len(runs.low):
        return cool
    return _together(cool, _alone(part, _fine_runs(part, runs, k, fine), k, fine_hot))


def _joined(runs: Runs) -> tuple[np.ndarray, np.ndarray]:
    """Runs joined where they follow each other: which are the first ones, and with how many windows."""
    begins = np.ones(len(runs.doc), bool)
    begins[1:] = (runs.doc[1:] != runs.doc[:-1]) | (runs.start[1:] != runs.start[:-1] + runs.windows[:-1])
    first = np.flatnonzero(begins)
    return first, np.add.reduceat(runs.windows, first) if len(first) else runs.windows


def _settled_runs(runs: Runs, gone: np.ndarray) -> dict[str, np.ndarray]:
    """Runs that are gone, joined where they follow each other: which are the first ones, with how many windows."""
    first, many = _joined(Runs(runs.doc[gone], runs.start[gone], runs.windows[gone], runs.low[gone]))
    nothing = np.zeros(len(gone), np.int64)
    return {"first": first, "many": many, "size": nothing, "again": nothing}


def _planes(values: np.ndarray) -> bytes:
    """The bytes of all values, the lowest of each first: equal high bytes lie together."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def _unplanes(raw: memoryview, kind: type, n: int) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).view(kind).reshape(n)


_FIELDS = (("d", np.int64), ("tie", np.int32), ("start", np.int32), ("windows", np.int32), ("low", np.uint32),
           ("size", np.int32), ("again", np.uint8))


_NAMES = tuple(name for name, _ in _FIELDS)


_LEVEL = 4


def _pack(parts: list[tuple[dict[str, np.ndarray], bytes]], press: zstandard.ZstdCompressor | None = None) -> bytes:
    fields = {name: np.concatenate([f[name] for f, _ in parts]) for name in _NAMES}
    n = len(fields["d"])
    fields["d"] = np.diff(fields["d"], prepend=0)
    fields["size"] = fields["size"] - fields["windows"]  # where a token is a byte, nearly all alike
    raw = [n.to_bytes(4, "little"), *[_planes(fields[name]) for name in _NAMES], *[x for _, x in parts]]
    return (press or zstandard.ZstdCompressor(level=_LEVEL)).compress(b"".join(raw))


def _unpack(payload: bytes, press: zstandard.ZstdDecompressor) -> tuple[dict[str, np.ndarray], bytes]:
    raw = memoryview(press.decompress(payload))
    n, at, fields = int.from_bytes(raw[:4], "little"), 4, {}
    for name, kind in _FIELDS:
        width = n * np.dtype(kind).itemsize
        fields[name] = _unplanes(raw[at : at + width], kind, n)
        at += width
    fields["d"] = np.cumsum(fields["d"])
    fields["size"] = fields["size"] + fields["windows"]
    return fields, bytes(raw[at:])


def _in_company(low: np.ndarray, counted: np.ndarray) -> np.ndarray:
    """Which minimisers stand on several of the counted rows; by their low bits, so on too many rather than too few."""
    cell = low & np.uint32((1 << _CELL_BITS) - 1)
    return (np.bincount(cell[counted], minlength=1 << _CELL_BITS) > 1)[cell]


@dataclass
class Bucket:
    """All runs whose minimisers fall into one bucket, ordered by document and start."""

    d: np.ndarray
    tie: np.ndarray
    start: np.ndarray
    windows: np.ndarray
    low: np.ndarray
    again: np.ndarray  # its minimiser stands in it more than once
    at: np.ndarray
    size: np.ndarray
    data: np.ndarray

    @classmethod
    def parts(cls, payloads: list[bytes]) -> Iterator[Bucket]:
        """The bucket in parts of bounded size, no minimiser in two of them.

        A run whose minimiser no other run has equals none, and is left out.
        """
        press = zstandard.ZstdDecompressor()
        unpacked = [_unpack(p, press) for p in payloads]
        fields = {name: np.concatenate([f[name] for f, _ in unpacked]) for name in _NAMES}
        raw = b"".join(x for _, x in unpacked)
        del unpacked, payloads
        ends = np.cumsum(fields["size"], dtype=np.int64)
        use = np.flatnonzero((fields["size"] == 0) | (fields["again"] > 0) | _in_company(fields["low"], fields["size"] > 0))
        count = max(1, math.ceil(fields["size"][use].sum(dtype=np.int64) / PART_BYTES))
        part = fields["low"][use] % np.uint32(count)
        for i in range(count):
            rows = use[part == i]
            rows = rows[np.lexsort((fields["start"][rows], fields["tie"][rows], fields["d"][rows]))]
            size = fields["size"][rows].astype(np.int64)
            strings = [raw[e - n : e] for e, n in zip(ends[rows].tolist(), size.tolist(), strict=True)]
            own = {name: values[rows] for name, values in fields.items()} | {"size": size}
            yield cls(**own, at=np.cumsum(size) - size, data=np.frombuffer(b"".join(strings), np.uint8))

    def string(self, i: int) -> bytes:
        return self.data[self.at[i] : self.at[i] + self.size[i]].tobytes()


def _slices(scheme: Scheme, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, Slice]]:
    """Documents ordered by (d, tie), with their tokens."""
    for batch in batches:
        for rows in pieces_of(batch, scheme.slice_bytes):
            d, tie = (rows.column(i).to_numpy() for i in (0, 1))
            order = np.lexsort((tie, d))
            # Repeated rows are one document: of those that lie together one travels.
            d, tie = d[order], tie[order]
            first = np.append(True, (d[1:] != d[:-1]) | (tie[1:] != tie[:-1]))[: len(d)]
            bodies = rows.column(2).to_pylist()
            yield d[first], tie[first], scheme.read([bodies[i] for i in order[first]])


def _keyed(docs: DataFrame) -> DataFrame:
    d, tie, body = doc_key(docs)
    return docs.select(d, tie, body)


def hot_minimisers(
    keyed: DataFrame, scheme: Scheme, packed_bytes: int, within: np.ndarray | None = None
) -> tuple[np.ndarray, int]:
    """Minimisers whose runs fill HOT_BYTES, ascending, at most MOST_HOT; and how many runs those were counted on.

    ``within``: those of the longer grams, in windows of these minimisers.
    A task passes on those that fill half that share of its own runs, so it
    passes on a bounded number, and one that is hot overall is passed on by
    tasks holding at least half of it.
    """
    share = min(MOST_HOT, max(1, packed_bytes // HOT_BYTES))
    k, m, fine = scheme.k, scheme.m, scheme.fine
    known = None if within is None else keyed.sparkSession.sparkContext.broadcast(within)  # at most MOST_HOT numbers

    def minimisers(part: Slice) -> np.ndarray:
        runs = runs_of(part, k, m)[0]
        return runs.low if known is None else _fine_runs(part, _parted(runs, known.value)[1], k, fine).low

    @frugal
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.empty(0, np.uint64)
        times = np.empty(0, np.int64)
        total, waiting = 0, []

        def merge():
            nonlocal seen, times, waiting
            lows = np.concatenate([seen, *waiting])
            weights = np.concatenate([times, np.ones(len(lows) - len(seen), np.int64)])
            waiting = []
            seen, inverse = np.unique(lows, return_inverse=True)
            times = np.bincount(inverse, weights, len(seen)).astype(np.int64)
            keep = times * 2 * share >= total
            seen, times = seen[keep], times[keep]

        for _, _, part in _slices(scheme, batches):
            low = minimisers(part)
            total += len(low)
            waiting.append(low)
            if sum(map(len, waiting)) > 500_000:
                merge()
        merge()
        lows = pa.array([*seen.view(np.int64).tolist(), None], pa.int64())
        yield pa.RecordBatch.from_pydict({"low": lows, "n": pa.array([*times.tolist(), total], pa.int64())})

    counted = keyed.mapInArrow(count, "low long, n long").groupBy("low").agg(F.sum("n").alias("n"))
    counted = written(counted, "hot")
    total = counted.where("low is null").agg(F.sum("n")).collect()[0][0] or 0  # one number
    # Sums may miss half of what a hot minimiser has: half the share is enough. At most 2 * share rows.
    # The least number is worked out here: runs times bytes do not fit 64 bits from some gigabytes on.
    least = max(65, -(-total // (2 * share)), -(-HOT_BYTES * total // (2 * max(1, packed_bytes))))
    rows = counted.where(F.col("low").isNotNull() & (F.col("n") >= least))
    found = rows.toArrow()
    hot = np.sort(found.column("low").to_numpy().astype(np.int64).view(np.uint64))
    return hot, sum(found.column("n").to_pylist())


def removals(
    docs: DataFrame, scheme: Scheme, decide: Callable[[Bucket], tuple[np.ndarray, np.ndarray, np.ndarray]]
) -> DataFrame:
    """``d, tie, start, length``: spans of tokens to remove.

    ``decide`` gets a bucket and returns rows of it, offsets into them and numbers
    of windows found earlier. What a task itself sees twice needs no decision
    there and only passes through.
    """
    spark = docs.sparkSession
    small_batches(spark)
    total = docs.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    packed = int(total * scheme.spread)
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(4 * shuffled, packed // BUCKET_BYTES)
    keyed = _keyed(docs)
    k, m, within, fine = scheme.k, scheme.m, scheme.within, scheme.fine
    hot, runs = hot_minimisers(keyed, scheme, packed)
    fine_hot = hot[:0]
    if fine and len(hot):
        # Their windows as bytes of longer grams; half the runs may be missing from the number.
        windows = 2 * runs * (k - m + 2) // 2
        fine_hot, _ = hot_minimisers(keyed, scheme, windows * (3 * k - fine) // (k - fine + 2), hot)
    split = spark.sparkContext.broadcast((hot, fine_hot))  # at most MOST_HOT numbers each

    @frugal
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[np.ndarray, dict[str, np.ndarray], bytes]] = []
        held = 0
        for d, tie, part in _slices(scheme, batches):
            runs, grams = runs_of(part, k, m)
            runs = _split(part, runs, k, fine, *split.value)
            if not len(runs.doc):
                continue
            length = runs.windows + k - 1
            if part.at is None:
                at, size = runs.start, length
            else:
                at = part.at[runs.start]
                size = part.at[runs.start + length] - part.gap - at
            same = first_equal(part.data, at, size, span_hashes(part.tokens, runs.start, length))
            base = np.cumsum(part.counts) - part.counts
            local = runs.start - base[runs.doc]
            again = np.zeros(len(same), bool)
            if within:  # a repeated row is the same document: the same start in it is no earlier one
                gone = (
                    (d[runs.doc] != d[runs.doc[same]]) | (tie[runs.doc] != tie[runs.doc[same]]) | (local != local[same])
                )
                many = runs.windows + k - m
                hits = grams[ranges(runs.start, many)] == np.repeat(runs.low, many)
                again = np.add.reduceat(hits.astype(np.int32), np.cumsum(many) - many) > 1
            else:
                gone = d[runs.doc] > d[runs.doc[same]]
            fields = {
                "d": d[runs.doc], "tie": tie[runs.doc], "start": local, "windows": runs.windows,
                "low": (runs.low >> _U(40)).astype(np.uint32), "size": size, "again": again,
            }
            settled = _settled_runs(runs, gone)
            fields = {name: np.concatenate([v[~gone], settled.get(name, v)[gone][settled["first"]]]) for name, v in fields.items()}
            fields["windows"][np.count_nonzero(~gone) :] = settled["many"]
            at = np.concatenate([at[~gone], np.zeros(len(settled["many"]), np.int64)])
            size = fields["size"]
            # What is settled needs no company: any bucket will do, whatever it is a copy of.
            place = fields["d"].astype(np.uint64) * _U(_STEP) + fields["start"].astype(np.uint64)
            meets = np.concatenate([runs.low[~gone], place[np.count_nonzero(~gone) :]])
            bucket = (mixed(meets) % _U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            fields = {name: values[order].astype(kind) for (name, kind), values in zip(_FIELDS, map(fields.get, _NAMES), strict=True)}
            raw = part.data.tobytes()
            strings = [raw[x : x + n] for x, n in zip(at[order].tolist(), size[order].tolist(), strict=True)]
            waiting.append((bucket[order], fields, b"".join(strings)))
            held += int(size.sum()) + 20 * len(size)
            if held > _FLUSH:
                yield flush(waiting)
                held = 0
        if waiting:
            yield flush(waiting)

    def flush(waiting: list[tuple[np.ndarray, dict[str, np.ndarray], bytes]]) -> pa.RecordBatch:
        of = np.concatenate([bucket for bucket, _, _ in waiting])
        order = np.argsort(of, kind="stable")
        fields = {name: np.concatenate([f[name] for _, f, _ in waiting])[order] for name in _NAMES}
        edges = np.append(np.flatnonzero(np.diff(of[order], prepend=-1)), len(of))
        met = of[order[edges[:-1]]]
        spans = []  # of each bucket in the bytes of each slice
        for bucket, f, data in waiting:
            ends = np.append(0, np.cumsum(f["size"], dtype=np.int64))
            spans.append((data, *(ends[np.searchsorted(bucket, met, side)].tolist() for side in ("left", "right"))))
        press = zstandard.ZstdCompressor(level=_LEVEL)
        payloads = [
            _pack([({name: v[a:b] for name, v in fields.items()}, b"".join([s[x[i] : y[i]] for s, x, y in spans]))], press)
            for i, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
        ]
        waiting.clear()
        return pa.RecordBatch.from_pydict({"bucket": pa.array(met), "payload": pa.array(payloads, pa.binary())})

    @frugal
    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for payloads in _by_bucket(batches):
            for held in Bucket.parts(payloads):
                passed = np.flatnonzero(held.size == 0)
                rows, offsets, counts = decide(held)
                rows = np.concatenate([passed, rows])
                offsets = np.concatenate([np.zeros(len(passed), np.int64), offsets])
                counts = np.concatenate([held.windows[passed], counts])
                yield pa.RecordBatch.from_pydict(
                    {
                        "d": pa.array(held.d[rows]),
                        "tie": pa.array(held.tie[rows]),
                        "start": pa.array((held.start[rows] + offsets).astype(np.int64)),
                        "length": pa.array((counts + k - 1).astype(np.int64)),
                    }
                )

    sent = keyed.mapInArrow(send, "bucket long, payload binary")
    met = sent.repartition("bucket").sortWithinPartitions("bucket")
    # Written, as what travelled can then go: the texts are shuffled next.
    return written(met.mapInArrow(settle, "d long, tie int, start long, length long"), "spans")


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    """The payloads of one bucket after another; buckets lie together."""
    held, of = [], None
    for batch in batches:
        for bucket, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if bucket != of and held:
                yield held
                held = []
            of = bucket
            held.append(payload)
    if held:
        yield held


def distinct_runs(held: Bucket) -> tuple[np.ndarray, np.ndarray]:
    """Rows that hold a string, and for each the first row with the same string."""
    rows = np.flatnonzero(held.size)
    at, size = held.at[rows], held.size[rows]
    salted = mixed(np.arange(256, dtype=np.uint64) + _U(1))[held.data]
    return rows, rows[first_equal(held.data, at, size, span_hashes(salted, at, size))]


def covered(n: int, starts: list[int], lengths: list[int]) -> np.ndarray:
    """Which of ``n`` tokens lie in a span."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.add(starts, lengths), -1)
    return np.cumsum(steps[:-1]) > 0


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``doc_id, body, starts, lengths, rest``: each row of ``docs`` with its spans (null: none).

    ``rest`` holds the columns of the row besides the text.
    """
    rest = [column_of(docs, c) for c in docs.columns if c != "text"]
    left = docs.select(docs["doc_id"].cast("long").alias("doc_id"), *doc_key(docs), F.struct(*rest).alias("rest"))
    # A set: tasks that held repeats of a row found the same spans.
    right = spans.groupBy("d", "tie").agg(F.collect_set(F.struct("start", "length")).alias("spans"))
    return left.join(right, ["d", "tie"], "left").select(
        "doc_id", "body", F.col("spans.start").alias("starts"), F.col("spans.length").alias("lengths"), "rest"
    )
