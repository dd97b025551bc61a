"""Packing documents into windows with their lexical neighbours, found by a sharded BM25 index.

Texts are encoded once. What fills whole windows of a long document stays where
it is; the rest, shorter than a window, is dealt out by small sketches of its
tokens, so that documents with much in common come to one shard. A shard is
bounded and holds an inverted index of its documents, weighted with document
frequencies of the whole corpus. Each seed document asks it for unused
neighbours, which fill the seed's window in order of their score; the last is
cut where the window ends, and what is left of it is the next seed.
"""

from __future__ import annotations

import json
import math
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import frugal, mixed, pieces_of, ranges, small_batches, text_bytes
from gleanery.session import written

WINDOW = 2048
SHARD = 1024  # documents that share an index
K1, B = 1.2, 0.75
SKETCHES = 3  # least hashes that documents are dealt out by
TASK_TOKENS = 8 << 20  # tokens of the shards a task packs
_SLICE = 2 << 20
_OUT = 2_000  # pieces of a batch
_PART = 33  # bits of a number within a task
_U = np.uint64
_SHARDED = 1 << 62  # set in the ids of windows that shards fill

# Fixed value: white space, as the vocabulary's pre-tokenizer knows it.
_BEYOND = (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_WHITE = r"\t-\r " + "".join(map(chr, _BEYOND))
# A pre-token ends before a single space between words, whatever stands around them.
_CUT = re.compile(f"(?<=[^{_WHITE}]) (?=[^{_WHITE}])")
_STRETCH = 200_000  # characters encoded at a time


def _bytes_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of texts as the tokenizers library gives them for a byte-level vocabulary.

    Where the merges of the file are numbered in their order, tiktoken applies them,
    which gives the same ids in a third of the time; the library itself encodes
    texts with special strings, and everything if they are not.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        before, model = spec.get("pre_tokenizer") or {}, spec["model"]
        if spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space"):
            raise ValueError(f"{path}: a byte-level vocabulary without normaliser and prefix space is needed")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.size = self.library.get_vocab_size()
        self.kind = "H" if self.size <= 1 << 16 else "I"  # an unsigned short or int
        added = {t["content"] for t in spec.get("added_tokens", [])}
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        numbered = all(model["vocab"].get(a + b) == 256 + i for i, (a, b) in enumerate(merges))
        self.quick = None
        if numbered and before.get("use_regex", True) and not model.get("ignore_merges") and not model.get("dropout"):
            import tiktoken
            from public_tokenizers import PATTERN

            byte = _bytes_of()
            ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in added}
            self.quick = tiktoken.Encoding("merges", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _stretches(self, text: str) -> Iterator[str]:
        """A long text in parts that are encoded each for itself."""
        start = 0
        while len(text) - start > 2 * _STRETCH:
            cut = _CUT.search(text, start + _STRETCH)
            if not cut:
                break
            yield text[start : cut.start()]
            start = cut.start()
        yield text[start:]

    def encode(self, text: str) -> array:
        if self.special and self.special.search(text):
            return array(self.kind, self.library.encode(text, add_special_tokens=False).ids)
        out = array(self.kind)
        for part in self._stretches(text):
            if self.quick and len(part) <= 2 * _STRETCH:
                out += array(self.kind, self.quick.encode_ordinary(part))
            else:
                out += array(self.kind, self.library.encode(part, add_special_tokens=False).ids)
        return out


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def terms_of(rests: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, term and occurrences of every term in every rest, in order; the id that ends a document is no term."""
    sizes = np.array([max(0, len(x) - 1) for x in rests], np.int64)
    flat = np.concatenate([*(x[:-1] for x in rests), np.empty(0, np.uint32)]).astype(np.uint64)
    both, times = np.unique((np.repeat(np.arange(len(rests), dtype=np.uint64), sizes) << _U(32)) | flat, return_counts=True)
    return (both >> _U(32)).astype(np.int64), (both & _U((1 << 32) - 1)).astype(np.int64), times


@lru_cache(maxsize=2)
def _hashes(size: int) -> np.ndarray:
    """Hashes of every id, in rows."""
    out = np.empty((SKETCHES, size), np.uint64)
    row = np.arange(1, size + 1, dtype=np.uint64)
    for i in range(SKETCHES):
        row = out[i] = mixed(row)
    return (out >> _U(1)).view(np.int64)


def sketches(doc: np.ndarray, term: np.ndarray, n: int, size: int) -> np.ndarray:
    """The least hashes of each document's terms: equal with the chance that the sets share of their union."""
    out = np.full((SKETCHES, n), np.iinfo(np.int64).max)
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    if len(first):
        out[:, doc[first]] = np.minimum.reduceat(_hashes(size)[:, term], first, axis=1)
    return out


_TOKENS = 8 << 20  # tokens of the shards a task packs
_SLICE = 2 << 20
_OUT = 2_000  # pieces of a batch
_PART = 33  # bits of a number within a task
_U = np.uint64
_SHARDED = 1 << 62  # set in the ids of windows that shards fill

# Fixed value: white space, as the vocabulary's pre-tokenizer knows it.
_BEYOND = (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_WHITE = r"\t-\r " + "".join(map(chr, _BEYOND))
# A pre-token ends before a single space between words, whatever stands around them.
_CUT = re.compile(f"(?<=[^{_WHITE}]) (?=[^{_WHITE}])")
_STRETCH = 200_000  # characters encoded at a time


def _bytes_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of texts as the tokenizers library gives them for a byte-level vocabulary.

    Where the merges of the file are numbered in their order, tiktoken applies them,
    which gives the same ids in a third of the time; the library itself encodes
    texts with special strings, and everything if they are not.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        before, model = spec.get("pre_tokenizer") or {}, spec["model"]
        if spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space"):
            raise ValueError(f"{path}: a byte-level vocabulary without normaliser and prefix space is needed")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.size = self.library.get_vocab_size()
        self.kind = "H" if self.size <= 1 << 16 else "I"  # an unsigned short or int
        added = {t["content"] for t in spec.get("added_tokens", [])}
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        numbered = all(model["vocab"].get(a + b) == 256 + i for i, (a, b) in enumerate(merges))
        self.quick = None
        if numbered and before.get("use_regex", True) and not model.get("ignore_merges") and not model.get("dropout"):
            import tiktoken
            from public_tokenizers import PATTERN

            byte = _bytes_of()
            ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in added}
            self.quick = tiktoken.Encoding("merges", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _stretches(self, text: str) -> Iterator[str]:
        """A long text in parts that are encoded each for itself."""
        start = 0
        while len(text) - start > 2 * _STRETCH:
            cut = _CUT.search(text, start + _STRETCH)
            if not cut:
                break
            yield text[start : cut.start()]
            start = cut.start()
        yield text[start:]

    def encode(self, text: str) -> array:
        if self.special and self.special.search(text):
            return array(self.kind, self.library.encode(text, add_special_tokens=False).ids)
        out = array(self.kind)
        for part in self._stretches(text):
            if self.quick and len(part) <= 2 * _STRETCH:
                out += array(self.kind, self.quick.encode_ordinary(part))
            else:
                out += array(self.kind, self.library.encode(part, add_special_tokens=False).ids)
        return out


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def sketch(terms: np.ndarray, n: int = SKETCHES) -> list[int]:
    """The least of ``n`` hashes over different terms: equal with the chance that the sets share of their union."""
    hashes, out = terms.astype(np.uint64) + np.uint64(1), []
    for _ in range(n):
        hashes = mixed(hashes)
        out.append(int(hashes.min(initial=2**64 - 1) >> np.uint64(1)))
    return out


_TOKENS = "doc_id long, tokens long, ids binary, window long, place long, s1 long, s2 long, s3 long, term int, docs long"


def encoded(docs: DataFrame, path: str, end: int, window: int) -> DataFrame:
    """A row for each row of ``docs``, with all its ids, and rows ``term, docs`` that count what is left of them by term.

    ``window`` numbers the whole windows of a document, ``place`` its rest.
    """
    small_batches(docs.sparkSession)
    kinds = pa.schema(
        [(n, pa.binary() if t == "binary" else pa.int32() if t == "int" else pa.int64()) for n, t in (x.split() for x in _TOKENS.split(", "))]
    )

    @frugal
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        base = TaskContext.get().partitionId() << _PART
        windows = place = 0
        docs_of = np.zeros(encoder.size, np.int64)
        for batch in batches:
            for part in pieces_of(batch, _SLICE):
                coded = [encoder.encode(x.decode()) for x in part.column("body").to_pylist()]
                for ids in coded:
                    ids.append(end)
                n = np.array([len(ids) for ids in coded], np.int64)
                rests = [np.frombuffer(ids, encoder.kind)[len(ids) - len(ids) % window :] for ids in coded]
                doc, term, _ = terms_of(rests)
                docs_of += np.bincount(term, minlength=encoder.size)
                whole = n // window
                arrays = [
                    part.column("doc_id"),
                    pa.array(n),
                    pa.array([ids.tobytes() for ids in coded], pa.binary()),
                    pa.array(base + windows + np.cumsum(whole) - whole),
                    pa.array(base + place + np.arange(len(n))),
                    *map(pa.array, sketches(doc, term, len(n), encoder.size)),
                ]
                windows += int(whole.sum())
                place += len(n)
                none = [pa.nulls(part.num_rows, pa.int32()), pa.nulls(part.num_rows, pa.int64())]
                yield pa.RecordBatch.from_arrays([*arrays, *none], schema=kinds)
        seen = np.flatnonzero(docs_of)  # as many as the vocabulary has at most
        arrays = [pa.nulls(len(seen), kinds.field(n).type) for n in kinds.names[:8]]
        counts = [pa.array(seen.astype(np.int32)), pa.array(docs_of[seen])]
        yield pa.RecordBatch.from_arrays([*arrays, *counts], schema=kinds)

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_bytes(docs["text"]).alias("body"))
    return rows.mapInArrow(work, _TOKENS)


class Shard:
    """An inverted index over the rests of some documents, weighted by BM25."""

    def __init__(self, rests: list[np.ndarray], idf: np.ndarray, average: float):
        self.size = np.array([len(x) for x in rests], np.int64)
        doc, term, times = terms_of(rests)
        worth = idf[term] > 0  # others add nothing
        doc, term, times = doc[worth], term[worth], times[worth]
        norm = K1 * (1 - B + B * self.size / average)
        weight = idf[term] * (times * (K1 + 1)) / (times + norm[doc])
        self.known, code = np.unique(term, return_inverse=True)
        # The terms of each document, as numbers of the shard.
        self.terms, self.begin = code, np.searchsorted(doc, np.arange(len(rests) + 1))
        by = np.argsort(code, kind="stable")
        self.term, self.doc, self.weight = code[by], doc[by], weight[by]
        self._first()

    def _first(self) -> None:
        self.first = np.searchsorted(self.term, np.arange(len(self.known) + 1))

    def without(self, used: np.ndarray) -> None:
        """Drop the postings of documents that are used up."""
        kept = ~used[self.doc]
        self.term, self.doc, self.weight = self.term[kept], self.doc[kept], self.weight[kept]
        self._first()

    def scores(self, seed: int) -> np.ndarray:
        """The BM25 score of every document for the terms of one of them."""
        own = self.terms[self.begin[seed] : self.begin[seed + 1]]
        at = ranges(self.first[own], self.first[own + 1] - self.first[own])
        return np.bincount(self.doc[at], self.weight[at], len(self.size))


def fill(shard: Shard, window: int) -> Iterator[list[tuple[int, int, int]]]:
    """Windows as pieces: document, first token of its rest, tokens."""
    n = len(shard.size)
    used, begin = np.zeros(n, bool), np.zeros(n, np.int64)
    seed, following, unused, dropped = -1, 0, n, n
    while True:
        if seed < 0:
            while following < n and used[following]:
                following += 1
            if following == n:
                return
            seed = following
        if unused * 2 < dropped:
            shard.without(used)
            dropped = unused
        room, pieces, cut = window, [], -1

        def put(i: int, room: int) -> int:
            """Add a document, or what of it finds room; what is left then."""
            nonlocal cut, unused
            length = int(min(shard.size[i] - begin[i], room))
            pieces.append((i, int(begin[i]), length))
            begin[i] += length
            if begin[i] == shard.size[i]:
                used[i] = True
                unused -= 1
            else:
                cut = i
            return room - length

        room = put(seed, room)
        if room and unused:
            scores = shard.scores(seed)
            scores[used] = -1.0
            # As many as could fill the room if they were average, more of them as long as there is room.
            for i in _best_first(scores):
                room = put(int(i), room)
                if not room:
                    break
        yield pieces
        seed = cut


def _best_first(scores: np.ndarray, few: int = 16) -> Iterator[int]:
    """Unused documents by falling score, then in their order."""
    open_docs = np.flatnonzero(scores >= 0)
    values = scores[open_docs]
    if len(values) > few:
        edge = np.partition(values, len(values) - few)[len(values) - few]
        top = np.flatnonzero(values >= edge)
        yield from open_docs[top[np.argsort(-values[top], kind="stable")]]
        rest = np.flatnonzero(values < edge)
        yield from open_docs[rest[np.argsort(-values[rest], kind="stable")]]
    else:
        yield from open_docs[np.argsort(-values, kind="stable")]


_PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_KINDS = pa.schema([(x.split()[0], pa.binary() if x.endswith("binary") else pa.int64()) for x in _PIECES.split(", ")])


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(_KINDS)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _KINDS, strict=True)], schema=_KINDS)


def _wide(ids: np.ndarray) -> bytes:
    return ids.astype("<u4").tobytes()


def whole_windows(tokens: DataFrame, kind: str, window: int) -> DataFrame:
    """Windows that one document fills alone."""

    @frugal
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, n, ids, first in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                ids = np.frombuffer(ids, kind)
                for k in range(n // window):
                    out.append((doc_id, k * window, window, _wide(ids[k * window : (k + 1) * window]), n, first + k, 0))
                    if len(out) == _OUT:
                        yield _pieces(out)
                        out = []
            yield _pieces(out)

    long = tokens.where(F.col("tokens") >= window)
    return long.select("doc_id", "tokens", "ids", "window").mapInArrow(cut, _PIECES)


def packed(
    docs: DataFrame, path: str, end: int = 1, window: int = WINDOW, shard: int = SHARD, task_tokens: int = TASK_TOKENS
) -> DataFrame:
    """``doc_id, start, length, ids, doc_tokens, sequence_id, offset``: the pieces of all documents.

    A document is the ids of its text (byte-level vocabulary file ``path``, which
    every worker can read, no special tokens added) and the id ``end``; ``ids``
    are those of the piece as little-endian unsigned 32-bit numbers. Pieces of a
    ``sequence_id`` follow each other from ``offset`` 0 and hold ``window`` ids
    together, but for the last sequence of a shard. A null text counts as empty, a null doc_id
    stays null; repeated rows are packed each; other columns are ignored.
    """
    spark = docs.sparkSession
    encoder = _encoder(path)
    kind, size = encoder.kind, encoder.size
    table = written(encoded(docs, path, end, window), "tokens")
    counts = table.where("term is not null").groupBy("term").agg(F.sum("docs").alias("docs"))
    frequency = np.zeros(size, np.int64)
    for row in counts.collect():  # one number for each id of the vocabulary
        frequency[row["term"]] = row["docs"]
    tokens = table.where("term is null")
    rest = F.pmod("tokens", F.lit(window)).cast("int")
    rests = tokens.where(rest > 0)
    total, left = rests.agg(F.count("*"), F.sum(rest)).collect()[0]  # two numbers
    result = whole_windows(tokens, kind, window)
    if not total:
        return result
    idf = np.log((total - frequency + 0.5) / (frequency + 0.5)).clip(0)
    shared = spark.sparkContext.broadcast((idf, left / total))  # of the vocabulary's size

    @frugal
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, average = shared.value
        sequence = _SHARDED | TaskContext.get().partitionId() << _PART
        out: list[tuple] = []
        for ids, n, own in _shards(batches, shard):
            found = [np.frombuffer(x, kind) for x in own]
            for pieces in fill(Shard(found, idf, average), window):
                offset = 0
                for i, begin, length in pieces:
                    start = n[i] - len(found[i]) + begin
                    out.append((ids[i], start, length, _wide(found[i][begin : begin + length]), n[i], sequence, offset))
                    offset += length
                sequence += 1
                if len(out) >= _OUT:
                    yield _pieces(out)
                    out = []
        yield _pieces(out)

    width = np.dtype(kind).itemsize
    tail = F.substring(F.col("ids"), (F.col("tokens") - rest).cast("int") * width + 1, rest * width)
    rows = rests.select("doc_id", "tokens", tail.alias("ids"), "s1", "s2", "s3", "place")
    order = ("s1", "s2", "s3", "place")
    dealt = rows.repartitionByRange(math.ceil(left / task_tokens), *order).sortWithinPartitions(*order)
    return result.union(dealt.select("doc_id", "tokens", "ids").mapInArrow(pack, _PIECES))


def _shards(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list, list, list]]:
    """Rows in order, ``size`` at a time."""
    held: tuple[list, list, list] = ([], [], [])
    for batch in batches:
        for column, values in zip(held, (batch.column(i).to_pylist() for i in range(3)), strict=True):
            column.extend(values)
        while len(held[0]) >= size:
            yield tuple(x[:size] for x in held)
            held = tuple(x[size:] for x in held)
    if held[0]:
        yield held
