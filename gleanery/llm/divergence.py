"""How the wording of sources differs, by sorting pointers to the starts of their words.

A task keeps its texts in Arrow buffers and only sorts pointers to where words
start: a multikey quicksort that takes eight bytes as one character. Equal runs
of the sorted pointers are a word; how many documents and which sources they lie
in is read off the run. Only one row for each word and source of a slice leaves it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.common import frugal, pieces_of, small_batches, text_bytes
from gleanery.session import written

LEAST_DOCS = 10  # documents of a language that must hold a term
TOP = 10  # terms reported of each source
SCALE = 9  # decimal digits of a probability
BUCKET_ROWS = 100_000  # rows of terms that are compared at a time
_SLICE = 6 << 20
_CELLS = 1 << 20  # terms times sources held as one table
_WIDE = 8

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_LETTER = np.zeros(256, bool)
_LETTER[0x80:] = True
_LETTER[ord("A") : ord("Z") + 1] = _LETTER[ord("a") : ord("z") + 1] = True


def word_starts(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of every run of letters (A-Z, a-z and all beyond ASCII)."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], _LETTER[data], [False]]).view(np.int8)))
    return edges[::2], edges[1::2] - edges[::2]


def _wide_characters(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, depth: int) -> np.ndarray:
    """The eight bytes at ``depth`` of each word as one number, the first highest; zeros beyond its end."""
    left = np.clip(lengths - depth, 0, _WIDE)
    at = np.minimum(starts + depth, len(data) - _WIDE)
    low = np.lib.stride_tricks.as_strided(data, (len(data) - _WIDE + 1, _WIDE), (1, 1))[at]
    values = np.ascontiguousarray(low).view(">u8").reshape(-1).astype(np.uint64)
    drop = ((_WIDE - left) * 8).astype(np.uint64)
    return np.where(left > 0, values >> np.minimum(drop, np.uint64(63)) << np.minimum(drop, np.uint64(63)), np.uint64(0))


def sort_pointers(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the words by their bytes, equal ones in the order they came, and where each run of equals begins.

    A multikey quicksort: words are split by their next character of eight bytes,
    those that share it go one character deeper, if any of them is longer.
    ``data`` must have eight bytes behind the last word.
    """
    order = np.arange(len(starts))
    head = np.zeros(len(starts), bool)
    if not len(starts):
        return order, np.flatnonzero(head)
    head[0] = True
    open_places = np.arange(len(starts))  # places of the order that are not settled yet
    group = np.zeros(len(starts), np.int64)  # of equal words so far, for each open place
    depth = 0
    while len(open_places):
        words = order[open_places]
        key = _wide_characters(data, starts[words], lengths[words], depth)
        if depth == 0:
            by = np.argsort(key, kind="stable")
        else:
            by = np.lexsort((key, group))
        order[open_places] = words[by]
        key, group = key[by], group[by]
        new = np.append(True, (key[1:] != key[:-1]) | (group[1:] != group[:-1]))
        head[open_places[new]] = True
        depth += _WIDE
        group = np.cumsum(new) - 1
        # A run goes on only if it has several words and one of them is longer.
        size = np.bincount(group)
        longer = np.bincount(group, lengths[order[open_places]] > depth) > 0
        more = ((size > 1) & longer)[group]
        open_places, group = open_places[more], group[more]
    return order, np.flatnonzero(head)


def slice_counts(rows: pa.RecordBatch) -> pa.RecordBatch:
    """``lang, source, term, n, docs`` of a slice (``lang, source, body``); a row without term for each group met."""
    lang, source = rows.column(0).dictionary_encode(), rows.column(1).dictionary_encode()
    codes = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
    rows = rows.take(pa.array(np.argsort(codes, kind="stable")))
    codes = np.sort(codes, kind="stable")
    body = rows.column(2)
    sizes = pc.binary_length(body).to_numpy().astype(np.int64)
    # One buffer with a gap behind each text, so that no word reaches into the next.
    ends = np.cumsum(sizes + 1)
    raw = pa.compute.binary_join(pa.ListArray.from_arrays([0, len(body)], body), b" ")[0].as_buffer() if len(body) else b""
    data = np.empty(len(raw) + 1 + _WIDE, np.uint8)
    data[: len(raw)] = _LOWER[np.frombuffer(raw, np.uint8)]
    data[len(raw) :] = 32
    starts, lengths = word_starts(data)
    document = np.searchsorted(ends, starts, "right")
    order, runs = sort_pointers(data, starts, lengths)
    # Equal words come in the order of the texts, which lie by group.
    of = document[order]
    run = np.zeros(len(order), bool)
    run[runs] = True
    new_document = run | (np.diff(of, prepend=-1) != 0)
    group = codes[of]
    new_row = np.flatnonzero(run | (np.diff(group, prepend=-1) != 0))
    counts = np.diff(np.append(new_row, len(order)))
    documents = np.add.reduceat(new_document.astype(np.int64), new_row) if len(new_row) else counts
    first = order[new_row]
    at, size = starts[first], lengths[first]
    text_ends = np.cumsum(size)
    where = np.repeat(at - (text_ends - size), size) + np.arange(text_ends[-1] if len(size) else 0)
    offsets = np.append(0, text_ends).astype(np.int32)
    terms = pa.Array.from_buffers(pa.string(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data[where])])
    met = np.unique(codes)
    whose = np.concatenate([met, group[new_row]])
    none = np.zeros(len(met), np.int64)
    return pa.RecordBatch.from_arrays(
        [
            lang.dictionary.take(pa.array(whose // len(source.dictionary))),
            source.dictionary.take(pa.array(whose % len(source.dictionary))),
            pa.concat_arrays([pa.nulls(len(met), pa.string()), terms]),
            pa.array(np.concatenate([none, counts])),
            pa.array(np.concatenate([none, documents])),
        ],
        ["lang", "source", "term", "n", "docs"],
    )


def term_counts(docs: DataFrame, least_docs: int) -> DataFrame:
    """``lang, source, term, n``: occurrences of each kept term; a null term for each group, with or without terms."""
    small_batches(docs.sparkSession)

    @frugal
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in pieces_of(batch, _SLICE):
                held.append(part)
                size += pc.sum(pc.binary_length(part.column("body"))).as_py() or 0
                if size >= _SLICE:
                    yield slice_counts(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                    held, size = [], 0
        if sum(x.num_rows for x in held):
            yield slice_counts(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    rows = docs.select(
        F.coalesce(docs["lang"], F.lit("")).alias("lang"),
        F.coalesce(docs["source"], F.lit("")).alias("source"),
        text_bytes(docs["text"]).alias("body"),
    )
    found = rows.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    # One shuffle serves the sums of sources and of the language: a slice has one row for each term and source.
    met = found.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_lang = F.sum("docs").over(Window.partitionBy("lang", "term"))  # as many rows as sources
    kept = met.withColumn("docs", of_lang).where(F.col("term").isNull() | (F.col("docs") >= least_docs))
    return kept.select("lang", "source", "term", "n")


def probabilities(counts: np.ndarray, total: np.ndarray, digits: int = SCALE) -> np.ndarray:
    """1 + floor(10**digits * counts / total), exactly, digit by digit; no count is larger than its total."""
    rest, out = counts.astype(np.int64), np.zeros(np.broadcast(counts, total).shape, np.int64)
    for _ in range(digits):
        rest = rest * 10
        digit = rest // total
        out = out * 10 + digit
        rest = rest - digit * total
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _numbers(column: pa.ChunkedArray) -> pa.DictionaryArray:
    return pa.concat_arrays([*column.chunks, pa.array([], column.type)]).dictionary_encode()


_RESULT = "lang string, source string, part string, item string, value long"


def compare(terms: pa.Table, sources: pa.Table, top: int) -> pa.Table:
    """Of one bucket of a language's terms: each source's sums against the others, and its ``top`` terms."""
    lang = (sources if len(sources) else terms).column("lang")[0].as_py()
    names = sources.column("source").to_pylist()
    order = sorted(range(len(names)), key=lambda i: names[i].encode())
    names = [names[i] for i in order]
    sums = sources.column("total").to_numpy()[order]
    kinds = int(sources.column("kinds")[0].as_py())
    n = len(names)
    of_source = sums + 2 * kinds
    of_lang = np.int64(sums.sum() + 2 * kinds)
    pairs = np.zeros((n, n), np.int64)
    numbered = _numbers(terms.column("term"))
    words, code = numbered.dictionary.to_pylist(), numbered.indices.to_numpy()
    numbered, known = _numbers(terms.column("source")), {x: i for i, x in enumerate(names)}
    place = np.array([known[x] for x in numbered.dictionary.to_pylist()], np.int64)[numbered.indices.to_numpy()]
    count = terms.column("n").to_numpy()
    by_code = np.argsort(code, kind="stable")
    code, place, count = code[by_code], place[by_code], count[by_code]
    block = max(1, _CELLS // max(1, n))
    best: list[list[tuple[int, str]]] = [[] for _ in names]
    for a in range(0, len(words), block):
        rows = slice(*np.searchsorted(code, (a, a + block)))
        held = np.zeros((min(block, len(words) - a), n), np.int64)
        held[code[rows] - a, place[rows]] = count[rows]
        p = probabilities(held + 2, of_source[None, :])
        q = probabilities(held.sum(axis=1) + 2, np.array([of_lang]))
        for i in range(n):
            pairs[i] += divergence(p[:, i : i + 1], p).sum(axis=0)
            over = np.flatnonzero((held[:, i] > 0) & (p[:, i] > q))
            value = divergence(p[over, i], q[over])
            if len(over) > top:
                edge = -np.partition(-value, top - 1)[top - 1]
                over, value = over[value >= edge], value[value >= edge]  # with all ties
            found = [(-int(v), words[a + int(k)]) for k, v in zip(over, value, strict=True)]
            best[i] = sorted(best[i] + found, key=lambda x: (x[0], x[1].encode()))[:top]
    out = [(lang, names[i], "pair", names[j], int(pairs[i, j])) for i in range(n) for j in range(n) if i != j]
    out += [(lang, names[i], "term", word, -value) for i in range(n) for value, word in best[i]]
    columns = list(zip(*out, strict=True)) or [()] * 5
    return pa.table(
        [pa.array(c, pa.int64() if k == 4 else pa.string()) for k, c in enumerate(columns)],
        ["lang", "source", "part", "item", "value"],
    )


def audit(
    docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """``lang, source, part, item, value, rank``: how far the wording of each source of a language is from others.

    Terms are runs of letters and of characters beyond ASCII, with A-Z in lower
    case; a language keeps the terms of ``least_docs`` of its documents. In part
    ``pair`` the item is another source of the language and the value adds up
    (p - q)^2 / (p + q) over all terms, in part ``term`` it is a term more
    frequent in the source than in the language, the ``top`` ones of each source.
    A null text, language or source is an empty string; ids are not read, and each
    of several equal rows counts; other columns are ignored. A language without
    kept terms has pairs of value 0, one with a single source has none.

    The result has a row for each pair of sources of a language. Terms are compared
    in buckets of bounded size, each with the sources of its language.
    """
    counted = written(term_counts(docs, least_docs), "terms")
    terms = counted.where("term is not null").select("lang", "source", "term", "n")
    kinds = counted.where("term is not null").groupBy("lang", "term").agg(F.count("*")).groupBy("lang").agg(F.count("*").alias("kinds"))
    totals = terms.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("rows"))
    groups = counted.where("term is null").select("lang", "source").join(totals, ["lang", "source"], "left")
    sizes = groups.groupBy("lang").agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))
    sizes = sizes.join(kinds, "lang", "left").select(
        "lang",
        F.coalesce("kinds", F.lit(0)).alias("kinds"),
        F.ceil(F.greatest("rows", F.lit(1)) / bucket_rows).cast("int").alias("buckets"),
    )
    sizes = written(sizes, "languages")
    # Every bucket of a language gets its sources, with their totals.
    sources = groups.join(sizes, "lang").select(
        "lang",
        F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)).alias("bucket"),
        "source",
        F.coalesce("total", F.lit(0)).alias("total"),
        "kinds",
    )
    most = int(sizes.agg(F.max("buckets")).collect()[0][0] or 1)  # one number
    spread = F.pmod(F.xxhash64("term"), F.lit(most)).cast("int")
    # A language of few rows has few buckets; its terms fall evenly into them.
    placed = terms.join(sizes.select("lang", "buckets"), "lang").select(
        "lang", F.pmod(spread, F.col("buckets")).alias("bucket"), "source", "term", "n"
    )

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        return compare(left, right, top)

    # Names of their own: both sides come from the same tables.
    left, right = (x.select(*[F.col(c).alias(c) for c in x.columns]) for x in (placed, sources))
    parts = left.groupBy("lang", "bucket").cogroup(right.groupBy("lang", "bucket")).applyInArrow(meet, _RESULT)
    pairs = parts.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ranked = pairs.unionByName(parts.where("part = 'term'"))
    place = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    number = F.row_number().over(place)
    result = ranked.withColumn("rank", number).where((F.col("part") == "pair") | (F.col("rank") <= top))
    return result
