"""Similarity joins, exact, without comparing everything with everything.

Copies are folded first: pairs are between distinct values, and a second table
lists which rows carry each value. A value held by a third of the rows is then
one row here, and the result stays whole without listing copies against each
other.

Vectors fall into cells around pivots, cells of many vectors into cells again; a
vector also visits the cells its angle can reach, so that every pair meets in
one cell. A cell where that would spare too little stays whole. Texts meet in an index of their rarest characters: two texts as
similar as asked share some of the first ones of each. What meets is compared in
blocks of bounded size, one side held, the other passing by.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.functions import fixed
from gleanery.session import sized, written

PIVOTS = 16  # cells that a cell is split into
LEVELS = 4  # times a cell is split: with PIVOTS, the bound on the pivots in memory
BLOCK_ROWS = 4096  # vectors of a block at least
BLOCKS = 24  # of a cell, while they fit BLOCK_BYTES: each vector passes by half of them
BLOCK_BYTES = 16_000_000  # of a block's vectors, in double precision
_MOVED = 256  # comparisons that cost as much as one row that is moved
_PRODUCTS = 4_000_000  # cosines held at a time
RANKED = 65_536  # most frequent characters (with their number in the text) that are known by rank
_GROWTH = (1_000, 100_000)  # texts from which on one more common character is asked for
_WAITING = 200_000  # rows of small groups compared at a time


def copies(table: DataFrame, key: str, value: str) -> DataFrame:
    """Each row with the lowest id that has the same value: ``key, rep``."""
    reps = distinct_values(table, key, value).select(value, "rep")
    return table.where(F.col(value).isNotNull()).join(reps, value).select(key, "rep")


def distinct_values(table: DataFrame, key: str, value: str) -> DataFrame:
    """``rep`` (lowest id), ``value`` and ``copies`` (number of rows), one row per distinct value."""
    return (
        table.where(F.col(value).isNotNull())
        .groupBy(value)
        .agg(F.min(key).alias("rep"), F.count("*").alias("copies"))
    )


def _in_blocks(rows: DataFrame, block_rows: int) -> DataFrame:
    """Rows (``cell, home, rep, ...``) as ``cell, block, held, rep, ...``: where each is held, and where it passes by.

    A cell's home rows are held in blocks; they pass by half of the other blocks of
    their cell, the next ones in a ring, visitors by all of them. Every two blocks
    meet in one of them, and none has all rows pass by. Rows of one block meet in it.
    """
    counts = rows.where("home").groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > block_rows)
    counts = counts.withColumn("blocks", F.ceil(F.col("n") / block_rows).cast("int")).drop("n")
    rest = [c for c in rows.columns if c not in ("cell", "home")]
    # Most cells are one block and not in this table.
    placed = rows.join(sized(written(counts, "cells")), "cell", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.when(F.col("home"), F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).otherwise(F.lit(-1))
    placed = placed.withColumn("own", own)
    # Of an even number the block opposite is met by the lower half only.
    half = F.floor((F.col("blocks") - F.when(2 * F.col("own") >= F.col("blocks"), 1).otherwise(0)) / 2)
    last = F.when(F.col("home"), half).otherwise(F.col("blocks") - 1).cast("int")
    next_ones = F.transform(F.sequence(F.lit(0), last), lambda k: F.pmod(F.greatest("own", F.lit(0)) + k, F.col("blocks")))
    spread = placed.select("cell", "own", *rest, F.explode(next_ones).alias("block"))
    return spread.select("cell", "block", (F.col("own") == F.col("block")).alias("held"), *rest)


def _meet(rows: DataFrame, compare: Callable[[pd.DataFrame, pd.DataFrame, bool], pd.DataFrame], schema: str) -> DataFrame:
    """The results of ``compare(held, passing, same)`` for every block: held rows among themselves and with those passing by.

    A block's held rows stay in memory, the others pass in batches.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, held, closed = None, [], None
        for batch in batches:
            changes = np.flatnonzero(
                np.diff(batch["cell"].to_numpy(), prepend=0) | np.diff(batch["block"].to_numpy(), prepend=0)
            ) if len(batch) else []
            for a, b in zip([0, *[x for x in changes if x]], [*[x for x in changes if x], len(batch)], strict=True):
                part = batch.iloc[a:b]
                if not len(part):
                    continue
                group = (part["cell"].iloc[0], part["block"].iloc[0])
                if group != of:
                    if held:
                        own = pd.concat(held)
                        yield compare(own, own, True)
                    of, held, closed = group, [], None
                stays = part["held"].to_numpy()
                if stays.any():
                    held.append(part[stays])
                if not stays.all():
                    if closed is None:
                        closed = pd.concat(held) if held else part.iloc[:0]
                        if held:
                            yield compare(closed, closed, True)
                            held = []
                    if len(closed):
                        yield compare(closed, part[~stays], False)
        if held:
            own = pd.concat(held)
            yield compare(own, own, True)

    # Held rows come first in their block.
    met = rows.repartition("cell", "block").sortWithinPartitions("cell", "block", F.desc("held"))
    return met.mapInPandas(work, schema)


def _unit(rows: list) -> np.ndarray:
    """Rows scaled to length one; a zero row stays zero."""
    rows = np.stack(rows).astype("float64")
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    with np.errstate(invalid="ignore"):
        return np.divide(rows, norm, out=np.zeros_like(rows), where=norm != 0)


def _reach(part: pd.DataFrame, anchors: np.ndarray, far: float) -> tuple[np.ndarray, np.ndarray]:
    """Where each row is at home (row by place), and where it goes, that place included.

    What is at home around p lies, for every other pivot, on p's side of the plane
    between the two. A vector further than ``far`` beyond one of these planes
    is near nothing there.
    """
    apart = np.linalg.norm(anchors[:, None] - anchors[None], axis=2)
    np.fill_diagonal(apart, np.inf)
    near_to = _unit(list(part["vec"])) @ anchors.T
    near = near_to.argmax(axis=1)
    places = np.arange(len(anchors))
    reach = np.stack([((near_to - near_to[:, i : i + 1]) / apart[i]).max(axis=1) <= far for i in places], axis=1)
    home = part["home"].to_numpy()
    # Of two cells the rows of the higher one visit the lower one.
    reach &= ~home[:, None] | (places <= near[:, None])
    return home[:, None] & (places == near[:, None]), reach


def _far(limit: float) -> float:
    return math.sin(limit) + 1e-6


def _cost(homes: int, visitors: int, block_rows: int) -> float:
    """Comparisons in a cell, and the rows moved for them counted as comparisons."""
    blocks = -(-homes // block_rows)
    return homes * (homes / 2 + visitors) + _MOVED * (homes * (blocks // 2 + 1) + visitors * blocks)


def _worth_it(rows: DataFrame, pivots: dict[int, np.ndarray], limit: float, block_rows: int) -> dict[int, np.ndarray]:
    """The cells whose split saves a quarter of their cost at least. Their rows are counted by place, not moved."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)  # at most PIVOTS ** LEVELS vectors
    far = _far(limit)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for batch in batches:
            out = []
            for cell, part in batch.groupby("cell", sort=False):
                at_home, reach = _reach(part, known[cell], far)
                out.append((cell, -1, int(part["home"].sum()), int((~part["home"]).sum())))  # -1: as it is
                counts = zip(at_home.sum(axis=0).tolist(), (reach & ~at_home).sum(axis=0).tolist(), strict=True)
                out.extend((cell, place, homes, visitors) for place, (homes, visitors) in enumerate(counts))
            yield pd.DataFrame(out, columns=["cell", "place", "homes", "visitors"])

    found = rows.mapInPandas(work, "cell long, place int, homes long, visitors long")
    found = found.groupBy("cell", "place").agg(F.sum("homes").alias("homes"), F.sum("visitors").alias("visitors"))
    now, split = Counter(), Counter()
    for r in found.collect():  # a row for each pivot and cell
        (now if r["place"] < 0 else split)[r["cell"]] += _cost(r["homes"], r["visitors"], block_rows)
    return {cell: anchors for cell, anchors in pivots.items() if 4 * split[cell] <= 3 * now[cell]}


def _split(rows: DataFrame, pivots: dict[int, np.ndarray], limit: float) -> DataFrame:
    """Rows in the cells around their cell's pivots: each at home with the nearest, visiting lower ones it can reach."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)  # at most PIVOTS ** LEVELS vectors
    far = _far(limit)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for batch in batches:
            for cell, part in batch.groupby("cell", sort=False):
                at_home, reach = _reach(part, known[cell], far)
                row, place = np.nonzero(reach)
                out = part.iloc[row].assign(cell=cell * PIVOTS + place + 1)
                yield out.assign(home=at_home[row, place])

    return rows.mapInPandas(work, rows.schema)


def _cells(items: DataFrame, limit: float, block_rows: int) -> DataFrame:
    """``cell, home, rep, vec``: every two vectors within ``limit`` of each other meet in exactly one cell.

    A cell of more than ``block_rows`` vectors is split where that pays: among vectors that reach
    most pivots each would be copied to most cells, with nothing ruled out.
    """
    open_rows = items.select(F.lit(0).cast("long").alias("cell"), F.lit(True).alias("home"), "rep", "vec")
    done = None
    for _ in range(LEVELS if 2 * limit < math.pi else 0):
        picks = [F.min_by("vec", F.xxhash64("rep", F.lit(i))).alias(f"p{i}") for i in range(PIVOTS)]
        chosen = open_rows.where("home").groupBy("cell").agg(F.count("*").alias("n"), *picks).where(F.col("n") > block_rows)
        pivots = {r["cell"]: np.unique(_unit(list(r[2:])), axis=0) for r in chosen.collect()}  # at most PIVOTS ** LEVELS vectors
        if pivots:
            pivots = _worth_it(open_rows.where(F.col("cell").isin(list(pivots))), pivots, limit, block_rows)
        if not pivots:
            break
        large = F.col("cell").isin(list(pivots))  # at most PIVOTS ** LEVELS cells
        settled = open_rows.where(~large)
        done = settled if done is None else done.unionByName(settled)
        open_rows = written(_split(open_rows.where(large), pivots, limit), "cells")
    return open_rows if done is None else done.unionByName(open_rows)


def _block_rows(items: DataFrame) -> int:
    """Vectors of a block: enough that a cell has no more than BLOCKS blocks, as far as BLOCK_BYTES allow."""
    n, size = items.agg(F.count("*"), F.max(F.size("vec"))).first()
    return max(BLOCK_ROWS, min(-(-n // BLOCKS), BLOCK_BYTES // (8 * max(size or 1, 1))))


def cosine_pairs(
    vectors: DataFrame,
    threshold: float = fixed.SIMILARITY_THRESHOLD,
    key: str = "vec_id",
    vector: str = "embedding",
    block_rows: int | None = None,
) -> DataFrame:
    """Ordered pairs of distinct vectors with cosine above ``threshold``: ``id_a, id_b, cosine``.

    Each pair is computed once, in double precision, and given in both orders.
    Cells of more than ``block_rows`` vectors (by default as ``_block_rows`` says) are
    split around pivots, and angles to these rule out what cannot be near; where they
    rule out little a cell stays whole and is compared block by block. Which vectors
    serve as pivots changes the work, never the result. Below a cosine of 0 nothing
    can be ruled out.
    Vectors are of one length; one that is not finite is similar to none.
    """
    id_type = vectors.schema[key].dataType.simpleString()
    pair_schema = f"id_a {id_type}, id_b {id_type}, cosine double"
    items = distinct_values(vectors, key, vector).select("rep", F.col(vector).alias("vec"))
    size = F.aggregate("vec", F.lit(0.0), lambda total, x: total + x.cast("double") * x)
    finite = F.forall("vec", lambda x: ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    # A zero vector has cosine 0 with everything: pairs of it only below 0, where no cells are made.
    items = written(items.where(finite & (F.lit(threshold < 0) | (size > 0))), "vectors")
    block_rows = block_rows or _block_rows(items)
    limit = math.acos(max(-1.0, min(1.0, threshold))) + 1e-6
    rows = _in_blocks(_cells(items, limit if threshold >= 0 else math.pi, block_rows), block_rows)

    def compare(held: pd.DataFrame, passing: pd.DataFrame, same: bool) -> pd.DataFrame:
        a, b = _unit(list(held["vec"])), _unit(list(passing["vec"]))
        ids_a, ids_b = held["rep"].to_numpy(), passing["rep"].to_numpy()
        out = [pd.DataFrame({"id_a": ids_a[:0], "id_b": ids_b[:0], "cosine": np.zeros(0)})]
        step = max(1, min(512, _PRODUCTS // max(len(b), 1)))
        for start in range(0, len(a), step):
            product = a[start : start + step] @ b.T
            i, j = np.nonzero(product > threshold)
            score = product[i, j]
            i = i + start
            if same:
                i, j, score = i[i < j], j[i < j], score[i < j]
            out.append(pd.DataFrame({"id_a": ids_a[i], "id_b": ids_b[j], "cosine": score}))
        return pd.concat(out, ignore_index=True)

    found = _meet(rows, compare, pair_schema)
    return found.select(
        F.explode(
            F.array(
                F.struct("id_a", "id_b", "cosine"),
                F.struct(F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b"), "cosine"),
            )
        ).alias("pair")
    ).select("pair.*")


class Needs:
    """What texts of given lengths must share to have a ratio above ``threshold``."""

    def __init__(self, threshold: float):
        self.threshold = threshold
        self.matches = lru_cache(maxsize=100_000)(self._matches)
        self.least_partner = lru_cache(maxsize=100_000)(self._least_partner)

    def above(self, matches: int, total: int) -> bool:
        return (2.0 * matches / total if total else 1.0) > self.threshold

    def _matches(self, total: int) -> int:
        """The fewest matching characters for a ratio above the threshold; over half of ``total`` if none will do."""
        m = max(0, int(self.threshold * total / 2) - 1)
        while m <= total and not self.above(m, total):
            m += 1
        return m

    def _least_partner(self, size: int) -> int:
        """The length of the shortest text, up to this long, whose characters could be enough."""
        t = self.threshold
        n = max(0, int(t * size / (2 - t)) - 2) if t < 2 else size + 1
        while n <= size and not self.above(n, n + size):
            n += 1
        return n

    def common(self, size: int) -> int:
        """Characters such a text shares with any partner, one of its own length or more included."""
        return self.matches(size + self.least_partner(size))

    def short(self, asked: int) -> int:
        """The longest text that may share fewer than ``asked`` characters with a partner, and may have one; -1 for none."""
        if self.threshold <= 0:
            return 1 << 60
        n = int(asked * (2 - self.threshold) / self.threshold) + 2
        while n >= 0 and (self.least_partner(n) > n or self.common(n) >= asked):
            n -= 1
        return n


def _characters(text: str) -> list[tuple[str, int]]:
    """Each character with its number among its equals, so that common ones of two texts are a set's."""
    seen: Counter[str] = Counter()
    out = []
    for c in text:
        seen[c] += 1
        out.append((c, seen[c]))
    return out


def _frequent(items: DataFrame, ranked: int) -> list[tuple[str, int]]:
    """The most frequent numbered characters, the most frequent last."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter[tuple[str, int]] = Counter()
        for batch in batches:
            for text in batch["text"]:
                counts.update(_characters(text))
                if len(counts) > 4 * ranked:  # rare ones have no rank in any case
                    counts = Counter(dict(counts.most_common(2 * ranked)))
        rows = [(c, k, n) for (c, k), n in counts.items()]
        yield pd.DataFrame(rows, columns=["c", "k", "n"])

    found = items.select("text").mapInPandas(count, "c string, k int, n long").groupBy("c", "k").agg(F.sum("n").alias("n"))
    top = found.orderBy(F.desc("n"), "c", "k").limit(ranked).collect()  # at most RANKED
    return [(r["c"], r["k"]) for r in reversed(top)]


def _codes(text: str, rank: dict[tuple[str, int], int]) -> list[int]:
    """A text's numbered characters as ascending numbers, rare ones first."""
    return sorted(rank[x] if x in rank else -1 - (ord(x[0]) << 32 | x[1]) for x in _characters(text))


def _signature(codes: tuple[int, ...]) -> int:
    return hash((len(codes), *codes))


def asked_for(texts: int) -> int:
    """Common characters that two texts are brought together by: more of them among more texts."""
    return 1 + sum(texts >= n for n in _GROWTH)


def candidate_rows(items: DataFrame, threshold: float, asked: int) -> DataFrame:
    """``cell, home, rep, text, codes, alone``: the index. Texts of a cell share ``asked`` of their rare characters.

    Two texts that share ``o`` characters share the first ``asked`` of them among the
    first ``size - o + asked`` of each, rare ones first. Texts so short that they
    share fewer are met by one (``alone``). Below a threshold of 0 all texts are in one cell.
    """
    rank = {x: i for i, x in enumerate(_frequent(items, RANKED))} if threshold >= 0 else {}
    shared = items.sparkSession.sparkContext.broadcast(rank)  # at most RANKED
    needs = Needs(threshold)
    short = needs.short(asked)
    reach = short if short < 0 or threshold <= 0 else int(short * (2 - threshold) / threshold) + 1

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        needs, rank = Needs(threshold), shared.value
        for batch in batches:
            out = []
            for rep, text in zip(batch["rep"], batch["text"], strict=True):
                size = len(text)
                if threshold < 0:
                    out.append((0, True, rep, text, [], False))
                    continue
                if needs.least_partner(size) > size:
                    continue  # no partner will do
                codes, least = _codes(text, rank), needs.common(size)
                for alone in (False, True):
                    k = 1 if alone else asked
                    if (size > reach) if alone else (size <= short):
                        continue
                    front = codes[: size - least + k]
                    for cell in {_signature(x) for x in combinations(front, k)}:
                        out.append((cell, True, rep, text, front, alone))
                if len(out) > 20_000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            yield pd.DataFrame(out, columns=names)

    names = ["cell", "home", "rep", "text", "codes", "alone"]
    id_type = items.schema["rep"].dataType.simpleString()
    schema = f"cell long, home boolean, rep {id_type}, text string, codes array<long>, alone boolean"
    # A cell of single characters and one of several never share a number, but rows of both kinds could by chance.
    return items.select("rep", "text").mapInPandas(work, schema)


def string_ratio_pairs(
    table: DataFrame, key: str, text: str, threshold: float = fixed.SIMILARITY_THRESHOLD, block_rows: int = 1024
) -> DataFrame:
    """Ordered pairs of distinct texts with gestalt ratio above ``threshold``: ``id_a, id_b, ratio``.

    Matching characters are never more than the texts have in common. From that
    follow the lengths that can be partners and how many characters they share;
    texts meet in an index of the rarest of these. Each pair is looked at in one
    place only, and few pairs are left to the matcher. Both orders are computed,
    as the ratio depends on the order.
    """
    id_type = table.schema[key].dataType.simpleString()
    items = distinct_values(table, key, text).select("rep", F.col(text).cast("string").alias("text"))
    items = written(items, "texts")
    asked = asked_for(items.count())
    rows = _in_blocks(candidate_rows(items, threshold, asked), block_rows)
    short = Needs(threshold).short(asked)

    def compare(held: pd.DataFrame, passing: pd.DataFrame, same: bool) -> pd.DataFrame:
        from difflib import SequenceMatcher

        needs, found = Needs(threshold), []
        columns = ["cell", "rep", "text", "codes", "alone"]
        others = [(*row, Counter(row[2])) for row in zip(*(passing[c] for c in columns), strict=True)]
        sizes = np.array([len(x[2]) for x in others])
        order = np.argsort(sizes, kind="stable")
        sizes = sizes[order]
        for i, (cell, rep, one, codes, alone) in enumerate(zip(*(held[c] for c in columns), strict=True)):
            size, own, characters = len(one), set(codes), Counter(one)
            low = needs.least_partner(size) if threshold > 0 else 0
            for j in order[np.searchsorted(sizes, low) :].tolist():
                _, other, two, front, other_alone, counts = others[j]
                total = size + len(two)
                if (same and i >= j) or alone != other_alone or not needs.above(min(size, len(two)), total):
                    continue
                if threshold >= 0:
                    if alone and min(size, len(two)) > short:
                        continue  # they meet by several characters
                    k = 1 if alone else asked
                    common = [x for x in front if x in own][:k]
                    if len(common) < k or _signature(tuple(common)) != cell:
                        continue  # met elsewhere
                    if (characters & counts).total() < needs.matches(total):
                        continue
                for x, y, a, b in ((rep, other, one, two), (other, rep, two, one)):
                    ratio = SequenceMatcher(None, a, b).ratio()
                    if ratio > threshold:
                        found.append((x, y, ratio))
        return pd.DataFrame(found, columns=["id_a", "id_b", "ratio"])

    return _meet(rows, compare, f"id_a {id_type}, id_b {id_type}, ratio double")
