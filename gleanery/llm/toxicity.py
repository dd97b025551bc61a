"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols: insult, threat, target, negation, reported speech, other.
Small transducers over these symbols are composed into one. It reads a clause
and adds up weights: an insult counts more near a target and less after a
negation or in reported speech; a threat counts only with a target. Insults are
learned from labels as words and word beginnings; how clause scores make a
probability is fitted on other labelled rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import pieces_of, small_batches, text_bytes

SAMPLE = 20_000  # labelled rows learned from, at most
ENTRIES = 20_000  # learned words and beginnings, at most
SUPPORT = 4  # toxic documents that must hold an entry
LEAST_WEIGHT = 1.0  # log odds from which an entry is an insult
BEGINNINGS = (4, 5, 6, 7)  # letters of the beginnings that are learned
_SLICE = 4 << 20

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = "other", "insult", "threat", "target", "negation", "report"

# Closed word classes of four languages.
WORDS = {
    THREAT: "kill hurt beat destroy smash burn töten schlagen zerstören tuer frapper détruire matar golpear destruir",
    TARGET: "you your yours du dich dein ihr euch tu toi vous votre te tú usted ustedes vosotros",
    NEGATION: "not never no isn't aren't don't nicht kein keine nie ne pas jamais nunca ningún ninguna",
    REPORT: "said says wrote quoted reported called sagte schrieb dit écrit cité dijo escribió citó",
}
_CLASS = {word: kind for kind, words in WORDS.items() for word in words.split()}
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_CLAUSE_END = (".", "!", "?", ";", ":")


@dataclass
class Transducer:
    """Arcs ``(state, symbol) -> (state, symbol put out, weight)``; a missing arc keeps state and symbol.

    A weight is a pair: what is added, and the factor on the word's own strength.
    """

    start: str
    arcs: dict[tuple[str, str], tuple[str, str, tuple[float, float]]] = field(default_factory=dict)

    def step(self, state: str, symbol: str) -> tuple[str, str, tuple[float, float]]:
        return self.arcs.get((state, symbol), (state, symbol, (0.0, 1.0)))

    def states(self) -> set[str]:
        return {self.start} | {s for s, _ in self.arcs} | {a[0] for a in self.arcs.values()}


def compose(first: Transducer, second: Transducer, symbols: tuple[str, ...]) -> Transducer:
    """One machine that does what ``second`` does to the output of ``first``: additions add, factors multiply."""
    out = Transducer(f"{first.start}+{second.start}")
    waiting, seen = [(first.start, second.start)], set()
    while waiting:
        a, b = pair = waiting.pop()
        if pair in seen:
            continue
        seen.add(pair)
        for symbol in symbols:
            a2, middle, (add1, by1) = first.step(a, symbol)
            b2, last, (add2, by2) = second.step(b, middle)
            out.arcs[f"{a}+{b}", symbol] = (f"{a2}+{b2}", last, (add1 + add2, by1 * by2))
            waiting.append((a2, b2))
    return out


def _fading(name: str, trigger: str, reach: int, effects: Mapping[str, tuple[str, tuple[float, float]]]) -> Transducer:
    """After ``trigger`` the next ``reach`` symbols are under its effect: symbol -> (symbol put out, weight)."""
    machine = Transducer(f"{name}0")
    for left in range(reach + 1):
        state = f"{name}{left}"
        for symbol in (OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT):
            after = f"{name}{reach}" if symbol == trigger else f"{name}{max(left - 1, 0)}"
            put, weight = effects.get(symbol, (symbol, (0.0, 1.0))) if left else (symbol, (0.0, 1.0))
            machine.arcs[state, symbol] = (after, put, weight)
    return machine


SYMBOLS = (OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT)


def grammar() -> Transducer:
    """Reported speech, then negation, then targets, then what insults and threats themselves are worth."""
    reported = _fading("r", REPORT, 12, {INSULT: (INSULT, (0.0, 0.4)), THREAT: (OTHER, (0.0, 0.0))})
    negated = _fading("n", NEGATION, 3, {INSULT: (INSULT, (0.0, 0.3)), THREAT: (OTHER, (0.0, 0.0))})
    targeted = _fading("t", TARGET, 5, {INSULT: (INSULT, (1.0, 1.2)), THREAT: (INSULT, (2.0, 1.0))})
    followed = _fading("i", INSULT, 4, {TARGET: (TARGET, (0.5, 1.0)), INSULT: (INSULT, (0.3, 1.0))})
    return compose(compose(compose(reported, negated, SYMBOLS), targeted, SYMBOLS), followed, SYMBOLS)


@lru_cache(maxsize=1)
def _machine() -> tuple[dict, str]:
    machine = grammar()
    return machine.arcs, machine.start


def clause_score(symbols: list[tuple[str, float]]) -> float:
    """What the grammar gives a clause of (symbol, strength); strengths of other words are 0."""
    arcs, state = _machine()
    score = 0.0
    for symbol, strength in symbols:
        state, put, (add, by) = arcs[state, symbol]
        if put == INSULT or put == TARGET:
            score += add + by * strength
    return score


def bare(word: str) -> str:
    return _EDGES.sub("", word.lower())


def beginnings(word: str) -> list[str]:
    """The learned forms of a word: itself, and its beginnings, marked by a star."""
    return [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) >= n)]


class Lexicon(dict):
    """Symbol and strength of each written word; filled as words come, emptied when large."""

    def __init__(self, learned: Mapping[str, float]):
        self.learned = learned

    def __missing__(self, written: str) -> tuple[str, float]:
        if len(self) > 300_000:
            self.clear()
        word = bare(written)
        kind = _CLASS.get(word)
        strength = 0.0
        if kind is None:
            strength = max((self.learned.get(form, 0.0) for form in beginnings(word)), default=0.0) if word else 0.0
            kind = INSULT if strength > 0 else OTHER
        value = self[written] = (kind, strength)
        return value


def matched_clauses(text: str, lexicon: Lexicon) -> tuple[list[float], int]:
    """Scores of the clauses in which the grammar finds something, and the number of words."""
    words = text.split()
    symbols = [lexicon[w] for w in words]
    if not any(kind in (INSULT, THREAT) for kind, _ in symbols):
        return [], len(words)
    scores, start = [], 0
    for end in [i + 1 for i, w in enumerate(words) if w.endswith(_CLAUSE_END)] + [len(words)]:
        clause = symbols[start:end]
        start = end
        if any(kind in (INSULT, THREAT) for kind, _ in clause):
            score = clause_score(clause)
            if score > 0:
                scores.append(score)
    return scores, len(words)


FEATURES = 6


def features(scores: list[float], words: int) -> list[float]:
    """Strongest clauses, their sum, their number and their share of the words."""
    top = sorted(scores, reverse=True)[:3]
    total = sum(scores)
    return [
        top[0] if top else 0.0,
        math.log1p(sum(top)),
        math.log1p(total),
        math.log1p(len(scores)),
        math.log1p(100.0 * total / (words + 20)),
        math.log1p(words),
    ]


@dataclass
class Model:
    """What is learned; small, and the same for every row."""

    learned: dict[str, float]
    mean: list[float]
    scale: list[float]
    weights: list[float]
    bias: float

    def probability(self, scores: list[float], words: int) -> float:
        z = self.bias
        for x, m, s, w in zip(features(scores, words), self.mean, self.scale, self.weights, strict=True):
            z += w * (x - m) / s
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; null without an id. Rows of fold 0 are held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``body, toxic, half``: at most ``sample`` labelled rows outside fold 0, in an order no data decides."""
    known = labels.where(labels["toxic"].isNotNull() & (fold(labels["doc_id"]) != 0)).select(
        labels["doc_id"].cast("long").alias("_id"), labels["toxic"].cast("int").alias("toxic")
    )
    order = F.xxhash64("_id", F.lit("sample"))
    drawn = known.groupBy("_id").agg(F.max("toxic").alias("toxic")).orderBy(order, "_id").limit(sample)
    texts = docs.select(docs["doc_id"].cast("long").alias("_id"), text_bytes(docs["text"]).alias("body"))
    return texts.join(F.broadcast(drawn), "_id").select(  # at most ``sample`` rows of two numbers
        "body", "toxic", F.pmod(F.xxhash64("_id"), F.lit(2)).cast("int").alias("half")
    )


def learn_insults(rows: DataFrame, entries: int = ENTRIES) -> dict[str, float]:
    """Log odds of words and beginnings that toxic documents hold far more often, at most ``entries``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic: Counter[str] = Counter()
        clean: Counter[str] = Counter()
        docs = [0, 0]
        for batch in batches:
            for body, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = {bare(w) for w in body.decode().split()} - {""}
                forms = {f for w in words for f in beginnings(w)}
                (toxic if label else clean).update(forms)
                docs[1 if label else 0] += 1
        # Beginnings seen in clean rows only cannot become insults.
        kept = list(toxic)
        yield pa.RecordBatch.from_pydict(
            {
                "form": pa.array([*kept, None], pa.string()),
                "toxic": pa.array([*(toxic[f] for f in kept), docs[1]], pa.int64()),
                "clean": pa.array([*(clean[f] for f in kept), docs[0]], pa.int64()),
            }
        )
        rest = [f for f, n in clean.items() if f not in toxic and n > 1]
        yield pa.RecordBatch.from_pydict(
            {
                "form": pa.array(rest, pa.string()),
                "toxic": pa.array([0] * len(rest), pa.int64()),
                "clean": pa.array([clean[f] for f in rest], pa.int64()),
            }
        )

    counted = rows.select("body", "toxic").mapInArrow(count, "form string, toxic long, clean long")
    sums = counted.groupBy("form").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    totals = sums.where("form is null").collect()  # one row
    if not totals or not totals[0]["toxic"]:
        return {}
    toxic, clean = totals[0]["toxic"], totals[0]["clean"]
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (clean + 1.0))
    found = (
        sums.where("form is not null")
        .where(F.col("toxic") >= SUPPORT)
        .withColumn("weight", odds)
        .where(F.col("weight") >= LEAST_WEIGHT)
        .orderBy(F.desc(F.col("weight") * F.sqrt("toxic")), "form")
        .limit(entries)
    )
    return {r["form"]: r["weight"] for r in found.select("form", "weight").collect()}  # at most ``entries``


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, entries: int = ENTRIES) -> Model:
    """The grammar's insults from one half of the labelled rows, probabilities from the other."""
    small_batches(docs.sparkSession)
    rows = training_rows(docs, labels, sample)
    learned = learn_insults(rows.where("half = 0"), entries)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(learned)
        for batch in batches:
            table = [features(*matched_clauses(b.decode(), lexicon)) for b in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"x": pa.array(table, pa.list_(pa.float64())), "y": batch.column(1)})

    other = rows.where("half = 1").select("body", "toxic").mapInArrow(describe, "x array<double>, y int")
    pairs = other.collect()  # six numbers for each of at most ``sample`` rows
    x = np.array([p["x"] for p in pairs], float).reshape(-1, FEATURES)
    y = np.array([p["y"] for p in pairs], float)
    order = np.lexsort((*x.T, y)) if len(x) else np.empty(0, int)  # rows come in any order, sums should not
    x, y = x[order], y[order]
    mean = x.mean(axis=0) if len(x) else np.zeros(FEATURES)
    scale = np.where(x.std(axis=0) > 1e-9, x.std(axis=0), 1.0) if len(x) else np.ones(FEATURES)
    weights, bias = _logistic((x - mean) / scale, y)
    return Model(learned, mean.tolist(), scale.tolist(), weights.tolist(), bias)


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton steps."""
    design = np.column_stack([x, np.ones(len(x))])
    beta = np.zeros(design.shape[1])
    ridge = np.diag([penalty] * x.shape[1] + [1e-3])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (y - p) - ridge @ beta
        step = np.linalg.solve((design.T * (p * (1 - p))) @ design + ridge, slope)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta[:-1], float(beta[-1])


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, entries: int = ENTRIES) -> DataFrame:
    """``doc_id, held_out, score, predicted, clauses``: one row per row of ``docs``.

    ``score`` is the probability of label 1 from matched clauses alone, ``predicted``
    1 from 0.5 on, ``clauses`` the number of matched clauses. Labels of fold 0 are
    never used, nor are language, source and id. Without labelled rows every score
    is that of no evidence. A null text counts as empty and is scored; a null
    doc_id is not held out; a document labelled twice counts as toxic if either
    label says so; repeated rows give repeated rows; other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample, entries))  # at most ``entries`` forms

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(model.value.learned)
        for batch in batches:
            for part in pieces_of(batch, _SLICE):
                found = [matched_clauses(b.decode(), lexicon) for b in part.column("body").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("held_out"),
                        pa.array([model.value.probability(s, n) for s, n in found], pa.float64()),
                        pa.array([len(s) for s, _ in found], pa.int64()),
                    ],
                    ["doc_id", "held_out", "score", "clauses"],
                )

    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        F.coalesce(fold(docs["doc_id"]) == 0, F.lit(False)).alias("held_out"),
        text_bytes(docs["text"]).alias("body"),
    )
    scored = rows.mapInArrow(score, "doc_id long, held_out boolean, score double, clauses long")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "clauses")
