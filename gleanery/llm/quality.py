"""Quality rules with cross-document line frequency, in columns only.

Lines are normalised and hashed; for every host it is counted how many different
documents hold a line. Lines above the limits are boilerplate and are removed,
and a document that has little left is rejected. Copies of one text count as one
document, so that copying a text does not make its lines boilerplate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.jsontext import once
from gleanery.functions.naming import let
from gleanery.llm.common import row_of
from gleanery.session import written

WINDOW = 8  # words of a repeated window
LEAST_WORDS = 20
MOST_REPEATED = 30  # per cent of the words
LINE_DOCS = 20  # documents of a host that must hold a line
DEPLETED = 0.5  # share of its words a document may lose
SALTS = 16
BROADCAST_LINES = 200_000  # hashes of frequent lines that may be broadcast, each with its host
HOST_LINES = 5_000  # of one host, as every text of the host looks through them

_SPACE = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]"
_SYMBOL = r"[#*$%&|<>]"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, _SPACE), "")


def normal_line(line: Column) -> Column:
    """Lower case, single spaces, every number a 0."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(line), _SPACE, " ")), "[0-9]+", "0")


def repeated_words(hashes: Column, window: int) -> Column:
    """Words covered by windows found more than once, from the hashes of all windows in order."""

    def found(ordered: Column) -> Column:
        twice = F.filter(
            ordered,
            lambda x, i: (F.get(ordered, i - 1)["h"] == x["h"]).eqNullSafe(F.lit(True))
            | (F.get(ordered, i + 1)["h"] == x["h"]).eqNullSafe(F.lit(True)),
        )
        places = F.array_sort(F.transform(twice, lambda x: x["i"]))
        start = F.struct(F.lit(-window).cast("long").alias("last"), F.lit(0).cast("long").alias("total"))
        return F.aggregate(
            places,
            start,
            lambda acc, p: F.struct(
                p.cast("long").alias("last"),
                (acc["total"] + F.least(F.lit(window).cast("long"), p.cast("long") - acc["last"])).alias("total"),
            ),
            lambda acc: acc["total"],
        )

    return let(F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), found)


def base_rules(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``row`` (all columns), ``doc_id, source, text_key, lines`` and the counts that need one text only.

    A null source is the empty one. Windows are compared by a 64-bit hash within
    one text. Columns of ``row`` that nobody reads are not carried.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    split = docs.select(
        row_of(docs),
        docs["doc_id"].cast("long").alias("doc_id"),
        F.coalesce(docs["source"], F.lit("")).alias("source"),
        F.xxhash64(docs["text"]).alias("text_key"),
        words_of(text).alias("words"),
        _lines_of(text).alias("lines"),
        F.regexp_count(text, F.lit(_SYMBOL)).cast("long").alias("n_symbols"),
    )
    counted = split.select(
        "row",
        "doc_id",
        "source",
        "text_key",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("marks"),
        "lines",
    )
    windows = F.when(
        F.size("marks") > window,  # a single window repeats nothing
        F.transform(
            F.sequence(F.lit(0), F.greatest(F.size("marks") - window, F.lit(0))),
            # Word by word: a slice would copy the whole array for every window.
            lambda i: F.xxhash64(*[F.get("marks", i + k) for k in range(window)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    hashed = counted.select("*", windows.alias("windows")).drop("marks")
    repeated = F.when(F.size(F.array_distinct("windows")) < F.size("windows"), repeated_words(F.col("windows"), window))
    return hashed.select("*", F.coalesce(repeated, F.lit(0)).cast("long").alias("n_repeat_words")).drop("windows")


def _lines_of(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(_WORD)))


def _marked(lines: Column) -> Column:
    """Hash and words of each line."""
    return F.transform(
        lines,
        lambda x: F.struct(F.xxhash64(normal_line(x)).alias("h"), F.size(words_of(x)).cast("long").alias("w")),
    )


def distinct_texts(docs: DataFrame) -> DataFrame:
    """``source, text_key, lines``: each different text of a host once, with hash and words of its lines."""
    rows = docs.where(docs["text"].isNotNull()).select(
        F.coalesce(docs["source"], F.lit("")).alias("source"),
        F.xxhash64(docs["text"]).alias("text_key"),
        _marked(_lines_of(docs["text"])).alias("lines"),
    )
    # Equal keys have equal lines: any will do. Copies are folded before the shuffle.
    return rows.groupBy("source", "text_key").agg(F.max("lines").alias("lines"))


def frequent_lines(texts: DataFrame, line_docs: int = LINE_DOCS) -> DataFrame:
    """``source, h``: lines held by too many different documents of their host.

    The limit is ``line_docs`` and the square root of the host's documents: chance
    makes short lines meet more often in a large host, but a footer of a large
    host is one however small its share.
    """
    held = texts.select("source", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
    often = held.groupBy("source", "h").agg(F.count("*").alias("docs")).where(F.col("docs") >= line_docs)
    hosts = texts.groupBy("source").agg(F.count("*").alias("host_docs"))
    return often.join(hosts, "source").where(F.col("docs") * F.col("docs") > F.col("host_docs")).select("source", "h")


def removed_lines(texts: DataFrame, frequent: DataFrame) -> DataFrame:
    """``source, text_key, removed_words, removed``: what each text loses, for texts that lose something."""
    lines = texts.select("source", "text_key", F.explode("lines").alias("line")).select(
        "source", "text_key", F.col("line.h").alias("h"), F.col("line.w").alias("w")
    )
    salted = frequent.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod("text_key", F.lit(SALTS)).cast("int")
    matched = lines.withColumn("salt", salt).join(salted, ["source", "h", "salt"])
    return matched.groupBy("source", "text_key").agg(
        F.sum("w").alias("removed_words"), F.collect_set("h").alias("removed")
    )


def _with_removed(base: DataFrame, texts: DataFrame, frequent: DataFrame) -> DataFrame:
    """``base`` with ``removed``, hashes of the lines each text loses, and ``removed_words``; nulls for none."""
    hosts = written(frequent.groupBy("source").agg(F.collect_set("h").alias("often")), "hosts")
    total, most = hosts.agg(F.sum(F.size("often")), F.max(F.size("often"))).collect()[0]  # two numbers
    if (total or 0) <= BROADCAST_LINES and (most or 0) <= HOST_LINES:
        # Counted. Every text then looks up the lines of its host where it stands, and no text moves.
        held = base.join(F.broadcast(hosts), "source", "left")
        marks = F.when(F.col("often").isNotNull(), _marked(F.col("lines")))
        held = held.withColumn("marks", marks).drop("lines")
        hit = F.array_intersect(F.transform("marks", lambda x: x["h"]), F.col("often"))
        held = held.withColumn("removed", F.when(F.size(hit) > 0, hit)).drop("often")
        lost = F.aggregate(
            F.filter("marks", lambda x: F.array_contains("removed", x["h"])),
            F.lit(0).cast("long"),
            lambda acc, x: acc + x["w"],
        )
        return held.withColumn("removed_words", F.when(F.col("removed").isNotNull(), lost)).drop("marks")
    removed = written(removed_lines(texts, frequent), "removed")
    # One text may be a third of all rows: its one row on the right is repeated for each salt.
    salted = removed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    return base.drop("lines").withColumn("salt", salt).join(salted, ["source", "text_key", "salt"], "left")


def _judged(docs: DataFrame, line_docs: int, depleted: float) -> DataFrame:
    """``row``, the counts, what is removed, ``base_failed`` and ``kept``."""
    texts = written(distinct_texts(docs), "texts")
    frequent = written(frequent_lines(texts, line_docs), "lines")
    joined = _with_removed(base_rules(docs), texts, frequent)
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)
    lost = F.coalesce("removed_words", F.lit(0)).cast("long")
    kept = ~failed & (lost <= F.col("n_words") * depleted) & (F.col("n_words") - lost >= LEAST_WORDS)
    return joined.withColumns({"base_failed": failed, "removed_words": lost, "kept": kept})


def judge(docs: DataFrame, line_docs: int = LINE_DOCS, depleted: float = DEPLETED) -> DataFrame:
    """``doc_id``, the base counts, ``base_failed, kept, removed_words``: one row per row of ``docs``.

    A document fails the base rules with fewer than 20 words or if over 30 % of
    them are repeated, and is rejected if over half of its words stand in lines
    removed as boilerplate of its host, or fewer than 20 words stand elsewhere. A null text counts as empty, a null source
    is a host of its own, a null doc_id stays null; repeated rows give repeated
    rows; other columns are ignored.
    """
    return _judged(docs, line_docs, depleted).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "removed_words",
    )


def keep_good(docs: DataFrame, line_docs: int = LINE_DOCS, depleted: float = DEPLETED) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns; removed lines are taken out of ``text``."""
    # The verdict comes out of a generator: a filter on it is then not moved into the projections
    # below, which would write out the counts again for each of their uses.
    rows = once(_judged(docs, line_docs, depleted), F.col("kept"), "passed").where("passed")
    lines = F.filter(
        F.split("row.text", "\n"),
        lambda x: ~(F.rlike(x, F.lit(_WORD)) & F.array_contains("removed", F.xxhash64(normal_line(x)))),
    )
    text = F.when(F.col("removed").isNull(), F.col("row.text")).otherwise(F.array_join(lines, "\n"))
    return rows.select(*[text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
