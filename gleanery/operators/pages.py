"""Page text: strip page chrome, turn pages into Markdown blocks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import fixed
from gleanery.functions.naming import let
from gleanery.functions.text import unescape_entities

# Text a browser never shows as markup. Scanned left to right in one pass, so a
# comment inside a script (or the other way round) goes with its container.
INERT = r"(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>"
_INERT_OR_HEAD = r"(?is)<!--.*?-->|<(head|title|script|style)\b[^>]*>.*?</\1\s*>"

_MARK = "﷐"  # a noncharacter: never part of text
_BLOCK_TAGS = (
    "p|div|article|section|main|aside|nav|ul|ol|li|dl|dt|dd|table|tr|blockquote|pre|form|figure|figcaption"
    "|address|fieldset|body|html|h[1-6]"
)

# Noncharacters that stand for the start, line breaks and spaces of preformatted text.
_PRE, _BREAK, _SPACE = "\ufdd3", "\ufdd1", "\ufdd2"
_LIST_TAG = r"(?i)</?(?:ul|ol|li)\b[^>]*>"

# Inline markup to Markdown, applied in this order.
_MARKUP = (
    (
        r"""(?is)<img\b(?=[^>]*?\ssrc\s*=\s*"([^"]*)")(?:(?=[^>]*?\salt\s*=\s*"([^"]*)"))?[^>]*>""",
        "![$2]($1)",
    ),
    (
        r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))[^>]*>(.*?)</a\s*>""",
        "[$4]($1$2$3)",
    ),
    (r"(?i)</?(?:b|strong)\b[^>]*>", "**"),
    (r"(?i)</?(?:i|em)\b[^>]*>", "_"),
    (r"(?i)<br\b[^>]*>", "\n"),
    (r"(?i)</t[dh]\s*>\s*<t[dh]\b[^>]*>", "| "),
    (r"(?i)<hr\b[^>]*>", "\n\n* * *\n\n"),
    # An opening heading or item leaves its digit or its i between the marks.
    (rf"(?i)<(?:h([1-6])|l(i)|/?(?:{_BLOCK_TAGS}))\b[^>]*>", f"\n\n{_MARK}$1$2{_MARK}"),
    (r"<[/!?a-zA-Z][^>]*>", ""),
)


def _chrome_repair():
    """Arrow UDF for pages whose chrome tags nest, interleave or are never closed.

    Follows the open-element stack: a closing tag ends everything opened since
    its opening tag. Imports live inside so executors need nothing installed.
    """
    tags = fixed.CHROME_TAGS

    def cut_pages(pages: pd.Series) -> pd.Series:
        from html.parser import HTMLParser

        void = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

        class Spans(HTMLParser):
            """Character spans of the elements to cut."""

            def __init__(self, text):
                super().__init__(convert_charrefs=False)
                self.text, self.open, self.spans = text, [], []
                self.cut_from = self.cut_depth = None
                self.starts = [0]
                for line in text.split("\n"):
                    self.starts.append(self.starts[-1] + len(line) + 1)
                self.feed(text)
                self.close()
                if self.cut_from is not None:
                    self.spans.append((self.cut_from, len(text)))

            def here(self):
                line, column = self.getpos()
                return self.starts[line - 1] + column

            def handle_starttag(self, tag, attrs):
                if tag in void:
                    return
                if tag in tags and self.cut_from is None:
                    self.cut_from, self.cut_depth = self.here(), len(self.open)
                self.open.append(tag)

            def handle_startendtag(self, tag, attrs):
                if tag in tags and self.cut_from is None:
                    self.spans.append((self.here(), self.here() + len(self.get_starttag_text())))

            def handle_endtag(self, tag):
                if tag not in self.open:
                    return
                depth = len(self.open) - 1 - self.open[::-1].index(tag)
                del self.open[depth:]
                if self.cut_from is not None and depth <= self.cut_depth:
                    end = self.here()
                    if depth == self.cut_depth:  # its own closing tag goes too
                        end = self.text.find(">", end) + 1 or len(self.text)
                    self.spans.append((self.cut_from, end))
                    self.cut_from = None

        def cut(text):
            if text is None:
                return None
            kept, position = [], 0
            for start, end in Spans(text).spans:
                kept.append(text[position:start])
                position = end
            kept.append(text[position:])
            return "".join(kept)

        return pages.map(cut, na_action="ignore")

    return F.pandas_udf(cut_pages, "string")


def _tag_trail(html: Column) -> Column:
    names = "|".join(fixed.CHROME_TAGS)
    return F.lower(F.array_join(F.regexp_extract_all(html, F.lit(rf"(?i)</?(?:{names})\b"), F.lit(0)), ""))


def chrome_is_regular(html: Column, inert: bool = True) -> Column:
    """True when chrome tags come as plain open/close pairs, none of them inside scripts or comments.

    ``inert=False``: the page has no scripts and comments any more.
    """

    def judged(trail: Column) -> Column:
        unpaired = trail
        for tag in fixed.CHROME_TAGS:
            unpaired = F.replace(unpaired, F.lit(f"<{tag}</{tag}"), F.lit(""))
        if not inert:
            return unpaired == ""
        hidden = F.array_join(F.regexp_extract_all(html, F.lit(INERT), F.lit(0)), "")
        return (trail == "") | ((unpaired == "") & (_tag_trail(hidden) == ""))

    return let(_tag_trail(html), judged)


def strip_chrome(pages: DataFrame, html: str = "html", repair: bool = True, inert: bool = True) -> DataFrame:
    """Remove every header and footer element with its content, at any depth.

    Regular pages stay in native regexes. Only the text of irregular pages is
    handed to the Arrow UDF (it sees null for the others), in the same single
    pass over the table. ``repair=False`` leaves the UDF out for input known to
    be regular.
    """
    native = F.col(html)
    for tag in fixed.CHROME_TAGS:
        native = F.regexp_replace(native, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    if not repair:
        return pages.withColumn(html, native)
    irregular = F.when(~chrome_is_regular(F.col(html), inert), F.col(html))
    return (
        pages.withColumn("_irregular", irregular)
        .withColumn("_repaired", _chrome_repair()("_irregular"))
        .withColumn(html, F.when(F.col("_irregular").isNull(), native).otherwise(F.col("_repaired")))
        .drop("_irregular", "_repaired")
    )


def _one_line(html: Column) -> Column:
    """White space as a browser shows it: one space, but for preformatted text, whose breaks and spaces are kept as marks."""

    def collapsed(text: Column) -> Column:
        return F.regexp_replace(text, r"\s{2,}|[\t\n\r\f]", " ")

    def kept(part: Column) -> Column:
        inside = F.regexp_replace(part, r"(?is)^<pre\b[^>]*>|</pre\s*>$", "")
        plain = F.regexp_replace(F.regexp_replace(inside, r"\r\n?", "\n"), r"^\n|\s+$", "")
        marked = F.replace(F.replace(plain, F.lit("\t"), F.lit("    ")), F.lit(" "), F.lit(_SPACE))
        # Breaks within tags are no text.
        marked = F.regexp_replace(marked, rf"[\n{_SPACE}](?=[^<>]*>)", " ")
        return F.concat(F.lit(f"<pre>{_PRE}"), F.regexp_replace(marked, "\n", _BREAK), F.lit("</pre>"))

    parts = F.split(html, r"(?i)(?=<pre\b)|(?<=</pre>)")
    whole = F.transform(parts, lambda x: F.when(F.rlike(x, F.lit(r"(?is)^<pre\b.*</pre>$")), kept(x)).otherwise(collapsed(x)))
    return F.when(F.rlike(html, F.lit(r"(?i)<pre\b")), F.array_join(whole, "")).otherwise(collapsed(html))


def _visible(pages: DataFrame, repair: bool) -> DataFrame:
    """Pages without anything that gives no text: head, scripts, styles, comments, chrome.

    Scripts and comments go first; what is left decides more cheaply whether
    its chrome tags are regular.
    """
    html = F.regexp_replace(_one_line(F.col("html")), _INERT_OR_HEAD, "")
    return strip_chrome(pages.withColumn("html", html), repair=repair, inert=False)


def _lists_led(text: Column) -> Column:
    """List tags replaced by block marks, with indent and bullet or number of each item.

    A fold over the tags with the open lists as its stack: for each its kind, and
    how many items it has had. A closing tag without an opening one closes nothing.
    """
    tags = F.regexp_extract_all(text, F.lit(_LIST_TAG), F.lit(0))
    plain = F.lit(f"\n\n{_MARK}{_MARK}")
    start = F.struct(
        F.array().cast("array<boolean>").alias("numbered"),
        F.array().cast("array<int>").alias("items"),
        F.array().cast("array<string>").alias("leads"),
    )

    def step(acc: Column, tag: Column) -> Column:
        name, depth = F.lower(F.regexp_extract(tag, r"^</?(\w+)", 1)), F.size(acc["items"])
        opens, first = ~tag.startswith("</"), F.regexp_extract(tag, r"""(?i)\bstart\s*=\s*["']?(\d{1,9})""", 1).try_cast("int")
        outer = F.greatest(depth - 1, F.lit(0))
        items = F.when(depth > 0, F.element_at(acc["items"], -1) + 1).otherwise(1)
        numbered = (depth > 0) & F.coalesce(F.try_element_at(acc["numbered"], F.lit(-1)), F.lit(False))
        lead = F.concat(
            F.lit(f"\n\n{_MARK}"), F.repeat(F.lit("  "), outer),
            F.when(numbered, F.concat(items.cast("string"), F.lit(". "))).otherwise(F.lit("* ")), F.lit(_MARK),
        )
        is_item = name == "li"
        return F.struct(
            F.when(is_item, acc["numbered"]).when(opens, F.array_append(acc["numbered"], name == "ol"))
            .otherwise(F.slice(acc["numbered"], F.lit(1), outer)).alias("numbered"),
            F.when(is_item & opens & (depth > 0), F.array_append(F.slice(acc["items"], F.lit(1), outer), items))
            .when(is_item, acc["items"]).when(opens, F.array_append(acc["items"], F.coalesce(first - 1, F.lit(0))))
            .otherwise(F.slice(acc["items"], F.lit(1), outer)).alias("items"),
            F.array_append(acc["leads"], F.when(is_item & opens, lead).otherwise(plain)).alias("leads"),
        )

    leads = F.aggregate(tags, start, step, lambda acc: acc["leads"])
    parts = F.split(text, _LIST_TAG)
    return F.array_join(F.zip_with(parts, leads, lambda part, lead: F.concat(part, F.coalesce(lead, F.lit("")))), "")


def _rows_headed(text: Column) -> Column:
    """A line of dashes below each table row whose cells are headings."""

    def headed(row: Column) -> Column:
        cells = F.regexp_count(row, F.lit(r"(?i)<th\b"))
        line = F.concat(F.lit("\n"), F.array_join(F.array_repeat(F.lit("---"), cells), "|"), F.lit("</tr>"))
        closed = (cells > 0) & (cells == F.regexp_count(row, F.lit(r"(?i)</th\s*>")))
        return F.when(closed, F.regexp_replace(row, F.lit(r"(?i)</tr\s*>"), line)).otherwise(row)

    return F.array_join(F.transform(F.split(text, r"(?i)(?=<tr\b)"), headed), "")


def markdown_blocks(html: Column) -> Column:
    """Array of non-blank Markdown blocks of the visible part of one page.

    Tag subset: a, img, b, strong, i, em, br, hr, h1-h6, ul, ol, li, pre, td, th; the
    usual block tags. All others vanish, their text stays. Items of lists within
    lists are indented, those of ``ol`` numbered; preformatted lines are indented by
    four; a row of table headings has a line of dashes below it. Only pages that have
    such things go through these steps.
    """
    # One list after another, all of bullets, needs no stack.
    trail = F.lower(F.array_join(F.regexp_extract_all(html, F.lit(r"(?i)</?[uo]l\b"), F.lit(0)), ""))
    text = F.when(F.rlike(trail, F.lit("<ol|<ul<ul")), _lists_led(html)).otherwise(html)
    text = let(text, lambda x: F.when(F.rlike(x, F.lit(r"(?i)<th\b")), _rows_headed(x)).otherwise(x))
    for pattern, replacement in _MARKUP:
        text = F.regexp_replace(text, pattern, replacement)
    text = unescape_entities(text)

    def finished(block: Column) -> Column:
        kind = F.substring(block, 2, 1)
        words = F.ltrim(F.substr(block, F.lit(4)))
        lead = F.when(F.lower(kind) == "i", "* ").otherwise(F.concat(F.repeat(F.lit("#"), kind.try_cast("int")), F.lit(" ")))
        item = F.ltrim(F.regexp_replace(block, f"^{_MARK}[^{_MARK}]*{_MARK}", ""))
        led = F.concat(F.regexp_extract(block, f"^{_MARK}([^{_MARK}]*){_MARK}", 1), item)
        shown = (
            F.when(~block.startswith(_MARK), block)
            .when(kind == _MARK, F.ltrim(F.substr(block, F.lit(3))))
            .when(F.substring(block, 3, 1) == _MARK, F.when(words == "", "").otherwise(F.concat(lead, words)))
            .otherwise(F.when(item == "", "").otherwise(led))
        )
        return let(shown, preformatted)

    def preformatted(block: Column) -> Column:
        lines = F.replace(F.replace(block, F.lit(_BREAK), F.lit("\n    ")), F.lit(_SPACE), F.lit(" "))
        return F.when(block.startswith(_PRE), F.replace(lines, F.lit(_PRE), F.lit("    "))).otherwise(block)

    trimmed = F.transform(F.split(text, r"\n\s*\n"), lambda block: F.regexp_replace(block, r"^\s+|\s+$", ""))
    return F.filter(F.transform(trimmed, finished), lambda block: block != "")


def page_blocks(pages: DataFrame, repair: bool = True) -> DataFrame:
    """One row per Markdown block: ``page_id, block_no, kind, text``."""
    blocks = _visible(pages.select("page_id", "html"), repair).select(
        "page_id", F.posexplode(markdown_blocks(F.col("html"))).alias("block_no", "text")
    )
    kind = (
        F.when(F.rlike("text", F.lit(r"^#{1,6} ")), "heading")
        .when(F.rlike("text", F.lit(r"^ *(?:\* |\d+\. )")), "item")
        .otherwise("text")
    )
    return blocks.select("page_id", "block_no", kind.alias("kind"), "text")


def page_markdown(pages: DataFrame, repair: bool = True) -> DataFrame:
    """Pages to Markdown, adding ``markdown`` in place of ``html``. No shuffle: a page is one row."""
    blocks = markdown_blocks(F.col("html"))
    return _visible(pages, repair).withColumn("markdown", F.array_join(blocks, "\n\n")).drop("html")
