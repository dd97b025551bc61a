"""Links found on pages."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import fixed
from gleanery.functions.naming import let
from gleanery.functions.text import unescape_entities
from gleanery.functions.urls import resolve_url, url_parts
from gleanery.operators.pages import INERT

_ANCHOR = r"(?is)<a\s(?:[^>]*?\s)?href\s*=[^>]*>"
_HREF = r"""(?is)\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""


def _nav_pattern(nav_class: str | None) -> str:
    opening = r"<nav\b[^>]*>"
    if nav_class:
        token = re.escape(nav_class)
        opening = (
            rf"""<nav\b(?=[^>]*?\sclass\s*=\s*(?:"(?:[^"]*\s)?{token}(?:\s[^"]*)?"|'(?:[^']*\s)?{token}(?:\s[^']*)?'"""
            rf"""|{token}[\s>]))[^>]*>"""
        )
    return rf"(?s){opening}(.*?)(?:</nav\s*>|\z)"


def page_hrefs(html: Column, nav_class: str | None) -> Column:
    """Every href, in document order, inside the first nav with that class (any nav when None)."""
    return _hrefs(F.regexp_extract(F.regexp_replace(html, INERT, ""), _nav_pattern(nav_class), 1))


def every_href(html: Column) -> Column:
    """Every href of the whole page, in document order."""
    return _hrefs(F.regexp_replace(html, INERT, ""))


def _hrefs(html: Column) -> Column:
    anchors = F.regexp_extract_all(html, F.lit(_ANCHOR), F.lit(0))
    return F.transform(
        anchors,
        lambda a: unescape_entities(F.concat(*[F.regexp_extract(a, _HREF, group) for group in (1, 2, 3)])),
    )


def page_links(pages: DataFrame, nav_class: str | None = fixed.PAGINATION_CLASS) -> DataFrame:
    """Resolved links of each page: ``page_id, src_url, pos, dst_url``.

    A link counts once per page, at its first place; ``pos`` is its place in
    the resulting list. Everything happens inside the page's own row, so there
    is no shuffle.
    """
    return _resolved(pages, page_hrefs(F.col("html"), nav_class))


def every_link(pages: DataFrame) -> DataFrame:
    """Like ``page_links``, from all anchors of the page, wherever they stand."""
    return _resolved(pages, every_href(F.col("html")))


def _resolved(pages: DataFrame, hrefs: Column) -> DataFrame:
    found = pages.select("page_id", F.col("url").alias("src_url"), hrefs.alias("hrefs"))
    page = F.col("src_url")
    # The page's own address is taken apart once for all its links.
    resolved = let(
        url_parts(page),
        lambda parts: F.array_distinct(F.transform("hrefs", lambda href: resolve_url(page, href, parts))),
    )
    return found.select("page_id", "src_url", F.posexplode(resolved).alias("pos", "dst_url"))
