"""URL columns: split, resolve, clean, site and run keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.functions import fixed
from gleanery.functions.naming import let
from gleanery.functions.text import strip_space

# RFC 3986 appendix B. A regex, not parse_url: a page link need not be a valid
# Java URI, and one bad link must not fail the job.
_PARTS = r"(?s)^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
_DOT_SEGMENT = r"(?:^|/)\.\.?(?:/|$)"
_RELATIVE_SCHEMES = ("", "http", "https", "ftp", "file")


def url_parts(url: Column) -> Column:
    """Struct of scheme (lower case), netloc, path, query, fragment; absent parts are ''."""
    tidy = F.regexp_replace(url, r"^[\x00-\x20]+|[\t\r\n]", "")
    names = ("scheme", "netloc", "path", "query", "fragment")
    groups = [F.regexp_extract(tidy, _PARTS, i + 1) for i in range(len(names))]
    groups[0] = F.lower(groups[0])
    return F.struct(*[g.alias(n) for g, n in zip(groups, names)])


def _without_dots(path: Column) -> Column:
    """RFC 3986 dot-segment removal, folded over the path segments."""

    def step(kept: Column, segment: Column) -> Column:
        return (
            F.when(segment == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))))
            .when(segment == ".", kept)
            .otherwise(F.concat(kept, F.array(segment)))
        )

    segments = F.split(path, "/", -1)
    kept = F.aggregate(segments, F.array().cast("array<string>"), step)
    tail = F.when(F.element_at(segments, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(kept, tail), "/")


def _merged_path(base_path: Column, path: Column) -> Column:
    """Base folder plus a relative path, without empty inner segments."""
    folder = F.regexp_extract(base_path, r"(?s)^(.*/)?[^/]*$", 1)

    def squeezed(segments: Column) -> Column:
        inner = F.slice(segments, F.lit(2), F.greatest(F.size(segments) - 2, F.lit(0)))
        ends = F.when(F.size(segments) > 1, F.slice(segments, -1, 1)).otherwise(F.array().cast("array<string>"))
        return F.array_join(F.concat(F.slice(segments, 1, 1), F.filter(inner, lambda s: s != ""), ends), "/")

    # A base without a path counts as the folder "/".
    rooted = F.when(folder == "", F.when(base_path == "", "/").otherwise("")).otherwise(folder)
    return let(F.split(F.concat(rooted, path), "/", -1), squeezed)


def _prefixed(mark: str, text: Column) -> Column:
    return F.when(text == "", "").otherwise(F.concat(F.lit(mark), text))


def _suffixed(text: Column, mark: str) -> Column:
    return F.when(text == "", "").otherwise(F.concat(text, F.lit(mark)))


def resolve_url(base: Column, href: Column, base_parts: Column | None = None) -> Column:
    """Absolute form of ``href`` seen on the page ``base``.

    Pass ``base_parts`` (``url_parts`` of the base, computed once per page) when
    many links of one page are resolved.
    """
    if base_parts is None:
        return let(url_parts(base), lambda parts: resolve_url(base, href, parts))
    b = base_parts

    def joined(h: Column, path: Column) -> Column:
        scheme = F.when(h["scheme"] == "", b["scheme"]).otherwise(h["scheme"])
        netloc = F.when(h["netloc"] == "", b["netloc"]).otherwise(h["netloc"])
        same_page = (h["netloc"] == "") & (h["path"] == "") & (h["query"] == "")
        bare = (netloc != "") & (path != "") & ~path.startswith("/")
        return F.concat(
            _suffixed(scheme, ":"),
            F.when(scheme == "file", F.concat(F.lit("//"), netloc)).otherwise(_prefixed("//", netloc)),
            F.when(bare, F.concat(F.lit("/"), path)).otherwise(path),
            _prefixed("?", F.when(same_page, b["query"]).otherwise(h["query"])),
            _prefixed("#", h["fragment"]),
        )

    def resolved(h: Column) -> Column:
        merged = F.when(h["path"].startswith("/"), h["path"]).otherwise(_merged_path(b["path"], h["path"]))
        clean = let(merged, lambda m: F.when(F.rlike(m, F.lit(_DOT_SEGMENT)), _without_dots(m)).otherwise(m))
        path = (
            F.when(h["netloc"] != "", h["path"])
            .when(h["path"] == "", b["path"])
            .otherwise(let(clean, lambda c: F.when(c == "", "/").otherwise(c)))
        )
        elsewhere = (h["scheme"] != "") & (h["scheme"] != b["scheme"])
        return F.when(elsewhere | ~b["scheme"].isin(*_RELATIVE_SCHEMES), href).otherwise(let(path, lambda p: joined(h, p)))

    return (
        F.when(F.coalesce(base, F.lit("")) == "", href).when(href == "", base).otherwise(let(url_parts(href), resolved))
    )


def site_key(url: Column, keep_www: bool = False) -> Column:
    """Site part of a run folder name.

    Default: authority, or the first path segment when there is none, without a
    leading ``www.``. ``keep_www``: the text between the first ``//`` and the
    next ``/``.
    """
    if keep_www:
        site = F.regexp_extract(url, r"(?s)^.*?//([^/]*)", 1)
    else:
        parts = url_parts(url)
        site = F.when(parts["netloc"] != "", parts["netloc"]).otherwise(F.split_part(parts["path"], F.lit("/"), F.lit(1)))
        site = F.regexp_replace(site, r"^www\.", "")
    return F.regexp_replace(site, r"(?U)\W+", "_")


def run_key(url: Column, started: Column, keep_www: bool = False) -> Column:
    """Run folder name: site key plus start time."""
    return F.concat(site_key(url, keep_www), F.lit("_"), F.date_format(started, fixed.RUN_STAMP))


def clean_url(url: Column) -> Column:
    """Strip whitespace, then turn every ``http://`` into ``https://``."""
    return F.replace(strip_space(url), F.lit("http://"), F.lit("https://"))
