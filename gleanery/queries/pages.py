"""Queries on page text, links, crawls and prompts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions import fixed
from gleanery.functions.text import remove_urls, token_count, token_cut
from gleanery.functions.urls import clean_url, resolve_url, run_key, site_key
from gleanery.operators import frontier, links, ordering, pages, replies, usage
from gleanery.operators.crawl_state import CrawlState
from gleanery.plans.pages_job import pages_job
from gleanery.plans.run_job import PagesRun, run_report, write_pages
from gleanery.queries.tables import table
from gleanery.session import scratch_path
from gleanery.sources.pages import pages_of_seeds
from gleanery.sources.sinks import write_run

_FIELDS = ("name", "price", "image_url", "product_url")
_SEEDS = ((0, 0), (1, 5), (2, 0))  # seed position, page it starts at; the first and the last are equal


def q_strip_chrome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.strip_chrome(table(spark, sf_dir, "pages").select("page_id", "html"))


def q_page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_blocks(table(spark, sf_dir, "pages"))


def q_page_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_markdown(table(spark, sf_dir, "pages").select("page_id", "html"))


def q_page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.page_links(table(spark, sf_dir, "pages"), nav_class=None)


def q_pagination_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class test: pages on http get the pagination class on their nav, the others another class."""
    source = table(spark, sf_dir, "pages")
    marked = F.when(F.col("url").startswith("http:"), f'<nav id="n" class="wide {fixed.PAGINATION_CLASS} top"').otherwise(
        f'<nav class="{fixed.PAGINATION_CLASS}-old"'
    )
    html = F.replace(F.col("html"), F.lit("<nav"), marked)
    return links.page_links(source.select("page_id", "url", html.alias("html")))


_HREFS = ("?page=2", "#part", "/root", "next", "../up", "./a/./b/../c", "//other.example.org/x", "https://abs.example.org/y?z#w", "mailto:a@example.org")


def q_resolve_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every form of link, seen from every page."""
    forms = F.array(*[F.lit(h) for h in _HREFS])
    seen = table(spark, sf_dir, "pages").select("page_id", "url", F.explode(forms).alias("href"))
    return seen.select("page_id", "href", resolve_url(F.col("url"), F.col("href")).alias("resolved"))


def q_remove_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their source's page address in the middle, page addresses alone, and very long ones."""
    documents = table(spark, sf_dir, "documents").select(
        F.lit("document").alias("kind"),
        F.col("doc_id").alias("id"),
        F.concat(F.lit("see (https://"), F.col("source"), F.lit(".example.org/a_b?c=1#d), "), F.col("text")).alias("text"),
    )
    addresses = table(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("url").alias("text"))
    long = addresses.select(
        F.lit("long").alias("kind"), "id", F.concat("text", F.repeat(F.lit("/path%20a"), 600), F.lit(" end")).alias("text")
    )
    return documents.unionByName(addresses).unionByName(long).select("kind", "id", remove_urls(F.col("text")).alias("text"))


def q_site_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    started = F.make_timestamp(*[F.lit(v) for v in (2024, 1, 2, 3, 4, 5)])
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        site_key(url).alias("site"),
        site_key(url, keep_www=True).alias("site_www"),
        run_key(url, started).alias("run_key"),
    )


def q_site_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and distinct links per site; links are counted per page before they meet their site."""
    source = table(spark, sf_dir, "pages")
    counted = links.page_hrefs(F.col("html"), None)
    per_page = source.select(
        site_key(F.col("url")).alias("site"),
        F.size(F.array_distinct(counted)).cast("bigint").alias("links"),
    )
    return per_page.groupBy("site").agg(F.count("*").alias("pages"), F.sum("links").alias("links"))


def q_clean_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = F.concat(F.lit(" \t"), F.col("url"), F.lit("&via=http://x.example.org \n"))
    return table(spark, sf_dir, "pages").select("page_id", clean_url(padded).alias("url"))


def page_edges(source: DataFrame, back: bool) -> DataFrame:
    """Links between the given pages: page n to pages 2n+1 and 2n+2, to itself, and back to page 0 if asked."""
    n = F.col("page_id")
    targets = F.array(2 * n + 1, 2 * n + 2, n, *([F.lit(0).cast("bigint")] if back else []))
    edges = source.select(F.col("url").alias("src_url"), F.posexplode(targets).alias("pos", "target"))
    ends = source.select(F.col("page_id").alias("target"), F.col("url").alias("dst_url"))
    return edges.join(ends, "target").select("src_url", "pos", "dst_url")


def page_seeds(spark: SparkSession, source: DataFrame) -> DataFrame:
    seeds = spark.createDataFrame(list(_SEEDS), "seed_pos int, page_id bigint")
    return source.select("page_id", "url").join(F.broadcast(seeds), "page_id").select("seed_pos", "url")


def q_page_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page address as a seed, twice, plus its https form, which may never have been fetched."""
    source = table(spark, sf_dir, "pages")
    forms = F.array(F.col("url"), F.col("url"), F.replace(F.col("url"), F.lit("http://"), F.lit("https://")))
    seeds = source.select((F.col("page_id") * 3).alias("first"), F.posexplode(forms).alias("p", "url")).select(
        (F.col("first") + F.col("p")).alias("seed_pos"), "url"
    )
    # Measured where the page is read: its text does not travel.
    sizes = source.select("url", "page_id", F.length("html").cast("bigint").alias("size"))
    return pages_of_seeds(seeds, sizes)


def q_crawl_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = table(spark, sf_dir, "pages").select("page_id", "url")
    return frontier.crawl_frontier(page_seeds(spark, source), page_edges(source, back=True))


def q_crawl_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same crawl in two batches: each page's first and third link, then the others and one more seed."""
    source = table(spark, sf_dir, "pages").select("page_id", "url")
    edges, seeds = page_edges(source, back=True), page_seeds(spark, source)
    state = CrawlState(spark, scratch_path(spark, "crawl"))
    first = F.col("pos") % 2 == 0
    state.add(seeds.where("seed_pos = 0").select("url"), edges.where(first).select("src_url", "dst_url"))
    state.add(seeds.select("url"), edges.where(~first).select("src_url", "dst_url"))
    return state.depths().join(seeds.select(F.col("url").alias("root"), "seed_pos"), "root").select("seed_pos", "url", "depth")


def q_page_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.number_rows(table(spark, sf_dir, "pages").select("url", "page_id"), ["url", "page_id"])


def q_first_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = frontier.first_page(table(spark, sf_dir, "pages"), ["url", "page_id"])
    return pages.page_markdown(first)


def q_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", token_count(F.col("text")).alias("tokens"))


def q_request_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.request_tokens(table(spark, sf_dir, "conversations"), "conv_id", "text")


def q_token_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", token_cut(F.col("text"), 100).alias("text"))


def q_prompt_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replies.prompt_table(
        table(spark, sf_dir, "documents"), replies.listing_schema(_FIELDS), ["doc_id"], "text"
    )


def linked_pages(source: DataFrame) -> DataFrame:
    """The given pages with a pagination nav to pages 2n+1 and 2n+2."""
    target = F.posexplode(F.array(2 * F.col("page_id") + 1, 2 * F.col("page_id") + 2))
    ends = source.select(F.col("page_id").alias("target"), F.col("url").alias("dst"))
    following = (
        source.select("page_id", target.alias("pos", "target"))
        .join(ends, "target")
        .groupBy("page_id")
        .agg(F.max(F.when(F.col("pos") == 0, F.col("dst"))).alias("a"), F.max(F.when(F.col("pos") == 1, F.col("dst"))).alias("b"))
    )

    def anchor(name: str):
        return F.coalesce(F.concat(F.lit('<a href="'), F.col(name), F.lit(f'">{name}</a>')), F.lit(""))

    nav = F.concat(F.lit(f'<nav class="{fixed.PAGINATION_CLASS}">'), anchor("a"), anchor("b"), F.lit("</nav><nav>"))
    # Only this preparation brings html and addresses together by a join; the job itself never moves html.
    return source.join(following, "page_id", "left").select(
        "page_id", "url", F.replace(F.col("html"), F.lit("<nav>"), nav).alias("html")
    )


def q_pages_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole job over pages that carry a pagination nav to pages 2n+1 and 2n+2."""
    source = table(spark, sf_dir, "pages")
    job = pages_job(page_seeds(spark, source), linked_pages(source), _FIELDS)
    return job.select("file_no", "seed_pos", "depth", "url", "user_prompt")


def _written_run(spark: SparkSession, sf_dir: str) -> PagesRun:
    source = table(spark, sf_dir, "pages")
    folder = scratch_path(spark, "runs")
    return write_pages(page_seeds(spark, source), linked_pages(source), folder, _FIELDS, datetime(2024, 1, 2, 3, 4, 5))


def q_pages_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job's pages and requests, written and read again."""
    run = _written_run(spark, sf_dir)
    texts, requests = spark.read.parquet(run.pages), spark.read.parquet(run.requests)
    joined = texts.join(requests.select("file_no", "user_prompt"), "file_no")
    return joined.select(
        "run", "file_no", "seed_pos", "url", F.length("markdown").alias("chars"), F.length("user_prompt").alias("prompt_chars")
    )


def q_run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals per seed of a written run, with replies to two of three requests that parse, to the others that do not."""
    requests = spark.read.parquet(_written_run(spark, sf_dir).requests)
    number = F.col("file_no")
    model = F.when(F.col("seed_pos") == 0, "small").when(F.col("seed_pos") == 1, "large").otherwise("unlisted")
    answered = requests.where(number % 5 != 0).select(
        number.alias("page_id"),
        F.when(number % 3 == 0, "no json").otherwise(F.lit('{"listings": []}')).alias("reply"),
        model.alias("model"),
        token_count(F.col("user_prompt")).alias("input_tokens"),
        number.cast("bigint").alias("output_tokens"),
    )
    return run_report(requests, answered, {"small": (0.5, 1.5), "large": (3.0, 12.25)})


def q_run_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page text through each sink and back: rows and characters, newlines not counted."""
    texts = pages.page_markdown(table(spark, sf_dir, "pages")).select(
        site_key(F.col("url")).alias("run_key"), F.replace(F.col("markdown"), F.lit("\n"), F.lit(" ")).alias("value")
    )
    folder = scratch_path(spark, "runs")
    counted = []
    for kind in ("raw", "json", "csv", "parquet"):
        path = write_run(texts, folder, kind, run_key="run_key")
        reader = spark.read.schema("value string, run_key string")
        if kind == "csv":
            reader = reader.option("header", "true").option("escape", '"')
        back = reader.format({"raw": "text"}.get(kind, kind)).load(path)
        counted.append(
            back.agg(
                F.lit(kind).alias("kind"),
                F.count("*").alias("rows"),
                F.countDistinct("run_key").alias("runs"),
                F.sum(F.length("value")).alias("chars"),
            )
        )
    result = counted[0]
    for more in counted[1:]:
        result = result.unionByName(more)
    return result


QUERIES = {
    "strip_chrome": q_strip_chrome,
    "page_blocks": q_page_blocks,
    "page_markdown": q_page_markdown,
    "page_links": q_page_links,
    "pagination_links": q_pagination_links,
    "resolve_url": q_resolve_url,
    "remove_urls": q_remove_urls,
    "site_key": q_site_key,
    "site_links": q_site_links,
    "clean_url": q_clean_url,
    "page_source": q_page_source,
    "crawl_frontier": q_crawl_frontier,
    "crawl_delta": q_crawl_delta,
    "page_number": q_page_number,
    "first_page": q_first_page,
    "token_count": q_token_count,
    "request_tokens": q_request_tokens,
    "token_cut": q_token_cut,
    "prompt_table": q_prompt_table,
    "pages_job": q_pages_job,
    "pages_run": q_pages_run,
    "run_report": q_run_report,
    "run_sinks": q_run_sinks,
}


# --- SQL checks -------------------------------------------------------------

_SITE = "regexp_replace(regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '^www\\.', ''), '\\W+', '_', 'g')"
_ORIGIN = "regexp_extract(url, '^[a-z]+://[^/?#]*')"


def _sql_markdown(html: str) -> str:
    """The same page text, one tag kind after the other."""
    steps = [
        (r"<header\b[^>]*>.*?</header\s*>", "''"),
        (r"<footer\b[^>]*>.*?</footer\s*>", "''"),
        (r"\s{2,}|[\t\n\r\f]", "' '"),
        (r"<!--.*?-->", "''"),
        (r"<head\b[^>]*>.*?</head\s*>", "''"),
        (r"<script\b[^>]*>.*?</script\s*>", "''"),
        (r"<style\b[^>]*>.*?</style\s*>", "''"),
        (r'<a\b[^>]*?\bhref="([^"]*)"[^>]*>(.*?)</a\s*>', r"'[\2](\1)'"),
        (r"</?(?:b|strong)\b[^>]*>", "'**'"),
        (r"<br\s*/?>", "chr(10)"),
        (r"<h1\b[^>]*>", "chr(10)||chr(10)||'# '"),
        (r"<li\b[^>]*>", "chr(10)||chr(10)||'  * '"),
        (r"</?(?:p|div|article|ul|nav|body|html|h1|li)\b[^>]*>", "chr(10)||chr(10)"),
        (r"<[^>]*>", "''"),
    ]
    text = html
    for pattern, replacement in steps:
        text = f"regexp_replace({text}, '{pattern}', {replacement}, 'gis')"
    for name, plain in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = f"replace({text}, '{name}', '{plain}')"
    blocks = f"regexp_split_to_array({text}, '\\n\\s*\\n')"
    trimmed = f"list_transform({blocks}, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g'))"
    return f"list_filter({trimmed}, lambda x: x <> '')"


_BLOCKS = _sql_markdown("html")
_TEXT = f"array_to_string({_BLOCKS}, chr(10)||chr(10))"
_SYSTEM = replies.system_text(replies.listing_schema(_FIELDS)).replace("'", "''")
_PREFIX = fixed.USER_PREFIX.replace("'", "''")
_TREE_DEPTH = "(select cast(ceil(log2(count(*) + 1)) as bigint) + 2 from pages)"


def _sql_nav_links(where: str) -> str:
    return f"""
with found as (
  select page_id, url, regexp_extract_all(regexp_extract(html, '<nav\\b[^>]*>(.*?)</nav\\s*>', 1, 'is'),
         '<a\\b[^>]*?\\bhref="([^"]*)"', 1, 'is') h from pages where {where}),
each as (select page_id, url, unnest(h) href, generate_subscripts(h, 1) p from found),
firsts as (select page_id, url, {_ORIGIN} || href dst_url, min(p) p from each group by all)
select page_id, url as src_url, cast(row_number() over (partition by page_id order by p) - 1 as int) as pos, dst_url
from firsts"""


_VISITED = f"""
with linked as (
  select p.page_id, p.url, replace(p.html, '<nav>', '<nav class="woocommerce-pagination">'
    || coalesce('<a href="' || a.url || '">a</a>', '') || coalesce('<a href="' || b.url || '">b</a>', '') || '</nav><nav>') as html
  from pages p left join pages a on a.page_id = 2 * p.page_id + 1 left join pages b on b.page_id = 2 * p.page_id + 2),
leveled as (select *, cast(floor(log2(page_id + 1)) as int) as level from linked),
visits as (
  select 0 as seed_pos, level as depth, * from leveled
  union all select 2, level, * from leveled
  union all select 1, level - 2, * from leveled where level >= 2 and (page_id + 1) >> (level - 2) = 6),
visited as (
  select row_number() over (order by seed_pos, depth, page_id) as file_no, seed_pos, depth, url, {_TEXT} as text from visits)"""

ORACLES = {
    "strip_chrome": r"""
select page_id, regexp_replace(regexp_replace(html, '<header\b[^>]*>.*?</header\s*>', '', 'gis'),
  '<footer\b[^>]*>.*?</footer\s*>', '', 'gis') as html from pages""",
    "page_blocks": f"""
with b as (select page_id, {_BLOCKS} as bs from pages),
e as (select page_id, unnest(bs) as text, generate_subscripts(bs, 1) - 1 as n from b)
select page_id, cast(n as int) as block_no,
  case when regexp_matches(text, '^#{{1,6}} ') then 'heading' when starts_with(text, '* ') then 'item' else 'text' end as kind,
  text from e""",
    "page_markdown": f"select page_id, {_TEXT} as markdown from pages",
    "page_links": _sql_nav_links("true"),
    "pagination_links": _sql_nav_links("starts_with(url, 'http:')"),
    "resolve_url": rf"""
with p as (select page_id, url, {_ORIGIN} as origin, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) as path,
  regexp_extract(url, '^([^#]*)', 1) as bare, regexp_extract(url, '^[^?#]*') as whole from pages),
f as (select page_id, url, origin, bare, whole, regexp_extract(url, '^[a-z]+:') as scheme,
  regexp_extract(path, '^(.*/)[^/]*$', 1) as folder from p),
h as (select *, unnest([{', '.join(repr(h) for h in _HREFS)}]) as href from f)
select page_id, href, case href
  when '?page=2' then whole || href
  when '#part' then bare || href
  when '/root' then origin || href
  when 'next' then origin || case when folder = '' then '/' else folder end || href
  when '../up' then origin || case when length(folder) < 2 then '/' else regexp_replace(folder, '[^/]+/$', '') end || 'up'
  when './a/./b/../c' then origin || case when folder = '' then '/' else folder end || 'a/c'
  when '//other.example.org/x' then scheme || href
  else href end as resolved from h""",
    "remove_urls": r"""
with t as (select 'document' as kind, doc_id as id, 'see (https://' || source || '.example.org/a_b?c=1#d), ' || text as text from documents
  union all select 'page', page_id, url from pages
  union all select 'long', page_id, url || repeat('/path%20a', 600) || ' end' from pages)
select kind, id, regexp_replace(text, 'http[s]?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\\(\\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+', '', 'g') as text from t""",
    "site_key": rf"""
select page_id, {_SITE} as site,
  regexp_replace(regexp_extract(url, '^[a-z]+://([^/]*)', 1), '\W+', '_', 'g') as site_www,
  {_SITE} || '_2024_01_02__03_04_05' as run_key from pages""",
    "site_links": rf"""
with l as (select {_SITE} as site, len(list_distinct(regexp_extract_all(
    regexp_extract(html, '<nav\b[^>]*>(.*?)</nav\s*>', 1, 'is'), '<a\b[^>]*?\bhref="([^"]*)"', 1, 'is'))) as links from pages)
select site, count(*) as pages, cast(sum(links) as bigint) as links from l group by 1""",
    "clean_url": "select page_id, replace(url || '&via=http://x.example.org', 'http://', 'https://') as url from pages",
    "page_source": """
with s as (select page_id * 3 + p as seed_pos, case when p < 2 then url else replace(url, 'http://', 'https://') end as url
  from pages cross join (values (0), (1), (2)) v(p))
select seed_pos, s.url, page_id, length(html) as size from s left join pages using (url)""",
    "crawl_frontier": f"""
with recursive e as (select page_id as src, unnest([2*page_id+1, 2*page_id+2, page_id, 0]) as dst from pages),
r(seed_pos, id, depth) as (
  select * from (values (0, 0, 0), (1, 5, 0), (2, 0, 0)) union
  select seed_pos, dst, depth + 1 from r join e on e.src = r.id join pages p on p.page_id = dst where depth < {_TREE_DEPTH})
select seed_pos, url, cast(min(depth) as int) as depth from r join pages on page_id = id group by 1, 2""",
    "page_number": "select url, page_id, row_number() over (order by url, page_id) as n from pages",
    "first_page": f"select page_id, url, {_TEXT} as markdown from (select * from pages order by url, page_id limit 1)",
    "token_count": r"select doc_id, len(regexp_extract_all(text, '[^\s\pZ\x0b\x1c-\x1f\x85]+')) as tokens from documents",
    "request_tokens": r"""
select conv_id, cast(sum(len(regexp_extract_all(text, '[^\s\pZ\x0b\x1c-\x1f\x85]+'))) as bigint) as tokens
from conversations group by 1""",
    "token_cut": r"""
with c as (select doc_id, text, regexp_extract_all(text, '[\s\pZ\x0b\x1c-\x1f\x85]*[^\s\pZ\x0b\x1c-\x1f\x85]+') as w from documents)
select doc_id, case when len(w) <= 100 then text else array_to_string(w[1:100], '') end as text from c""",
    "prompt_table": f"select doc_id, '{_SYSTEM}' as system_prompt, '{_PREFIX}' || text as user_prompt from documents",
    "pages_job": f"{_VISITED} select file_no, seed_pos, depth, url, '{_PREFIX}' || text as user_prompt from visited",
    "pages_run": f"""{_VISITED},
named as (select regexp_replace(regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '^www\\.', ''), '\\W+', '_', 'g')
  || '_2024_01_02__03_04_05' as run from visited where file_no = 1)
select run, file_no, seed_pos, url, length(text) as chars, length('{_PREFIX}' || text) as prompt_chars from visited, named""",
    "run_report": f"""{_VISITED},
calls as (
  select seed_pos, file_no % 5 <> 0 as answered, file_no % 3 = 0 as bad, file_no,
    len(regexp_extract_all('{_PREFIX}' || text, '[^\\s\\pZ\\x0b\\x1c-\\x1f\\x85]+')) as words from visited)
select seed_pos, count(*) as pages, count(*) filter (answered) as calls,
  cast(coalesce(sum(words) filter (answered and not bad), 0) as bigint) as input_tokens,
  cast(coalesce(sum(file_no) filter (answered and not bad), 0) as bigint) as output_tokens,
  coalesce(sum(words * case seed_pos when 0 then 0.5 when 1 then 3.0 end + file_no * case seed_pos when 0 then 1.5 when 1 then 12.25 end)
    filter (answered and not bad), 0)::double as cost,
  count(*) filter (answered and seed_pos = 2) as unpriced_calls, count(*) filter (answered and bad) as failed
from calls group by 1""",
    "run_sinks": f"""
with t as (select {_SITE} as run_key, replace({_TEXT}, chr(10), ' ') as value from pages)
select kind, count(*) as rows, count(distinct run_key) as runs, cast(sum(length(value)) as bigint) as chars
from t cross join (values ('raw'), ('json'), ('csv'), ('parquet')) k(kind) group by 1""",
}
ORACLES["crawl_delta"] = ORACLES["crawl_frontier"]  # batches change nothing
