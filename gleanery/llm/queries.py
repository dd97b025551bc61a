"""Registered queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm import (
    benchmark,
    divergence,
    interactions,
    packing,
    pieces,
    quality,
    shards,
    simhash,
    substring,
    suffixes,
    tokens,
    toxicity,
    urlgraph,
)
from gleanery.queries.tables import table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return result.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pieces.digests(pieces.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model")))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.place(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlgraph.judge_urls(table(spark, sf_dir, "pages"))


def op8_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = suffixes.remove_shared_bytes(table(spark, sf_dir, "documents"))
    return result.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return result.select("doc_id", simhash.hex_digits().alias("fingerprint"), "component_id")


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_toxicity": op3_toxicity,
    "op4_token_counts": op4_token_counts,
    "op5_hilbert_shards": op5_hilbert_shards,
    "op6_quality_rules": op6_quality_rules,
    "op7_url_filters": op7_url_filters,
    "op8_suffix_array": op8_suffix_array,
    "op9_simhash": op9_simhash,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    "op11_filter_interactions": op11_filter_interactions,
    "op12_source_divergence": op12_source_divergence,
    "op13_lexical_packing": op13_lexical_packing,
}

_SPACE = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]"

ORACLES: dict[str, str] = {
    "op6_quality_rules": rf"""
with d as (
  select doc_id, coalesce(source, '') as source, text, coalesce(text, '') as t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '') as ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) as ls
  from documents),
windows as (
  select doc_id, i, count(*) over (partition by doc_id, win) as c
  from (select doc_id, i, array_to_string(ws[i:i + 7], ' ') as win
    from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 6, 1))) as i from d) x) y),
repeated as (
  select doc_id, count(distinct i + k) as n from windows, (select unnest(range(8)) as k) r where c > 1 group by doc_id),
texts as (select distinct source, text, ls from d where text is not null),
lines as (
  select source, text, len(list_filter(regexp_split_to_array(line, '{_SPACE}'), lambda x: x <> '')) as w,
    regexp_replace(trim(regexp_replace(lower(line), '{_SPACE}', ' ', 'g')), '[0-9]+', '0', 'g') as norm
  from (select source, text, unnest(ls) as line from texts) x),
often as (
  select source, norm from (select source, norm, count(distinct text) as n from lines group by 1, 2) h
  join (select source, count(*) as texts from texts group by 1) s using (source)
  where n >= 20 and n * n > texts),
lost as (select source, text, cast(sum(w) as bigint) as n from lines join often using (source, norm) group by 1, 2),
counted as (
  select d.doc_id, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols,
    len(ls) - len(list_distinct(ls)) as n_dup_lines, coalesce(r.n, 0) as n_repeat_words, coalesce(l.n, 0) as removed_words
  from d left join repeated r on d.doc_id = r.doc_id left join lost l on d.source = l.source and d.text = l.text)
select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
  not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and removed_words <= 0.5 * n_words
    and n_words - removed_words >= 20 as kept
from counted""",
    "op11_filter_interactions": rf"""
with w as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '') as ws
  from documents),
least as (select coalesce(text, '') as t, min(coalesce(doc_id, 9223372036854775807)) as least from documents group by 1),
lab as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic
  from labels where doc_id is not null group by 1),
f as (
  select w.part, coalesce(lab.good, 0) as good, coalesce(lab.toxic, 0) as toxic,
    (len(ws) < 100)::int + 2 * (100 * len(list_distinct(ws)) < 80 * len(ws))::int
    + 4 * (100 * (length(w.t) - length(regexp_replace(w.t, '[A-Z]', '', 'g'))) > 10 * length(w.t))::int
    + 8 * (regexp_matches(w.t, '[#$%&*|]'))::int
    + 16 * (coalesce(w.doc_id, 9223372036854775807) > least.least)::int as m
  from w join least on w.t = least.t left join lab on w.doc_id = lab.doc_id),
masks as (select part, m, count(*) as n, sum(good) as good, sum(toxic) as toxic from f group by 1, 2),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
orders as (
  select a.x || b.x || c.x || d.x || e.x as filter_order
  from letters a, letters b, letters c, letters d, letters e
  where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps as (
  select filter_order, step, substr(filter_order, step, 1) as x,
    list_sum([0] || list_transform(string_split(substr(filter_order, 1, step - 1), ''),
      lambda y: case when y = '' then 0 else 1 << (ascii(y) - 65) end))::int as before
  from orders, (select unnest(range(1, 6))::int as step) s),
bits as (select *, 1 << (ascii(x) - 65) as bit from steps),
counted as (
  select part, filter_order, step, x,
    sum(case when m & (before | bit) = 0 then n else 0 end)::bigint as kept,
    sum(case when m & bit > 0 and m & before = 0 then n else 0 end)::bigint as removed,
    sum(case when m & bit > 0 and m & before > 0 then n else 0 end)::bigint as redundant,
    sum(case when m = bit then n else 0 end)::bigint as unique_fails,
    sum(case when m & bit > 0 and m & before = 0 then good else 0 end)::bigint as good_lost,
    sum(case when m & bit > 0 and m & before = 0 then toxic else 0 end)::bigint as toxic_lost
  from masks, bits group by 1, 2, 3, 4)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  sum(removed) over (partition by part, x)::bigint as shapley
from counted
""",
    "op12_source_divergence": r"""
with d as (
  select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x{00}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+') as ts
  from documents),
held as (select r, lang, source, unnest(ts) as term from d),
kept as (select lang, term from held group by 1, 2 having count(distinct r) >= 10),
groups as (select distinct lang, source from d),
counts as (select lang, source, term, count(*) as n from held semi join kept using (lang, term) group by 1, 2, 3),
size as (select g.lang, count(k.term) as v from (select distinct lang from d) g left join kept k using (lang) group by 1),
every as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n
  from groups g join kept k using (lang) left join counts c using (lang, source, term)),
p as (
  select e.*, 1 + (1000000000::hugeint * (n + 2)) // (sum(n) over (partition by e.lang, e.source) + 2 * v) as p
  from every e join size using (lang)),
whole as (select lang, term, sum(n) as n from every group by 1, 2),
q as (
  select w.lang, term, 1 + (1000000000::hugeint * (n + 2)) // (sum(n) over (partition by w.lang) + 2 * v) as q
  from whole w join size using (lang)),
pairs as (
  select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value
  from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
every_pair as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(x.value, 0)::bigint as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join pairs x on x.lang = a.lang and x.source = a.source and x.item = b.source),
terms as (
  select lang, source, 'term' as part, term as item, (((p - q) * (p - q)) // (p + q))::bigint as value
  from p join q using (lang, term) where n > 0 and p > q),
ranked as (
  select *, row_number() over (partition by lang, source, part order by value desc, item) as rank
  from (select * from every_pair union all select * from terms) x)
select lang, source, part, item, value, rank::int as rank from ranked where part = 'pair' or rank <= 10
""",
}
