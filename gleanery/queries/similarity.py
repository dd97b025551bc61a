"""Queries on similar vectors and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.operators import similarity
from gleanery.queries.tables import table

_COSINE = 0.4  # no pair of the given vectors reaches the standard 0.8
_RATIO = 0.7


def q_cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = similarity.cosine_pairs(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), _COSINE)
    return pairs.select("id_a", "id_b", F.round("cosine", 6).alias("cosine"))


def q_vector_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.copies(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding")


def q_string_ratio_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return similarity.string_ratio_pairs(parts, "p_partkey", "p_name", _RATIO)


def q_text_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows behind each name that ``string_ratio_pairs`` compares."""
    return similarity.copies(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey", "p_name")


QUERIES = {
    "cosine_pairs": q_cosine_pairs,
    "vector_copies": q_vector_copies,
    "string_ratio_pairs": q_string_ratio_pairs,
    "text_copies": q_text_copies,
}


# --- SQL checks -------------------------------------------------------------

ORACLES = {
    "cosine_pairs": """
with d as (select min(vec_id) as id, embedding::double[] as v from embeddings group by embedding)
select a.id as id_a, b.id as id_b, round(list_cosine_similarity(a.v, b.v), 6) as cosine
from d a join d b on a.id <> b.id where list_cosine_similarity(a.v, b.v) > 0.4""",
    "vector_copies": "select vec_id, min(vec_id) over (partition by embedding) as rep from embeddings",
    # Longest common block first (least place of it), then left and right of it: one segment per row.
    "string_ratio_pairs": """
with recursive n as (select p_name as s, min(p_partkey) as id from part group by p_name),
seg as (
  select a.id as ia, b.id as ib, a.s as sa, b.s as sb, cast(0 as bigint) as alo, length(a.s) as ahi, cast(0 as bigint) as blo, length(b.s) as bhi,
    cast(0 as bigint) as k
  from n a join n b on a.id <> b.id
  union all
  select t.ia, t.ib, t.sa, t.sb, case half when 0 then t.alo else t.i + t.m end, case half when 0 then t.i else t.ahi end,
    case half when 0 then t.blo else t.j + t.m end, case half when 0 then t.j else t.bhi end, case half when 0 then t.m else 0 end
  from (
    select s.*, hit.best.i as i, hit.best.j as j, -hit.best.neg as m
    from seg s, lateral (
      select min({'neg': -k, 'i': i, 'j': j}) as best
      from (select unnest(range(s.alo, s.ahi)) as i) x, (select unnest(range(s.blo, s.bhi)) as j) y,
        (select unnest(range(1, least(s.ahi - s.alo, s.bhi - s.blo) + 1)) as k) z
      where i + k <= s.ahi and j + k <= s.bhi and substr(s.sa, i + 1, k) = substr(s.sb, j + 1, k)) hit
    where hit.best is not null) t, (values (0), (1)) h(half))
select ia as id_a, ib as id_b, 2.0::double * sum(k) / (length(any_value(sa)) + length(any_value(sb))) as ratio
from seg group by ia, ib having 2.0::double * sum(k) / (length(any_value(sa)) + length(any_value(sb))) > 0.7""",
    "text_copies": "select p_partkey, min(p_partkey) over (partition by p_name) as rep from part",
}
