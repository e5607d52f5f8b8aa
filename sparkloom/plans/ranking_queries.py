"""Queries on ranked lists: coverage, diversity, late interaction, fusion of channels, topics of memories."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions.text import HAN
from sparkloom.functions.vectors import doubles
from sparkloom.operators import memory as M
from sparkloom.operators import retrieval as R
from sparkloom.plans.registry import query
from sparkloom.plans.retrieval_queries import BM25, NONE, _bm25, sql_marginal, sql_rerank_tokens
from sparkloom.plans.table_queries import MEMORY_SCORES
from sparkloom.plans.text_queries import sql_topic_terms
from sparkloom.tables import stored, table, texts

VECTORS = """v as (select vec_id as id, label, embedding::double[] as v from embeddings),
 s as (select q.id as query_id, q.label as own, v.id, v.label, list_cosine_similarity(v.v, q.v) as score from v, v q where q.id % 100 = 0),
 t as (select *, row_number() over (partition by query_id order by score desc, id) as rank from s where score > 0 qualify rank <= 20)"""
PAIRS = "p as (select a.query_id, a.id, b.id as other, greatest(0, list_cosine_similarity(x.v, y.v)) as alike from t a join t b on a.query_id = b.query_id and a.id <> b.id join v x on x.id = a.id join v y on y.id = b.id)"


def _vectors(spark, sf_dir):
    """Vectors with their labels, and the 20 nearest of every vector whose id is divisible by 100."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", doubles("embedding").alias("vector"))
    asked = rows.where("id % 100 = 0").withColumnRenamed("id", "query_id")
    return rows, asked, stored(R.dense(rows, asked, 20).join(rows.select("id", "label"), "id"))


def _required(asked):
    """The labels that the results of a query have to show: its own and the next one."""
    return asked.select("query_id", F.explode(F.array(F.col("label"), (F.col("label") + 1) % 10)).alias("label"))


@query(
    f"with {VECTORS}, a as (select *, row_number() over (partition by query_id, label order by rank) = 1 and label in (own, (own + 1) % 10) as ahead from t)"
    " select query_id, id, label, place as rank from (select query_id, id, label, row_number() over (partition by query_id order by ahead desc, case when ahead then label end, rank) as place from a) where place <= 5"
)
def required_first(spark, sf_dir):
    """The best result of each required label first, then the others by rank."""
    _, asked, found = _vectors(spark, sf_dir)
    return R.first_of_required(found, _required(asked), "label", 5)


@query(f"with {VECTORS}, {PAIRS}, {sql_marginal(NONE, 5, 0.72)} select query_id, id, place as rank from m5")
def vector_mmr(spark, sf_dir):
    """Five of the 20 nearest vectors by maximal marginal relevance."""
    rows, _, found = _vectors(spark, sf_dir)
    return R.diversify(found, rows, 5).select("query_id", "id", "rank")


@query(
    f"""with {VECTORS}, {PAIRS}, top as (select query_id, max(score) as top from t group by query_id),
 c as (select query_id, id, rank, case when label = own then 0 else 1 end as claim from t where label in (own, (own + 1) % 10) qualify row_number() over (partition by query_id, claim order by rank) = 1),
 {sql_marginal("select query_id, id, row_number() over (partition by query_id order by claim) as place from c", 5, 0.72, "score / (select top from top where top.query_id = t.query_id)")}
 select query_id, id, place as rank from m5"""
)
def covering_mmr(spark, sf_dir):
    """The query's own label and the next one are claims that the results have to meet; the rest goes by maximal marginal relevance."""
    rows, asked, found = _vectors(spark, sf_dir)
    own = asked.select("query_id", F.col("label").alias("own"))
    claim = F.when(F.col("label") == F.col("own"), F.array(F.lit(0))).when(F.col("label") == (F.col("own") + 1) % 10, F.array(F.lit(1)))
    return R.cover(found.join(own, "query_id").withColumn("claims", claim), rows, 5).select("query_id", "id", "rank")


@query(
    rf"""with {BM25.replace("rank <= 30", "rank <= 5")},
 d as (select doc_id, unnest({sql_rerank_tokens("concat_ws(chr(10), title, text)")}) as token from documents where doc_id in (select id from bm25 union select query_id from bm25)),
 a as (select doc_id, unnest({sql_rerank_tokens("text")}) as token from documents where doc_id in (select query_id from bm25)),
 w as (select token, unnest(regexp_extract_all(token, '[\p{{L}}\p{{N}}_一-鿿]+')) as w from (select distinct token from (select token from d union all select token from a))),
 b as (select token, ('0x' || substring(sha256(w), 1, 8))::bigint % 384 as bucket, sum(case when ('0x' || substring(sha256(w), 9, 2))::bigint % 2 = 0 then 1.0 else -1.0 end) as x from w group by all),
 u as (select token, bucket, x / sqrt(sum(x * x) over (partition by token)) as x from b qualify sum(x * x) over (partition by token) > 0),
 alike as (select g.query_id, g.id, a.token, d.token as other, sum(ua.x * ud.x) as c from bm25 g join a on a.doc_id = g.query_id join u ua on ua.token = a.token join u ud on ud.bucket = ua.bucket join d on d.doc_id = g.id and d.token = ud.token group by all),
 n as (select doc_id as id, count(*) as n from d group by doc_id),
 best as (select g.query_id, g.id, a.token, case when any_value(n.n) is null then 0 when count(alike.other) < any_value(n.n) then greatest(0, coalesce(max(c), 0)) else max(c) end as c
  from bm25 g join a on a.doc_id = g.query_id left join n on n.id = g.id left join alike on alike.query_id = g.query_id and alike.id = g.id and alike.token = a.token group by g.query_id, g.id, a.token)
 select g.query_id, g.id, round(greatest(0, coalesce(avg(best.c), 0)), 9) as score from bm25 g left join best using (query_id, id) group by g.query_id, g.id"""
)
def late_interaction(spark, sf_dir):
    """The five best documents of sparse search by the best matches of the query's tokens, all tokens of whole texts."""
    docs = texts(spark, sf_dir)
    return R.late_interaction(_bm25(spark, sf_dir, 5), R.query_set(docs), docs, 5).select("query_id", "id", F.round("score", 9).alias("score"))


@query(
    f"""with {BM25}, {VECTORS.replace("<= 20", "<= 30")}, own as (select *, row_number() over (partition by query_id order by score desc, id) as place from s where score > 0 and label = own qualify place <= 30),
 merged as (select query_id, id, rank, 'bm25' as channel from bm25 union all select query_id, id, rank, 'vector' from t union all select query_id, id, place, 'own label' from own)
 select query_id, id, round(sum(1.0 / (60 + rank)), 9) as score, list_sort(list(channel)) as channels from merged group by query_id, id
 qualify row_number() over (partition by query_id order by round(sum(1.0 / (60 + rank)), 12) desc, count(*) desc, id) <= 20"""
)
def fused_channels(spark, sf_dir):
    """Three channels fused by rank, with the names of those that found a row; of equal scores the one that more channels found comes first."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", doubles("embedding").alias("vector"))
    asked = rows.where("id % 100 = 0").withColumnRenamed("id", "query_id")
    channels = {"bm25": _bm25(spark, sf_dir), "vector": R.dense(rows, asked, 30), "own label": R.dense_in_group(rows, asked, "label", 30)}
    return R.fuse_by_hits(channels, 20).select("query_id", "id", F.round("score", 9).alias("score"), "channels")


@query(
    f"""with m as (select distinct on (memory_id) memory_id, memory_type, created_at, list_distinct(list_filter(coalesce(tags, []), lambda t: t like 'topic:%')) as topics, {sql_topic_terms("coalesce(content, '')")} as terms
  from memories where status = 'active' and memory_type in ('decision', 'preference') and memory_id is not null order by memory_id, updated_at desc),
 p as (select a.memory_id, arg_max(b.memory_id, (b.created_at, b.memory_id)) as superseded_by from m a join m b on a.memory_type = b.memory_type and (b.created_at, b.memory_id) > (a.created_at, a.memory_id)
  where case when len(a.topics) > 0 and len(b.topics) > 0 then list_has_any(a.topics, b.topics) else len(list_intersect(a.terms, b.terms)) / greatest(1, least(len(a.terms), len(b.terms))) >= 0.65 end group by a.memory_id)
 select memory_id, superseded_by from m left join p using (memory_id)"""
)
def topic_conflicts(spark, sf_dir):
    """Active decisions and preferences with the newest later one of the same topic, by tags or by shared terms."""
    return M.conflicts(table(spark, sf_dir, "memories"))


@query(
    f"""with {MEMORY_SCORES},
 t as (select query_id, id, score, row_number() over (partition by query_id order by score desc, id) as rank from r where score > 0.08 qualify rank <= 20),
 words as (select distinct on (memory_id) memory_id, list_distinct(regexp_extract_all(lower(coalesce(content, '')), '[a-z0-9_]+|[{HAN}]{{2}}')) as w from memories order by memory_id),
 p as (select a.query_id, a.id, b.id as other, len(list_intersect(x.w, y.w)) / greatest(1, len(list_distinct(list_concat(x.w, y.w)))) as alike from t a join t b on a.query_id = b.query_id and a.id <> b.id join words x on x.memory_id = a.id join words y on y.memory_id = b.id),
 {sql_marginal(NONE, 5, 0.7)} select query_id, id, place as rank from m5"""
)
def memory_mmr(spark, sf_dir):
    """Of the 20 best memories for every document whose id is divisible by 100, five of high score and little likeness."""
    docs = table(spark, sf_dir, "documents").where("doc_id % 100 = 0 and title is not null").select(F.col("doc_id").alias("query_id"), "title")
    memories = table(spark, sf_dir, "memories")
    return M.diverse(stored(M.search(docs, "title", memories, 20)), memories, 5).select("query_id", "id", "rank")
