"""Queries of search: every row whose id is divisible by 100, against all rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import text as X
from sparkloom.functions.text import HAN
from sparkloom.functions.vectors import cosine, doubles
from sparkloom.operators import retrieval as R
from sparkloom.plans.registry import query
from sparkloom.plans.text_queries import sql_collapse, sql_sentences
from sparkloom.tables import stored, table, texts


def sql_terms(x: str) -> str:
    """The tokens of sparse search."""
    pairs = f"flatten(list_transform(regexp_extract_all(lower({x}), '[{HAN}]{{2,}}'), lambda r: list_transform(range(1, length(r)), lambda i: substring(r, i, 2))))"
    return f"list_concat(regexp_extract_all(lower({x}), '[a-z0-9_.@+-]{{2,}}'), {pairs})"


BM25 = f"""
docs as (select doc_id as id, {sql_terms("coalesce(title, '')")} as title, {sql_terms("coalesce(text, '')")} as body from documents),
stats as (select count(*) as n, avg(len(title) + len(body)) as average from docs),
long as (select id, unnest(title) as term, 2.5 as w from docs union all select id, unnest(body), 1.0 from docs),
tf as (select id, term, sum(w) as tf from long group by id, term),
df as (select term, count(*) as df from tf group by term),
firsts as (select doc_id as query_id, unnest({sql_terms("text")}) as term, generate_subscripts({sql_terms("text")}, 1) as pos from documents where doc_id % 100 = 0 and text is not null),
terms as (select query_id, term, row_number() over (partition by query_id order by min(pos)) as place from firsts group by query_id, term),
q as (select query_id, term from terms where place <= 40),
scored as (
  select q.query_id, tf.id, sum(case when ln((n - df + 0.5) / (df + 0.5)) > 0 then ln((n - df + 0.5) / (df + 0.5)) else 1e-6 end
    * tf.tf * 2.2 / (tf.tf + 1.2 * (0.25 + 0.75 * (len(d.title) + len(d.body)) / average))) as score
  from q join tf using (term) join df using (term) join docs d on d.id = tf.id cross join stats group by q.query_id, tf.id),
bm25 as (select *, row_number() over (partition by query_id order by score desc, id) as rank from scored qualify rank <= 30)"""

#: Hybrid search: hashed word vectors as whole numbers per bucket, so that equal texts have equal scores; their 30 nearest fused with BM25.
HYBRID = rf"""{BM25},
hv as (
  select doc_id, ('0x' || substring(sha256(w), 1, 8))::bigint % 384 as bucket, sum(case when ('0x' || substring(sha256(w), 9, 2))::bigint % 2 = 0 then 1 else -1 end)::bigint as x
  from (select doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_一-鿿]+')) as w from documents) group by all),
nv as (select doc_id, sum(x * x)::bigint as n from hv group by doc_id having sum(x * x) > 0),
near as (
  select a.doc_id as query_id, b.doc_id as id, sum(a.x * b.x)::bigint as dot from hv a join hv b using (bucket) where a.doc_id in (select query_id from q) group by all),
hd as (
  select query_id, id, row_number() over (partition by query_id order by dot / sqrt(a.n * b.n::double) desc, id) as rank
  from near join nv a on a.doc_id = query_id join nv b on b.doc_id = id where dot / sqrt(a.n * b.n::double) > 0.08 qualify rank <= 30),
fused as (
  select query_id, id, sum(1.0::double / (60 + rank)) as score, max(case when channel = 'bm25' then rank end) as bm25_rank, max(case when channel = 'dense' then rank end) as dense_rank
  from (select query_id, id, rank, 'bm25' as channel from bm25 union all select query_id, id, rank, 'dense' from hd) group by query_id, id),
hybrid as (select *, row_number() over (partition by query_id order by score desc, id) as rank from fused qualify rank <= 30)"""


def sql_marginal(start: str, k: int, weight: float, score: str = "score") -> str:
    """Steps m1 to mk of maximal marginal relevance over t (query_id, id, score, rank) and p (query_id, id, other, alike), after the rows of ``start``."""
    steps = [f"m0 as ({start})"]
    for i in range(1, k + 1):
        steps.append(f"""m{i} as (select * from m{i - 1} union all select query_id, id, place from (
   select t.query_id, t.id, t.rank, any_value(c.n) + 1 as place, {weight} * any_value({score}) - (1 - {weight}) * coalesce(max(alike), 0) as gain
   from t left join (select query_id, count(*) as n from m{i - 1} group by query_id) c0 using (query_id) cross join lateral (select coalesce(c0.n, 0) as n) c
   left join (select p.query_id, p.id, p.alike from p join m{i - 1} m on m.query_id = p.query_id and m.id = p.other) x on x.query_id = t.query_id and x.id = t.id
   where c.n < {k} and not exists (select 1 from m{i - 1} y where y.query_id = t.query_id and y.id = t.id) group by t.query_id, t.id, t.rank)
  qualify row_number() over (partition by query_id order by gain desc, rank) = 1)""")
    return ",\n ".join(steps)


NONE = "select query_id, id, 0 as place from t where false"


def sql_rerank_tokens(x: str) -> str:
    pairs = f"flatten(list_transform(regexp_extract_all(lower({x}), '[{HAN}]{{3,}}'), lambda r: list_transform(range(1, length(r)), lambda i: substring(r, i, 2))))"
    return f"list_distinct(list_concat(regexp_extract_all(lower({x}), '[a-z][a-z0-9_.+-]+|[{HAN}]{{2,}}'), {pairs}))"


RERANKED = rf"""{HYBRID},
bodies as (select doc_id as id, lower(concat_ws(chr(10), title, text)) as body, {sql_rerank_tokens("coalesce(title, '')")} as names from documents where doc_id in (select id from hybrid)),
padded as (select *, ' ' || regexp_replace(body, '[^a-z0-9]+', ' ', 'g') || ' ' as words from bodies),
wants as (select doc_id as query_id, {sql_rerank_tokens("text")} as wanted, array_to_string(regexp_extract_all(lower(text), '[a-z0-9_.+-]+'), ' ') as phrase from documents where doc_id in (select query_id from q)),
held as (
  select query_id, id, count(*) as held from (select query_id, unnest(wanted) as t from wants) join hybrid using (query_id) join padded using (id)
  where case when regexp_full_match(t, '[a-z0-9]+') then contains(words, ' ' || t || ' ') when not contains(body, t) then false
   when regexp_full_match(t, '[a-z0-9_.+-]+') then regexp_matches(body, '(^|[^a-z0-9])' || regexp_escape(t) || '([^a-z0-9]|$)') else true end group by all),
rescored as (
  select query_id, id, h.score as before, least(1.0::double, 0.72::double * (coalesce(held, 0) / greatest(1, len(wanted))) + 0.16::double * (len(list_intersect(names, wanted)) / greatest(1, len(wanted)))
    + case when length(phrase) >= 6 and contains(body, phrase) then 0.12::double else 0 end) as score
  from hybrid h join padded using (id) join wants using (query_id) left join held using (query_id, id)),
reranked as (select query_id, id, score, row_number() over (partition by query_id order by score desc, before desc, id) as rank from rescored qualify rank <= 12)"""


def _bm25(spark, sf_dir, k=30):
    docs = texts(spark, sf_dir)
    return R.bm25(docs, R.query_set(docs), k)


@query(f"with {BM25} select query_id, id, round(score, 6) as score from bm25 where rank <= 10")
def bm25_topk(spark, sf_dir):
    return _bm25(spark, sf_dir, 10).select("query_id", "id", F.round("score", 6).alias("score"))


@query(
    """with q as (select vec_id as query_id, embedding::double[] as v from embeddings where vec_id % 100 = 0),
 s as (select query_id, e.vec_id as id, greatest(0, list_cosine_similarity(e.embedding::double[], q.v)) as score from embeddings e, q)
 select query_id, id, round(score, 9) as score from s where score > 0 qualify row_number() over (partition by query_id order by score desc, id) <= 10"""
)
def dense_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), doubles("embedding").alias("vector"))
    queries = rows.where("id % 100 = 0").withColumnRenamed("id", "query_id")
    return R.dense(rows, queries, 10).select("query_id", "id", F.round("score", 9).alias("score"))


@query(
    """with q as (select vec_id as query_id, label, embedding::double[] as v from embeddings where vec_id % 100 = 0),
 s as (select query_id, e.vec_id as id, e.label, list_cosine_similarity(e.embedding::double[], q.v) as score from embeddings e join q on e.label = q.label)
 select query_id, id, label, round(score, 9) as score from s where score > 0 qualify row_number() over (partition by query_id order by score desc, id) <= 5"""
)
def space_topk(spark, sf_dir):
    """Only vectors of the query's own space."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", doubles("embedding").alias("vector"))
    return R.dense_in_group(rows, rows.where("id % 100 = 0").withColumnRenamed("id", "query_id"), "label", 5).select("query_id", "id", "label", F.round("score", 9).alias("score"))


@query(
    """with t as (select doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_一-鿿]+')) as w from documents),
 b as (select ('0x' || substring(sha256(w), 1, 8))::bigint % 384 as bucket, case when ('0x' || substring(sha256(w), 9, 2))::bigint % 2 = 0 then 1 else -1 end as sign from t)
 select bucket::int as bucket, count(*) as words, sum(sign)::double as balance from b group by bucket"""
)
def hash_bucket_histogram(spark, sf_dir):
    from sparkloom.functions.vectors import hash_buckets

    rows = texts(spark, sf_dir).select(F.explode(hash_buckets(F.coalesce("text", F.lit("")))).alias("b"))
    return rows.groupBy("b.bucket").agg(F.count("*").alias("words"), F.sum("b.sign").alias("balance"))


def hybrid(spark, sf_dir, k=30):
    """Query set, hash vectors and fused candidates: BM25 and hashed vectors, 30 each."""
    docs = texts(spark, sf_dir)
    queries = R.query_set(docs)
    vectors = stored(R.hash_vectors(docs))
    asked = vectors.join(queries.select(F.col("query_id").alias("id")), "id", "left_semi").withColumnRenamed("id", "query_id")
    channels = {"bm25": R.bm25(docs, queries, 30), "dense": R.dense(vectors, asked, 30, 0.08)}
    return docs, queries, vectors, stored(R.fuse(channels, k))


@query(f"with {HYBRID} select query_id, id, round(score, 9) as score, bm25_rank, dense_rank, rank from hybrid")
def hybrid_search(spark, sf_dir):
    """Fusion of sparse and dense search with the ranks of both."""
    found = hybrid(spark, sf_dir)[3]
    return found.select("query_id", "id", F.round("score", 9).alias("score"), *[F.col("ranks")[c].alias(f"{c}_rank") for c in ("bm25", "dense")], "rank")


@query(
    f"""with {BM25},
 v as (select vec_id as id, embedding::double[] as v from embeddings),
 s as (select q.id as query_id, v.id, list_cosine_similarity(v.v, q.v) as score from v, v q where q.id % 100 = 0),
 dense as (select *, row_number() over (partition by query_id order by score desc, id) as rank from s where score > 0 qualify rank <= 30),
 merged as (select query_id, id, rank from bm25 union all select query_id, id, rank from dense)
 select query_id, id, round(sum(1.0 / (60 + rank)), 9) as score from merged group by query_id, id qualify row_number() over (partition by query_id order by sum(1.0 / (60 + rank)) desc, id) <= 20"""
)
def rrf_fusion(spark, sf_dir):
    """BM25 of documents fused with given vectors of the same ids."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), doubles("embedding").alias("vector"))
    channels = {"bm25": _bm25(spark, sf_dir), "dense": R.dense(rows, rows.where("id % 100 = 0").withColumnRenamed("id", "query_id"), 30)}
    return R.fuse(channels, 20).select("query_id", "id", F.round("score", 9).alias("score"))


@query(f"with {RERANKED} select query_id, id, round(score, 9) as score, rank from reranked")
def lexical_rerank(spark, sf_dir):
    docs, queries, _, found = hybrid(spark, sf_dir)
    return R.rerank(found, queries, docs, 12).select("query_id", "id", F.round("score", 9).alias("score"), "rank")


@query(
    f"""with {RERANKED}, t as (select r.* from reranked r),
 p as (select a.query_id, a.id, b.id as other, greatest(0, coalesce((select sum(x.x * y.x)::double from hv x join hv y on x.bucket = y.bucket where x.doc_id = a.id and y.doc_id = b.id), 0) / sqrt(na.n * nb.n::double)) as alike
  from t a join t b on a.query_id = b.query_id and a.id <> b.id join nv na on na.doc_id = a.id join nv nb on nb.doc_id = b.id),
 {sql_marginal(NONE, 5, 0.72)} select query_id, id, round(t.score, 9) as score, place as rank from m5 join t using (query_id, id)"""
)
def diversified(spark, sf_dir):
    """The whole retrieval: recall, fusion, reranking and diversification."""
    docs, queries, vectors, found = hybrid(spark, sf_dir)
    return R.diversify(R.rerank(found, queries, docs, 12), vectors, 5).withColumn("score", F.round("score", 9))


@query(
    """with v as (select vec_id as id, label, embedding::double[] as v from embeddings),
 s as (select q.id as query_id, v.id, list_cosine_similarity(v.v, q.v) as score from v, v q where q.id % 100 = 0),
 t as (select *, row_number() over (partition by query_id order by score desc, id) as rank from s where score > 0 qualify rank <= 10),
 p as (select a.query_id, greatest(0, list_cosine_similarity(x.v, y.v)) as c from t a join t b on a.query_id = b.query_id and a.rank < b.rank join v x on x.id = a.id join v y on y.id = b.id)
 select query_id, round(avg(c), 9) as redundancy from p group by query_id"""
)
def result_redundancy(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), doubles("embedding").alias("vector"))
    found = stored(R.dense(rows, rows.where("id % 100 = 0").withColumnRenamed("id", "query_id"), 10))
    return R.redundancy(found, rows).select("query_id", F.round("redundancy", 9).alias("redundancy"))


@query(
    """with v as (select vec_id as id, label, embedding::double[] as v from embeddings),
 s as (select q.id as query_id, v.id, v.label = q.label as same, list_cosine_similarity(v.v, q.v) as score from v, v q where q.id % 100 = 0),
 t as (select *, row_number() over (partition by query_id order by score desc, id) as rank from s where score > 0 qualify rank <= 10),
 g as (select q.id as query_id, count(*) as gold from v, v q where q.id % 100 = 0 and v.label = q.label group by q.id)
 select query_id, round(sum(same::int) / count(*), 9) as precision, round(sum(same::int) / any_value(gold), 9) as recall, round(coalesce(1 / min(case when same then rank end), 0), 9) as mrr,
  round(sum(same::int / log2(rank + 1)) / any_value(list_sum(list_transform(range(1, least(gold, 10) + 1), lambda i: 1 / log2(i + 1)))), 9) as ndcg from t join g using (query_id) group by query_id"""
)
def rank_metrics(spark, sf_dir):
    """How well vector search finds the vectors of the query's label."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", doubles("embedding").alias("vector"))
    queries = rows.where("id % 100 = 0").select(F.col("id").alias("query_id"), "label", "vector")
    golds = queries.select("query_id", "label").join(rows.groupBy("label").agg(F.count("*").alias("gold")), "label")
    found = R.dense(rows, queries, 10).join(rows.select("id", F.col("label").alias("seen")), "id").join(golds.select("query_id", "label"), "query_id")
    out = R.rank_metrics(found.withColumn("hit", F.col("label") == F.col("seen")), golds.select("query_id", "gold"), 10)
    return out.select("query_id", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "mrr", "ndcg")])


@query(
    f"""with s as (select doc_id, {sql_sentences("text")} as s from documents where text is not null)
 select doc_id, i::int as sentence_no, s[i] as sentence, coalesce(s[i - 1], '') as before, coalesce(s[i + 1], '') as after from s, unnest(range(1, len(s) + 1)) as r(i)"""
)
def sentence_windows(spark, sf_dir):
    """Every sentence with its neighbours: taken from the document's own array, without a shuffle."""
    rows = texts(spark, sf_dir).where("text is not null").select("doc_id", X.sentences("text").alias("s"))
    flat = rows.select("doc_id", "s", F.posexplode("s").alias("pos", "sentence"))
    at = lambda i: F.coalesce(F.get("s", F.col("pos") + i), F.lit(""))
    return flat.select("doc_id", (F.col("pos") + 1).alias("sentence_no"), "sentence", at(-1).alias("before"), at(1).alias("after"))


@query(
    """with c as (select distinct chunk_id, doc_id, parent_chunk_id, text from chunks), p as (select distinct parent_chunk_id, text from parent_chunks)
 select c.chunk_id, coalesce(p.text, c.text) as context, p.text is not null as expanded from c left join p on c.parent_chunk_id = p.parent_chunk_id"""
)
def parent_expansion(spark, sf_dir):
    """Every chunk with its parent's text, or its own if the parent is unknown."""
    chunks = table(spark, sf_dir, "chunks").dropDuplicates(["chunk_id"]).select("chunk_id", "parent_chunk_id", "text")
    parents = table(spark, sf_dir, "parent_chunks").dropDuplicates(["parent_chunk_id"]).select("parent_chunk_id", F.col("text").alias("parent"))
    both = chunks.join(parents, "parent_chunk_id", "left")
    return both.select("chunk_id", F.coalesce("parent", "text").alias("context"), F.col("parent").isNotNull().alias("expanded"))


def sql_query_terms(x: str) -> str:
    pairs = f"flatten(list_transform(regexp_extract_all(lower({x}), '[{HAN}]{{3,}}'), lambda r: list_transform(range(1, length(r)), lambda i: substring(r, i, 2))))"
    return f"list_distinct(list_concat(regexp_extract_all(lower({x}), '[a-z0-9_]{{2,}}|[{HAN}]{{2,}}'), {pairs}))"


@query(
    f"""with {HYBRID}, s as (select doc_id as id, {sql_sentences("text")} as s from documents where doc_id in (select id from hybrid where rank <= 5)),
 w as (select doc_id as query_id, {sql_query_terms("text")} as wanted from documents where doc_id in (select query_id from q)),
 e as (select query_id, id, rank, i, s, len(list_intersect({sql_query_terms("s[i]")}, wanted)) as hits from hybrid join s using (id) join w using (query_id), unnest(range(1, len(s) + 1)) as r(i) where rank <= 5)
 select query_id, id, rank, hits::int as hits, concat_ws(' ', s[i], s[i + 1]) as excerpt from e qualify row_number() over (partition by query_id, id order by hits desc, i) = 1"""
)
def best_sentences(spark, sf_dir):
    """Of every result of the hybrid search the sentence with most query terms, and the one after it."""
    docs, queries, _, found = hybrid(spark, sf_dir, 5)
    wanted = queries.select("query_id", X.query_terms("text").alias("wanted"))
    seen = docs.join(found.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    rows = found.join(seen.select(F.col("doc_id").alias("id"), X.sentences("text").alias("s")), "id").join(wanted, "query_id")
    scored = F.transform("s", lambda s, i: F.struct(F.size(F.array_intersect(X.query_terms(s), F.col("wanted"))).alias("hits"), (-i).alias("place")))
    rows = rows.withColumn("best", F.array_max(scored))
    at = -F.col("best.place")
    return rows.select("query_id", "id", "rank", F.col("best.hits").alias("hits"), F.concat_ws(" ", F.get("s", at), F.get("s", at + 1)).alias("excerpt"))


@query(
    f"""with k as (select doc_id, lower({sql_collapse("text")}) as key, n_chars from documents where text is not null)
 select min(doc_id) as doc_id, count(*) as copies, max(n_chars) as n_chars from k group by key"""
)
def text_dedup(spark, sf_dir):
    """One row per text, regardless of case and white space; copies meet by the hash of the key."""
    docs = texts(spark, sf_dir).where("text is not null")
    key = F.sha2(F.lower(X.collapse("text")), 256)
    return docs.select(key.alias("key"), "doc_id", "n_chars").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.max("n_chars").alias("n_chars")).drop("key")


@query(
    """with v as (select vec_id, label, embedding::double[] as v from embeddings),
 c as (select label, i, avg(v[i]) as m from v, unnest(range(1, 65)) as r(i) group by label, i),
 m as (select label, list(m order by i) as m from c group by label)
 select vec_id, v.label, round(list_cosine_similarity(v, m), 9) as centrality from v join m on v.label = m.label"""
)
def label_centroids(spark, sf_dir):
    """Cosine of every vector with the mean of its label; means are summed per place before the shuffle."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", doubles("embedding").alias("vector"))
    width = rows.agg(F.coalesce(F.max(F.size("vector")), F.lit(0))).first()[0]
    means = rows.groupBy("label").agg(F.array(*[F.avg(F.get("vector", F.lit(i))) for i in range(width)]).alias("mean"))
    return rows.join(means, "label").select("vec_id", "label", F.round(cosine(F.col("vector"), F.col("mean")), 9).alias("centrality"))
