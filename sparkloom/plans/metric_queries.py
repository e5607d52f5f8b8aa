"""Queries of reports and checks: comparisons, summaries with their own denominators, progress, readiness, ranking metrics per source."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.functions import text as X
from sparkloom.functions.vectors import doubles
from sparkloom.operators import retrieval as R
from sparkloom.operators import tables as O
from sparkloom.operators.ordered import with_neighbours
from sparkloom.plans.ranking_queries import PAIRS, VECTORS
from sparkloom.plans.registry import query
from sparkloom.plans.retrieval_queries import NONE, sql_marginal
from sparkloom.tables import stored, table, texts

CALLS = "calls as (select distinct on (event_id) * from usage_events order by event_id, received_at)"


def _calls(spark, sf_dir):
    return O.first_copies(table(spark, sf_dir, "usage_events"), "event_id", "received_at")


@query(
    f"""with {CALLS}, n as (select model, count(*) as n, count(*) filter (coalesce(error, '') = '') as answered, round(avg(case when success then 1.0 else 0.0 end), 9) as accuracy, sum(prompt_tokens) as prompt_tokens, count(*) filter (usage_reported) as reported from calls where model is not null group by model),
 v as (select model, latency_ms, row_number() over (partition by model order by latency_ms) as place, count(*) over (partition by model) as m from calls where model is not null and coalesce(error, '') = '' and latency_ms is not null),
 p as (select model, round(avg(latency_ms), 6) as mean_latency, round(quantile_cont(latency_ms, 0.5), 9) as median_latency, max(case when place = ceil(0.95 * m) then latency_ms end) as p95_latency from v group by model)
 select * from n left join p using (model)"""
)
def model_comparison(spark, sf_dir):
    """Models against each other: shares over all calls, latencies over those without an error."""
    calls = _calls(spark, sf_dir).where("model is not null")
    fine = F.coalesce("error", F.lit("")) == ""
    shares = calls.groupBy("model").agg(
        F.count("*").alias("n"), F.sum(fine.cast("int")).alias("answered"), F.round(F.avg(F.when(F.col("success"), 1.0).otherwise(0.0)), 9).alias("accuracy"),
        F.sum("prompt_tokens").alias("prompt_tokens"), F.count(F.when(F.col("usage_reported"), 1)).alias("reported"),
    )
    timed = calls.where(fine & F.col("latency_ms").isNotNull())
    places = O.percentiles(timed, "model", "latency_ms").select("model", F.col("linear_p50").alias("median_latency"), F.col("nearest_p95").alias("p95_latency"))
    means = timed.groupBy("model").agg(F.round(F.avg("latency_ms"), 6).alias("mean_latency"))
    return shares.join(means, "model", "left").join(places, "model", "left")


@query(
    f"""with {CALLS} select lower(stage) as stage, count(latency_ms) as timed, count(*) filter (usage_reported) as reported, sum(prompt_tokens) filter (usage_reported) as prompt_tokens, sum(completion_tokens) filter (usage_reported) as completion_tokens,
 round(sum(completion_tokens) filter (usage_reported) / nullif(sum(prompt_tokens) filter (usage_reported), 0), 9) as completion_rate, count(*) filter (error <> '') as failed, max(total_tokens) filter (error <> '') as largest_failed
 from calls where stage is not null group by lower(stage)"""
)
def call_contracts(spark, sf_dir):
    """Per stage: every measure over those calls only that report it; a rate without a denominator is null."""
    calls = _calls(spark, sf_dir).where("stage is not null")
    told, failed = F.col("usage_reported"), F.col("error") != ""
    prompt, completion = F.sum(F.when(told, F.col("prompt_tokens"))), F.sum(F.when(told, F.col("completion_tokens")))
    return calls.groupBy(F.lower("stage").alias("stage")).agg(
        F.count("latency_ms").alias("timed"), F.count(F.when(told, 1)).alias("reported"), prompt.alias("prompt_tokens"), completion.alias("completion_tokens"),
        F.round(F.when(prompt != 0, completion / prompt), 9).alias("completion_rate"), F.count(F.when(failed, 1)).alias("failed"), F.max(F.when(failed, F.col("total_tokens"))).alias("largest_failed"),
    )


@query(
    f"""with {CALLS}, l as (select *, lag(total_tokens) over (partition by session_id order by ts, event_id) as before from calls where session_id is not null and usage_reported and total_tokens is not null)
 select event_id, session_id, greatest(0, total_tokens - before) as added from l where before is not null"""
)
def usage_deltas(spark, sf_dir):
    """What a session's reported usage grew by from call to call; falls count as 0."""
    calls = _calls(spark, sf_dir).where("event_id is not null and session_id is not null and usage_reported and total_tokens is not null").select("event_id", "session_id", "ts", "total_tokens")
    rows = with_neighbours(calls, ["session_id"], ["ts", "event_id"], ["total_tokens"]).where("prev_total_tokens is not null")
    return rows.select("event_id", "session_id", F.greatest(F.lit(0), F.col("total_tokens") - F.col("prev_total_tokens")).alias("added"))


@query("select d.doc_id, count(distinct c.chunk_id) as chunks, count(distinct c.page_number) as pages from documents d left join chunks c using (doc_id) group by d.doc_id")
def document_chunk_counts(spark, sf_dir):
    """Chunks and pages of every document, also of those without any; counted before they meet the documents."""
    chunks = table(spark, sf_dir, "chunks").groupBy("doc_id").agg(F.countDistinct("chunk_id").alias("c"), F.countDistinct("page_number").alias("p"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return table(spark, sf_dir, "documents").select("doc_id").join(chunks, "doc_id", "left").select("doc_id", zero("c").alias("chunks"), zero("p").alias("pages"))


@query(
    """with l as (select user_id, max(ts) as started from events where event_type = 'signup' group by user_id)
 select user_id, started, count(*) as steps, count(distinct props) as distinct_steps, count(distinct props) filter (event_type = 'click') as clicked from events join l using (user_id) where ts > started and event_type <> 'signup' group by user_id, started"""
)
def progress_since_start(spark, sf_dir):
    """Steps, and distinct ones, since each user's last start: the latest start is a maximum joined back, so no user's events are sorted."""
    events = table(spark, sf_dir, "events")
    last = events.where("event_type = 'signup'").groupBy("user_id").agg(F.max("ts").alias("started"))
    after = events.where("event_type <> 'signup'").join(last, "user_id").where("ts > started")
    steps = after.groupBy("user_id", "started", "props").agg(F.count("*").alias("n"), F.max((F.col("event_type") == "click").cast("int")).alias("clicked"))
    known = F.col("props").isNotNull()
    return steps.groupBy("user_id", "started").agg(F.sum("n").alias("steps"), F.sum(known.cast("int")).alias("distinct_steps"), F.sum(F.when(known, F.col("clicked")).otherwise(0)).alias("clicked"))


@query(
    r"""with d as (select distinct memory_id, unnest(source_message_ids) as message_id from memories), c as (select distinct message_id from session_messages where regexp_matches(content, '[\p{L}\p{N}]'))
 select memory_id, count(*) as needed, count(c.message_id) as there, count(*) = count(c.message_id) as ready from d left join c using (message_id) where memory_id is not null group by memory_id"""
)
def ready_memories(spark, sf_dir):
    """Which memories have all the messages that they depend on: dependencies met in an equi-join, compared as counts."""
    needs = table(spark, sf_dir, "memories").where("memory_id is not null").select("memory_id", F.explode("source_message_ids").alias("message_id")).distinct()
    there = table(spark, sf_dir, "session_messages").where(F.col("content").rlike(r"[\p{L}\p{N}]")).select("message_id", F.lit(1).alias("there")).distinct()
    return needs.join(there, "message_id", "left").groupBy("memory_id").agg(F.count("*").alias("needed"), F.count("there").alias("there")).withColumn("ready", F.col("needed") == F.col("there"))


@query(
    """with a as (select doc_id, asset_id, max(confidence) as confidence, arg_max(region_id, (confidence, region_id)) as region_id from (select distinct region_id, doc_id, asset_id, confidence from ocr_regions) where confidence is not null group by all)
 select doc_id, asset_id, region_id, confidence, row_number() over (partition by doc_id order by confidence desc, asset_id) as place from a qualify place <= 4"""
)
def asset_evidence(spark, sf_dir):
    """The surest region of each asset, and of these the best four per document."""
    rows = table(spark, sf_dir, "ocr_regions").where("confidence is not null").groupBy("doc_id", "asset_id").agg(F.max(F.struct("confidence", "region_id")).alias("best"))
    order = Window.partitionBy("doc_id").orderBy(F.desc("best.confidence"), "asset_id")
    return rows.withColumn("place", F.row_number().over(order)).where("place <= 4").select("doc_id", "asset_id", "best.region_id", "best.confidence", "place")


@query("select distinct region_id, asset_id from ocr_regions r where not exists (select 1 from documents d where d.doc_id = r.doc_id and d.active = 0)")
def regions_of_active(spark, sf_dir):
    """What is left of the regions when the inactive documents' are deleted: an anti-join."""
    gone = table(spark, sf_dir, "documents").where("active = 0").select("doc_id")
    return table(spark, sf_dir, "ocr_regions").join(gone, "doc_id", "left_anti").select("region_id", "asset_id").distinct()


#: The patterns of sensitive content, with the bounds of words written out so that every engine sees the same.
SENSITIVE = r"(?i:password|passwd|api[_ -]?key|access[_ -]?token|bearer)\s*[:=]|(^|[^\p{L}\p{N}_])(sk-[A-Za-z0-9_-]{12,}|[0-9]{17}[0-9Xx]|([0-9][ -]?){15,18}[0-9])([^\p{L}\p{N}_]|$)|(验证码|动态码|短信码|(?i:otp))[^0-9]{0,6}[0-9]{4,8}"


@query(f"select 'memories' as source_table, memory_id as record_id from (select distinct memory_id, content as t from memories) where regexp_matches(t, '{SENSITIVE}') union all select 'session_messages', message_id from (select distinct message_id, content as t from session_messages) where regexp_matches(t, '{SENSITIVE}') union all select 'ocr_regions', region_id from (select distinct region_id, text as t from ocr_regions) where regexp_matches(t, '{SENSITIVE}')")
def sensitive_records(spark, sf_dir):
    """Memories, messages and scanned regions that hold credentials, numbers of cards or identities, or one-time codes."""
    a = table(spark, sf_dir, "memories").select(F.lit("memories").alias("source_table"), F.col("memory_id").alias("record_id"), F.col("content").alias("t"))
    b = texts(spark, sf_dir, "ocr_regions").select(F.lit("ocr_regions").alias("source_table"), F.col("region_id").alias("record_id"), F.col("text").alias("t"))
    c = texts(spark, sf_dir, "session_messages").select(F.lit("session_messages").alias("source_table"), F.col("message_id").alias("record_id"), F.col("content").alias("t"))
    return a.unionByName(b).unionByName(c).where(F.col("t").rlike(SENSITIVE)).select("source_table", "record_id").distinct()


@query("select message_id, list_sort(list_transform(json_keys(m), lambda k: k || '=' || json_extract_string(m, k))) as metadata from (select distinct message_id, json_merge_patch(coalesce(metadata, '{}')::json, json_object('role', role, 'client', coalesce(json_extract_string(metadata, 'client'), 'unknown'))) as m from session_messages where message_id is not null and role is not null)")
def merged_metadata(spark, sf_dir):
    """Messages' metadata with an update merged in: of equal keys the update's value stays."""
    rows = table(spark, sf_dir, "session_messages").where("message_id is not null and role is not null").select("message_id", "role", "metadata").distinct()
    base = F.coalesce(F.from_json("metadata", "map<string,string>"), F.create_map().cast("map<string,string>"))
    update = F.create_map(F.lit("role"), F.col("role"), F.lit("client"), F.coalesce(F.get_json_object("metadata", "$.client"), F.lit("unknown")))
    entries = F.map_entries(X.merged(base, update))
    return rows.select("message_id", F.array_sort(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"]))).alias("metadata"))


@query("select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || case when epoch_us(ts) % 1000000 <> 0 then '.' || lpad((epoch_us(ts) % 1000000)::varchar, 6, '0') else '' end || '+00:00' as at from events")
def iso_times(spark, sf_dir):
    """Times as text with their zone; those without one count as UTC."""
    return table(spark, sf_dir, "events").select("event_id", X.iso_time("ts").alias("at"))


@query(
    f"""with {VECTORS}, h as (select *, label in (own, (own + 1) % 10) and row_number() over (partition by query_id, label order by rank) = 1 as hit from t where rank <= 10)
 select query_id, round(sum(hit::int) / count(*), 9) as precision, round(sum(hit::int) / 2, 9) as recall, round(coalesce(1 / min(case when hit then rank end), 0), 9) as mrr,
  round(sum(hit::int / log2(rank + 1)) / list_sum(list_transform(range(1, least(2, count(*)) + 1), lambda i: 1 / log2(i + 1))), 9) as ndcg from h group by query_id"""
)
def source_metrics(spark, sf_dir):
    """Ranking metrics in which a gold source (here a label) counts at its first hit only, however many of its rows are found."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", doubles("embedding").alias("vector"))
    asked = rows.where("id % 100 = 0").withColumnRenamed("id", "query_id")
    gold = asked.select("query_id", F.col("label").alias("own"))
    found = R.dense(rows, asked, 10).join(rows.select("id", "label"), "id").join(gold, "query_id")
    wanted = (F.col("label") == F.col("own")) | (F.col("label") == (F.col("own") + 1) % 10)
    first = F.row_number().over(Window.partitionBy("query_id", "label").orderBy("rank")) == 1
    out = R.rank_metrics(found.withColumn("hit", wanted & first), gold.select("query_id", F.lit(2).alias("gold")), 10)
    return out.where("precision is not null").select("query_id", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "mrr", "ndcg")])


@query(
    f"""with {VECTORS}, {PAIRS}, {sql_marginal(NONE, 5, 0.72)}, g as (select label, count(*) as gold from v group by label),
 r as (select 'vector' as ranker, query_id, id, rank from t where rank <= 5 union all select 'diverse', query_id, id, place from m5),
 q as (select ranker, query_id, sum((v.label = own.label)::int) as hits, any_value(gold) as gold, coalesce(1 / min(case when v.label = own.label then rank end), 0) as mrr from r join v using (id) join v own on own.id = query_id join g on g.label = own.label group by ranker, query_id)
 select ranker, count(*) as queries, round(avg((hits > 0)::int), 9) as hit_rate, round(avg(hits / gold), 9) as recall, round(avg(mrr), 9) as mrr from q group by ranker"""
)
def ranker_ablation(spark, sf_dir):
    """Rankers side by side on the same queries: hit rate, mean recall and mean reciprocal rank of five results."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", doubles("embedding").alias("vector"))
    asked = rows.where("id % 100 = 0").withColumnRenamed("id", "query_id")
    found = stored(R.dense(rows, asked, 20))
    golds = asked.select("query_id", F.col("label").alias("own")).join(rows.groupBy(F.col("label").alias("own")).agg(F.count("*").alias("gold")), "own")
    out = None
    for name, ranked in (("vector", found), ("diverse", R.diversify(found, rows, 5))):
        hits = ranked.where("rank <= 5").join(rows.select("id", "label"), "id").join(golds.select("query_id", "own"), "query_id").withColumn("hit", F.col("label") == F.col("own"))
        own = R.rank_metrics(hits, golds.select("query_id", "gold"), 5).withColumn("ranker", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return out.groupBy("ranker").agg(F.count("*").alias("queries"), F.round(F.avg((F.col("recall") > 0).cast("int")), 9).alias("hit_rate"), F.round(F.avg("recall"), 9).alias("recall"), F.round(F.avg("mrr"), 9).alias("mrr"))
