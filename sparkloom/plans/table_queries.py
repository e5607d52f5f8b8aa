"""Queries of aggregation, joins, windows, sets and memories."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.functions import text as X
from sparkloom.functions.text import HAN
from sparkloom.operators import memory as M
from sparkloom.operators import tables as O
from sparkloom.plans.registry import query
from sparkloom.plans.text_queries import sql_tokens, sql_topic_terms
from sparkloom.tables import table, texts

# ---- aggregation ----


@query("select coalesce(status, 'none') as status, count(distinct memory_id) as n, (select count(distinct memory_id) from memories) as total from memories group by 1")
def status_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "memories").dropDuplicates(["memory_id"]).groupBy(F.coalesce("status", F.lit("none")).alias("status")).agg(F.count("*").alias("n"))
    return rows.crossJoin(F.broadcast(rows.agg(F.sum("n").alias("total"))))


@query("select event_type, count(*) as n, count(distinct user_id) as users, min(ts) as first_ts, max(ts) as last_ts, arg_min(event_id, (ts, event_id)) as first_id from events group by event_type")
def first_last(spark, sf_dir):
    out = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.min_by("event_id", F.struct("ts", "event_id")).alias("first_id"))
    return out


@query(
    """with u as (select distinct on (event_id) * from usage_events order by event_id, received_at)
 select coalesce(lower(stage), 'unattributed') as stage, count(*) as calls, sum((coalesce(usage_reported, false))::int) as reported, sum(coalesce(prompt_tokens, 0)) as prompt_tokens, sum(coalesce(completion_tokens, 0)) as completion_tokens,
  round(avg(latency_ms), 6) as mean_ms, sum((success is not true)::int) as failures from u group by 1"""
)
def usage_by_stage(spark, sf_dir):
    calls = O.first_copies(table(spark, sf_dir, "usage_events"), "event_id", "received_at")
    return calls.groupBy(F.coalesce(F.lower("stage"), F.lit("unattributed")).alias("stage")).agg(
        F.count("*").alias("calls"), F.sum(F.coalesce("usage_reported", F.lit(False)).cast("int")).alias("reported"), F.sum(F.coalesce("prompt_tokens", F.lit(0))).alias("prompt_tokens"),
        F.sum(F.coalesce("completion_tokens", F.lit(0))).alias("completion_tokens"), F.round(F.avg("latency_ms"), 6).alias("mean_ms"), F.sum((~F.coalesce("success", F.lit(False))).cast("int")).alias("failures"),
    )


PERCENTILES = """with v as (select event_type, value, row_number() over (partition by event_type order by value) as r, count(*) over (partition by event_type) as n from events where value is not null)
 select event_type, round(quantile_cont(value, 0.5), 9) as linear_p50, round(quantile_cont(value, 0.95), 9) as linear_p95,
  max(case when r = greatest(1, ceil(0.95 * n)) then value end) as nearest_p95, max(case when r = floor((n - 1) * 0.95 + 0.5) + 1 then value end) as rounded_p95 from v group by event_type"""


@query(PERCENTILES)
def three_percentiles(spark, sf_dir):
    """Linear, nearest-rank and rounded-rank percentiles. Values are counted before the shuffle, so equal ones are shuffled once per task."""
    return O.percentiles(table(spark, sf_dir, "events").where("value is not null"), "event_type", "value")


@query(
    """select stage, model, grouping(stage)::int as all_stages, grouping(model)::int as all_models, count(*) as calls, sum(total_tokens) as tokens from (select distinct on (event_id) lower(stage) as stage, model, total_tokens from usage_events order by event_id, received_at) group by cube (stage, model)"""
)
def usage_cube(spark, sf_dir):
    """Subset by metric report with all subtotals."""
    calls = O.first_copies(table(spark, sf_dir, "usage_events"), "event_id", "received_at").withColumn("stage", F.lower("stage"))
    return calls.cube("stage", "model").agg(F.grouping("stage").cast("int").alias("all_stages"), F.grouping("model").cast("int").alias("all_models"), F.count("*").alias("calls"), F.sum("total_tokens").alias("tokens"))


@query(
    """with u as (select distinct on (event_id) lower(stage) as stage, ts, latency_ms, success from usage_events order by event_id, received_at),
 c as (select max(ts)::date - 7 as cut from u),
 a as (select stage, avg(latency_ms) as ms, avg((success)::int) as ok from u, c where ts < cut group by stage), b as (select stage, avg(latency_ms) as ms, avg((success)::int) as ok from u, c where ts >= cut group by stage)
 select coalesce(a.stage, b.stage) as stage, round(a.ms, 6) as before_ms, round(b.ms, 6) as after_ms, round(b.ms - a.ms, 6) as delta_ms, round(b.ok - a.ok, 9) as delta_ok from a full join b on a.stage is not distinct from b.stage"""
)
def baseline_delta(spark, sf_dir):
    """The last seven days against all days before: a full join of two aggregates, here one conditional aggregate."""
    calls = O.first_copies(table(spark, sf_dir, "usage_events"), "event_id", "received_at").withColumn("stage", F.lower("stage"))
    cut = calls.agg(F.date_sub(F.to_date(F.max("ts")), 7).cast("timestamp_ntz").alias("cut"))
    rows = calls.crossJoin(F.broadcast(cut)).withColumn("new", F.col("ts") >= F.col("cut"))
    ok = F.col("success").cast("int")
    each = rows.groupBy("stage").agg(F.avg(F.when(~F.col("new"), F.col("latency_ms"))).alias("a"), F.avg(F.when(F.col("new"), F.col("latency_ms"))).alias("b"), F.avg(F.when(~F.col("new"), ok)).alias("x"), F.avg(F.when(F.col("new"), ok)).alias("y"))
    return each.select("stage", F.round("a", 6).alias("before_ms"), F.round("b", 6).alias("after_ms"), F.round(F.col("b") - F.col("a"), 6).alias("delta_ms"), F.round(F.col("y") - F.col("x"), 9).alias("delta_ok"))


@query(
    """select e.kind, round(avg(abs(d)), 9) as mae, round(sqrt(avg(d * d)), 9) as rmse, avg((abs(d) <= 0.25)::int) as close, count(d) as n from (select memory_type as kind, confidence - 0.7 as d from (select distinct memory_id, memory_type, confidence from memories)) e group by e.kind"""
)
def judge_errors(spark, sf_dir):
    """Error of a score against a reference value, per kind."""
    rows = table(spark, sf_dir, "memories").dropDuplicates(["memory_id"]).select(F.col("memory_type").alias("kind"), (F.col("confidence") - 0.7).alias("d"))
    return rows.groupBy("kind").agg(F.round(F.avg(F.abs("d")), 9).alias("mae"), F.round(F.sqrt(F.avg(F.col("d") * F.col("d"))), 9).alias("rmse"), F.avg((F.abs("d") <= 0.25).cast("int")).alias("close"), F.count("d").alias("n"))


@query("select user_id, event_type, sum(json_extract_string(props, '$.k')::int) as k, count(*) filter (json_extract_string(props, '$.k')::int > 50) as high from events group by all")
def json_detail_counts(spark, sf_dir):
    """Sums over a field of JSON details."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.sum(k).alias("k"), F.sum((k > 50).cast("int")).alias("high"))


@query("select lower(trim(source)) as source, count(*) as docs, sum(n) as chunks, max(n) as most from (select d.doc_id, source, count(distinct chunk_id) as n from documents d left join chunks c on c.doc_id = d.doc_id group by d.doc_id, source) group by 1")
def chunks_per_source(spark, sf_dir):
    each = table(spark, sf_dir, "chunks").dropDuplicates(["chunk_id"]).groupBy("doc_id").agg(F.count("*").alias("n"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lower(F.trim("source")).alias("source")).join(each, "doc_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return docs.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n").alias("chunks"), F.max("n").alias("most"))


# ---- joins ----


@query("select distinct c.chunk_id, c.doc_id, d.title, d.active from chunks c join documents d on c.doc_id = d.doc_id")
def chunk_documents(spark, sf_dir):
    """Lookup of the document; orphans are dropped."""
    chunks = table(spark, sf_dir, "chunks").dropDuplicates(["chunk_id"]).select("chunk_id", "doc_id")
    return chunks.join(table(spark, sf_dir, "documents").select("doc_id", "title", "active"), "doc_id")


@query("select (select count(distinct chunk_id) from chunks where doc_id not in (select doc_id from documents)) as orphan_chunks, (select count(distinct chunk_id) from chunks where parent_chunk_id is not null and parent_chunk_id not in (select parent_chunk_id from parent_chunks where parent_chunk_id is not null)) as lost_parents, (select count(distinct region_id) from ocr_regions where doc_id not in (select doc_id from documents)) as orphan_regions")
def orphans(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    chunks = table(spark, sf_dir, "chunks").dropDuplicates(["chunk_id"])
    parents = table(spark, sf_dir, "parent_chunks").select("parent_chunk_id").distinct()
    a = chunks.join(docs, "doc_id", "left_anti").agg(F.count("*").alias("orphan_chunks"))
    b = chunks.where("parent_chunk_id is not null").join(parents, "parent_chunk_id", "left_anti").agg(F.count("*").alias("lost_parents"))
    c = table(spark, sf_dir, "ocr_regions").dropDuplicates(["region_id"]).join(docs, "doc_id", "left_anti").agg(F.count("*").alias("orphan_regions"))
    return a.crossJoin(b).crossJoin(c)


@query("select c.c_custkey, count(o.o_orderkey) as orders, sum((o.o_orderstatus = 'O')::int) as open_orders from customer c left join orders o on o.o_custkey = c.c_custkey group by c.c_custkey")
def active_left_join(spark, sf_dir):
    """Every parent with the number of its children and of the open ones; children are counted before the join."""
    each = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"), F.sum((F.col("o_orderstatus") == "O").cast("int")).alias("open_orders"))
    both = table(spark, sf_dir, "customer").select("c_custkey").join(each, F.col("c_custkey") == F.col("o_custkey"), "left")
    return both.select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"), "open_orders")


@query("select o_orderkey, o_custkey from orders o where not exists (select 1 from orders p where p.o_custkey = o.o_custkey and p.o_orderstatus <> 'F' and (p.o_orderdate < o.o_orderdate or (p.o_orderdate = o.o_orderdate and p.o_orderkey < o.o_orderkey))) and o.o_orderstatus <> 'F'")
def queue_heads(spark, sf_dir):
    """The first unfinished row of each queue: the correlated anti-join as a minimum per key, summed up before the shuffle."""
    open_rows = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'")
    head = F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey"))
    return open_rows.groupBy("o_custkey").agg(head.alias("o_orderkey"))


@query("select l_orderkey, max(l_linenumber) as attempts, sum(l_quantity) as quantity, coalesce(sum(case when l_returnflag = 'R' then l_quantity end), 0) as returned from lineitem group by l_orderkey")
def attempts_rollup(spark, sf_dir):
    """Three correlated sub-queries as one aggregate."""
    returned = F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_linenumber").alias("attempts"), F.sum("l_quantity").alias("quantity"), F.coalesce(returned, F.lit(0.0)).alias("returned"))


@query(
    """with m as (select distinct memory_id, source_message_ids, updated_at from memories), a as (select memory_id, unnest(source_message_ids) as message_id from m),
 s as (select distinct message_id, attachment_ids from session_messages where message_id in (select message_id from a)),
 t as (select distinct a.memory_id, u.asset_id from a join s on a.message_id = s.message_id, unnest(s.attachment_ids) as u(asset_id))
 select memory_id, count(distinct t.asset_id) as assets, count(distinct t.asset_id) filter (r.asset_id is not null) as scanned, round(least(1, 0.65 + 0.15 * count(distinct t.asset_id)), 6) as score from t left join (select distinct asset_id from ocr_regions) r on r.asset_id = t.asset_id group by memory_id"""
)
def memories_by_asset(spark, sf_dir):
    """Memories whose messages carry assets, scored by their number: an array overlap as an equi-join of the elements."""
    a = table(spark, sf_dir, "memories").dropDuplicates(["memory_id"]).select("memory_id", F.explode("source_message_ids").alias("message_id"))
    s = table(spark, sf_dir, "session_messages").select("message_id", F.explode("attachment_ids").alias("asset_id")).distinct()
    t = a.join(s, "message_id").select("memory_id", "asset_id").distinct()
    seen = table(spark, sf_dir, "ocr_regions").select("asset_id").distinct().withColumn("there", F.lit(1))
    out = t.join(seen, "asset_id", "left").groupBy("memory_id").agg(F.count("*").alias("assets"), F.count("there").alias("scanned"))
    return out.withColumn("score", F.round(F.least(F.lit(1.0), 0.65 + 0.15 * F.col("assets")), 6))


@query(
    """with recursive p as (select distinct message_id, json_extract_string(metadata, '$.reply_to') as parent from session_messages where metadata is not null and json_extract_string(metadata, '$.reply_to') is not null)
 select p.message_id, p.parent, q.parent as grandparent from p left join p q on p.parent = q.message_id"""
)
def reply_pairs(spark, sf_dir):
    """Explicit replies with the message that theirs answers."""
    p = table(spark, sf_dir, "session_messages").select("message_id", F.get_json_object("metadata", "$.reply_to").alias("parent")).where("parent is not null").distinct()
    q = p.select(F.col("message_id").alias("parent"), F.col("parent").alias("grandparent"))
    return p.join(q, "parent", "left").select("message_id", "parent", "grandparent")


# ---- windows ----

MESSAGES = "(select distinct on (message_id) * from session_messages where message_id is not null and session_id is not null and created_at is not null order by message_id, ingested_at, coalesce(role, ''), session_id)"


@query(f"select lower(trim(session_id)) as session, message_id, created_at from {MESSAGES} m qualify row_number() over (partition by lower(trim(session_id)) order by created_at desc, message_id desc) <= 8")
def recent_messages(spark, sf_dir):
    """The last eight messages per session; the limit is applied before the shuffle too."""
    rows = O.message_records(table(spark, sf_dir, "session_messages"))
    order = Window.partitionBy("session").orderBy(F.desc("created_at"), F.desc("message_id"))
    return rows.withColumn("n", F.row_number().over(order)).where("n <= 8").select("session", "message_id", "created_at")


@query(
    """with e as (select user_id, event_id, ts, event_type = 'error' as bad from events),
 g as (select *, row_number() over (partition by user_id order by ts, event_id) - row_number() over (partition by user_id, bad order by ts, event_id) as island from e)
 select user_id, min(ts) as first_ts, max(ts) as last_ts, count(*) as n, count(*) >= 3 as opens from g where bad group by user_id, island having count(*) >= 2"""
)
def failure_streaks(spark, sf_dir):
    """Runs of consecutive failures per user; three or more open the circuit."""
    return O.streaks(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error", 2).select("user_id", F.col("first.ts").alias("first_ts"), F.col("last.ts").alias("last_ts"), "n", (F.col("n") >= 3).alias("opens"))


@query(f"select lower(trim(session_id)) as session, floor(datediff('second', timestamp '2020-01-01', created_at) / 86400) as day, count(*) as messages, sum(length(content)) as chars, sum({sql_tokens('content')}) as tokens from {MESSAGES} m group by all")
def session_days(spark, sf_dir):
    rows = O.message_records(table(spark, sf_dir, "session_messages"))
    day = F.datediff(F.to_date("created_at"), F.lit("2020-01-01").cast("date"))
    return rows.groupBy("session", day.cast("double").alias("day")).agg(F.count("*").alias("messages"), F.sum(F.length("content")).alias("chars"), F.sum(X.token_estimate("content")).alias("tokens"))


@query("with p as (select p_partkey, p_brand, p_size, sum(p_size) over (partition by p_brand order by p_retailprice desc, p_partkey rows unbounded preceding) as used, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) as n from part) select p_brand, p_partkey, used from p where used <= 500 and n <= 60")
def prefix_budget(spark, sf_dir):
    """Rows of each group in order of value while their sizes fit a budget of 500 and 60 rows."""
    order = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    # no more than 60 rows of a group can stay, so the running sum sees 60 per group
    rows = table(spark, sf_dir, "part").withColumn("n", F.row_number().over(order)).where("n <= 60")
    return rows.withColumn("used", F.sum("p_size").over(order.rowsBetween(Window.unboundedPreceding, 0))).where("used <= 500").select("p_brand", "p_partkey", "used")


@query("select user_id, event_id, count(*) over (partition by user_id order by ts range between interval 3600 seconds preceding and current row) as last_hour, sum(value) over (partition by user_id order by ts range between interval 86400 seconds preceding and current row)::decimal(18, 2)::double as last_day from events")
def quota_windows(spark, sf_dir):
    """Events of the last hour and value of the last day before each event, per user: blocks of days, each with the day before."""
    return O.trailing_sums(table(spark, sf_dir, "events"))


@query("select parent_chunk_id, chunk_id, lag(chunk_id) over w as before, lead(chunk_id) over w as behind from (select distinct chunk_id, parent_chunk_id, position from chunks where parent_chunk_id is not null) window w as (partition by parent_chunk_id order by position, chunk_id)")
def neighbour_chunks(spark, sf_dir):
    from sparkloom.operators.ordered import with_neighbours

    rows = table(spark, sf_dir, "chunks").where("parent_chunk_id is not null").select("chunk_id", "parent_chunk_id", "position").distinct()
    out = with_neighbours(rows, ["parent_chunk_id"], ["position", "chunk_id"], ["chunk_id"])
    return out.select("parent_chunk_id", "chunk_id", F.col("prev_chunk_id").alias("before"), F.col("next_chunk_id").alias("behind"))


@query("select distinct on (lower(trim(source)), title) doc_id, lower(trim(source)) as source, title from documents where title is not null order by lower(trim(source)), title, updated_at desc nulls last, doc_id desc")
def latest_versions(spark, sf_dir):
    """The newest document per source and title: a versioned upsert as the maximum per key."""
    docs = table(spark, sf_dir, "documents").where("title is not null")
    newest = F.max_by("doc_id", F.struct(F.coalesce("updated_at", F.lit("0001-01-01").cast("timestamp_ntz")), "doc_id"))
    return docs.groupBy(F.lower(F.trim("source")).alias("source"), "title").agg(newest.alias("doc_id"))


# ---- sets ----


@query("with s as (select doc_id, lower(trim(source_type)) as stratum from documents) select stratum, doc_id from s qualify row_number() over (partition by stratum order by sha256(doc_id::varchar), doc_id) <= 3")
def stratified_sample(spark, sf_dir):
    """Three documents per source type, chosen by hash: a seeded sample that is equal on every run."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.lower(F.trim("source_type")).alias("stratum"))
    order = Window.partitionBy("stratum").orderBy(F.sha2(F.col("doc_id").cast("string"), 256), "doc_id")
    return rows.withColumn("n", F.row_number().over(order)).where("n <= 3").select("stratum", "doc_id")


@query("with m as (select distinct * exclude (tags, source_message_ids) from memories where content is not null and coalesce(status, '') <> 'deleted') select content, memory_type, coalesce(source_session_id, '') as session, count(*) as copies, min(memory_id) as memory_id from m group by all")
def duplicate_memories(spark, sf_dir):
    rows = table(spark, sf_dir, "memories").where("content is not null and coalesce(status, '') <> 'deleted'").dropDuplicates(["memory_id"])
    return rows.groupBy("content", "memory_type", F.coalesce("source_session_id", F.lit("")).alias("session")).agg(F.count("*").alias("copies"), F.min("memory_id").alias("memory_id"))


@query("select source, doc_id from (select lower(trim(source)) as source, doc_id, md5(coalesce(text, '')) as h from documents) qualify row_number() over (partition by source, h order by doc_id) = 1")
def dedup_within_source(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.lower(F.trim("source")).alias("source"), "doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("h"))
    return rows.groupBy("source", "h").agg(F.min("doc_id").alias("doc_id")).select("source", "doc_id")


@query("with h as (select distinct md5(text) as h from documents where text is not null and active = 1), c as (select distinct chunk_id, md5(text) as h from chunks where text is not null) select count(*) as chunks, count(distinct c.h) as texts, sum((h.h is not null)::int) as known from c left join h on c.h = h.h")
def embedding_cache(spark, sf_dir):
    """Texts to embed: distinct, and not in the cache yet. The cache is joined by hash."""
    cache = table(spark, sf_dir, "documents").where("text is not null and active = 1").select(F.md5("text").alias("h")).distinct().withColumn("there", F.lit(1))
    chunks = table(spark, sf_dir, "chunks").where("text is not null").dropDuplicates(["chunk_id"]).select(F.md5("text").alias("h"))
    return chunks.join(cache, "h", "left").agg(F.count("*").alias("chunks"), F.countDistinct("h").alias("texts"), F.sum(F.when(F.col("there") == 1, 1).otherwise(0)).alias("known"))


# ---- memories ----

NOW = "(select max(updated_at) from memories)"


@query(
    f"""with m as (select distinct * exclude (tags, source_message_ids), list_transform(tags, lambda t: lower(trim(t))) as t from memories)
 select memory_id, coalesce(list_has_any(t, ['completed', 'cancelled', 'obsolete', 'expired']), false) or coalesce(expires_at <= {NOW}, false) as inactive,
 round(exp(-ln(2) * greatest(0, epoch_us({NOW}) - epoch_us(updated_at)) / 86400000000.0 / case memory_type when 'task' then 14 when 'artifact' then 30 when 'fact' then 120 when 'decision' then 180 when 'preference' then 365 else 90 end), 9) as recency,
 case when status in ('deleted', 'superseded', 'archived', 'pending') then status when memory_type = 'preference' and confidence < 0.82 then 'pending' when confidence < 0.6 then 'pending' else 'active' end as plain_status from m"""
)
def memory_state(spark, sf_dir):
    """Expiry, recency by half-life and normalised status of every memory, at the time of the last update in the table."""
    return M.state(table(spark, sf_dir, "memories").dropDuplicates(["memory_id"])).select("memory_id", "inactive", F.round("recency", 9).alias("recency"), "plain_status")


@query(
    """with m as (select distinct memory_id, scope, memory_type, created_at, list_transform(tags, lambda t: lower(t)) as t from memories),
 d as (select *, case when memory_type in ('preference', 'decision') or list_has_any(t, ['completed', 'permanent']) then null when memory_type = 'task' then case when scope = 'session' then 30 else 90 end
  when memory_type = 'artifact' then 90 when memory_type = 'fact' then case when scope = 'session' then 120 else 365 end end as days from m)
 select memory_id, days, created_at + to_days(days) as due from d"""
)
def memory_ttl(spark, sf_dir):
    rows = table(spark, sf_dir, "memories").dropDuplicates(["memory_id"]).withColumn("days", M.ttl_days())
    return rows.select("memory_id", "days", F.expr("created_at + make_dt_interval(days)").alias("due"))


@query(
    """with m as (select distinct memory_id, memory_type, updated_at, tags from memories where status = 'active' and memory_type in ('decision', 'preference')),
 t as (select memory_id, memory_type, updated_at, unnest(list_filter(tags, lambda t: t like 'topic:%')) as topic from m),
 r as (select *, first_value(memory_id) over (partition by memory_type, topic order by updated_at desc, memory_id desc) as newest from t)
 select distinct memory_id, newest as superseded_by, topic from r where memory_id <> newest"""
)
def superseded(spark, sf_dir):
    """Older decisions and preferences of a topic give way to the newest: the maximum per topic joined back."""
    return M.superseded(table(spark, sf_dir, "memories"))


MEMORY_SCORES = f"""
m as (select distinct on (memory_id) * from memories where content is not null order by memory_id), now as (select max(updated_at) as now from m),
 act as (select memory_id, memory_type, coalesce(confidence, 0) as confidence, {sql_topic_terms("content")} as terms,
   exp(-ln(2) * greatest(0, epoch_us(now) - epoch_us(updated_at)) / 86400000000.0 / case memory_type when 'task' then 14 when 'artifact' then 30 when 'fact' then 120 when 'decision' then 180 when 'preference' then 365 else 90 end) as recency
  from m, now where not coalesce(list_has_any(list_transform(tags, lambda t: lower(trim(t))), ['completed', 'cancelled', 'obsolete', 'expired']), false) and not coalesce(expires_at <= now, false)
   and coalesce(status not in ('deleted', 'superseded', 'archived', 'pending'), true) and not coalesce(memory_type = 'preference' and confidence < 0.82, false) and not coalesce(confidence < 0.6, false)),
 q as (select doc_id as query_id, {sql_topic_terms("title")} as terms from documents where doc_id % 100 = 0 and title is not null),
 w as (select query_id, len(terms) as n, unnest(terms) as term from q), held as (select memory_id, unnest(terms) as term from act),
 s as (select query_id, memory_id, count(*) / any_value(n) as share from w join held using (term) group by query_id, memory_id),
 r as (select query_id, memory_id as id, 0.75 * share + (0.15 * recency + 0.1 * confidence + case when memory_type in ('preference', 'decision') then 0.05 else 0 end) * least(1, 4 * share) as score from s join act using (memory_id))"""


@query(f"with {MEMORY_SCORES} select query_id, id, round(score, 9) as score from r where score > 0.08 qualify row_number() over (partition by query_id order by score desc, id) <= 5")
def memory_search(spark, sf_dir):
    """Memories for every document whose id is divisible by 100: keywords, recency and confidence, five each."""
    docs = table(spark, sf_dir, "documents").where("doc_id % 100 = 0 and title is not null").select(F.col("doc_id").alias("query_id"), "title")
    return M.search(docs, "title", table(spark, sf_dir, "memories"), 5).select("query_id", "id", F.round("score", 9).alias("score"))


@query(
    f"""with q as (select doc_id, list_distinct(regexp_extract_all(lower(title), '[a-z0-9_.+-]+|[{HAN}]{{2,}}')) as terms, lower(coalesce(text, '')) as text from documents where title is not null)
 select doc_id, case when len(terms) > 0 then round(len(list_filter(terms, lambda t: contains(text, t))) / len(terms), 9) else 0 end as relevance from q"""
)
def title_relevance(spark, sf_dir):
    """Share of the title's terms that the text holds."""
    terms = F.array_distinct(X.matches(F.lower("title"), f"[a-z0-9_.+-]+|[{HAN}]{{2,}}"))
    return texts(spark, sf_dir).where("title is not null").select("doc_id", F.round(X.lexical_fraction(terms, F.coalesce("text", F.lit(""))), 9).alias("relevance"))


@query(
    """with t as (select doc_id, unnest(regexp_extract_all(lower(title), '[a-z0-9_]+|[一-鿿]')) as w from documents where title is not null), x as (select d.doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+|[一-鿿]')) as w from documents d where title is not null and text is not null),
 a as (select doc_id, w, count(*) as n from t group by all), b as (select doc_id, w, count(*) as n from x group by all), na as (select doc_id, sum(n) as n from a group by 1), nb as (select doc_id, sum(n) as n from b group by 1),
 c as (select a.doc_id, sum(least(a.n, b.n)) as same from a join b using (doc_id, w) group by 1)
 select doc_id, round(2.0 * same / (na.n + nb.n), 9) as f1 from c join na using (doc_id) join nb using (doc_id)"""
)
def token_f1(spark, sf_dir):
    """Multiset overlap of the tokens of title and text, where there is any: within the row, without a shuffle."""
    rows = texts(spark, sf_dir).where("title is not null and text is not null")
    return O.token_f1(rows, "title", "text").where("f1 > 0").select("doc_id", F.round("f1", 9).alias("f1"))
