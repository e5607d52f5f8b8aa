"""Queries of selection, query analysis, contexts and run comparison."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.functions import text as X
from sparkloom.functions.text import HAN
from sparkloom.functions.vectors import doubles
from sparkloom.operators import context as C
from sparkloom.operators import memory as M
from sparkloom.operators import retrieval as R
from sparkloom.operators import tables as O
from sparkloom.plans.registry import query
from sparkloom.plans.retrieval_queries import HYBRID, hybrid, sql_query_terms
from sparkloom.plans.text_queries import sql_sentences, sql_tokens
from sparkloom.tables import stored, table, texts

V = "v as (select vec_id as id, label, embedding::double[] as v from embeddings)"


@query("select doc_id, source_type, title from documents where active = 1 and lower(coalesce(title, '')) like '%report%' and regexp_replace(lower(trim(source_type)), '^\\.', '') in ('pdf', 'docx', 'md') and lang = 'en'")
def metadata_filter(spark, sf_dir):
    """Predicates on metadata, which reach the scan."""
    docs = texts(spark, sf_dir).where("active = 1 and lang = 'en'")
    return docs.where(F.lower(F.coalesce("title", F.lit(""))).contains("report") & F.regexp_replace(F.lower(F.trim("source_type")), r"^\.", "").isin("pdf", "docx", "md")).select("doc_id", "source_type", "title")


REFERENCES = "(?i)^(references|bibliography|参考文献|引用文献|works cited|literatur|références|referencias)\\s*:?\\s*$"


@query(
    """with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as n, len(string_split(text, chr(10))) as lines from documents where text is not null)
 select doc_id, min(n) as first_line, any_value(lines) as lines from l where regexp_matches(trim(ltrim(trim(line), '#')), '(?i)^(references|bibliography|参考文献|引用文献|works cited|literatur|références|referencias|summary|appendix)\\s*:?\\s*$') and n > lines / 2 group by doc_id"""
)
def reference_start(spark, sf_dir):
    """The first line behind the middle of a document that opens its closing section; within the row."""
    lines = F.split("text", "\n")
    heading = r"(?i)^(references|bibliography|参考文献|引用文献|works cited|literatur|références|referencias|summary|appendix)\s*:?\s*$"
    hits = F.filter(F.transform("l", lambda x, i: F.struct((i + 1).alias("n"), F.trim(F.ltrim(F.trim(x), F.lit("#"))).rlike(heading).alias("ok"))), lambda h: h["ok"] & (h["n"] > F.size("l") / 2))
    rows = texts(spark, sf_dir).where("text is not null").select("doc_id", lines.alias("l"))
    return rows.select("doc_id", F.get(hits, F.lit(0))["n"].alias("first_line"), F.size("l").alias("lines")).where("first_line is not null")


@query(
    """with t as (select doc_id, lower(regexp_replace(title, '[^A-Za-z0-9一-鿿]+', ' ', 'g')) as name from documents where title is not null), n as (select distinct trim(name) as name from t where length(trim(name)) >= 6),
 m as (select distinct chunk_id, lower(regexp_replace(text, '[^A-Za-z0-9一-鿿]+', ' ', 'g')) as body from chunks where text is not null and chunk_id is not null)
 select chunk_id, name from m join n on contains(' ' || body || ' ', ' ' || name || ' ')"""
)
def title_mentions(spark, sf_dir):
    """Chunks that name a document's title: a title is looked for only where its rarest pair of neighbouring words stands, so a text is never laid out in runs of every length."""
    plain = lambda c: F.trim(F.lower(F.regexp_replace(c, f"[^A-Za-z0-9{HAN}]+", " ")))
    pairs = lambda w: F.zip_with(w, F.slice(w, F.lit(2), F.size(w)), lambda a, b: F.concat_ws(" ", a, b))
    keys = lambda name: X.let(F.split(name, " "), lambda w: F.when(F.size(w) > 1, F.filter(pairs(w), lambda p: F.contains(p, F.lit(" ")))).otherwise(w))
    names = texts(spark, sf_dir).where("title is not null").select(plain("title").alias("name")).where(F.length("name") >= 6).distinct()
    each = names.select("name", F.explode(F.array_distinct(keys(F.col("name")))).alias("key"))
    common = each.groupBy("key").agg(F.count("*").alias("titles"))
    keyed = each.join(common, "key").groupBy("name").agg(F.min_by("key", F.struct("titles", "key")).alias("key"))
    chunks = stored(texts(spark, sf_dir, "chunks").where("text is not null and chunk_id is not null").select("chunk_id", plain("text").alias("body")).distinct())
    single = names.where(~F.contains("name", F.lit(" "))).select(F.col("name").alias("key"))
    split = chunks.select("chunk_id", F.split("body", " ").alias("w"))
    words = split.select("chunk_id", F.explode(F.array_distinct("w")).alias("key")).join(single, "key", "left_semi")
    twos = split.select("chunk_id", F.explode(F.array_distinct(F.filter(pairs(F.col("w")), lambda p: F.contains(p, F.lit(" "))))).alias("key"))
    met = words.unionByName(twos).join(keyed, "key").select("chunk_id", "name").distinct().join(chunks, "chunk_id")
    blank = F.lit(" ")
    return met.where(F.contains(F.concat(blank, "body", blank), F.concat(blank, "name", blank))).select("chunk_id", "name").distinct()


@query("select memory_id, scope, updated_at from (select distinct memory_id, scope, status, updated_at from memories) where status = 'active' and scope in ('workspace', 'user') order by updated_at desc, memory_id limit 100")
def visible_memories(spark, sf_dir):
    """The newest hundred memories that every session sees: a list's page length."""
    rows = table(spark, sf_dir, "memories").where("status = 'active' and scope in ('workspace', 'user')").select("memory_id", "scope", "updated_at").distinct()
    return rows.orderBy(F.desc("updated_at"), "memory_id").limit(100)


@query("select event_id, event_type, user_id from events where event_id > (select max(event_id) - 500 from events) and event_type in ('error', 'purchase')")
def cursor_scan(spark, sf_dir):
    """Events behind a cursor: the filter reaches the scan."""
    events = table(spark, sf_dir, "events")
    cursor = events.agg(F.max("event_id")).first()[0] or 0
    return events.where((F.col("event_id") > cursor - 500) & F.col("event_type").isin("error", "purchase")).select("event_id", "event_type", "user_id")


@query(
    rf"""select doc_id, list_distinct(regexp_extract_all(text, '[A-Z][A-Za-z0-9]*(?:[_-][A-Za-z0-9]+)+|[A-Z]{{2,}}[0-9]*|v[0-9]+(?:\.[0-9]+)+')).list_sort()  as entities from documents where text is not null"""
)
def technical_entities(spark, sf_dir):
    """Technical names of every document."""
    pattern = r"[A-Z][A-Za-z0-9]*(?:[_-][A-Za-z0-9]+)+|[A-Z]{2,}[0-9]*|v[0-9]+(?:\.[0-9]+)+"
    return texts(spark, sf_dir).where("text is not null").select("doc_id", F.array_sort(F.array_distinct(X.matches("text", pattern))).alias("entities"))


#: Words that name an aspect of a question, and the words added for it in the other language.
ASPECTS = (
    ("工作流程|处理流程|流程", "workflow architecture process pipeline"),
    ("架构|结构", "architecture structure modules"),
    ("原理|机制", "principle mechanism method"),
    ("训练|训练过程", "training objective procedure"),
    ("推理|推理过程", "inference procedure"),
    ("区别|差异|对比|比较", "comparison differences similarities architecture components training objectives inference efficiency"),
)


@query(
    "select message_id, trim(concat_ws(' ', regexp_replace(trim(content), '^(请帮我|请|帮我|麻烦|please|could you|can you)\\s*', '', 'i'), "
    + ", ".join(f"case when regexp_matches(content, '(?i){a}') then '{b}' end" for a, b in ASPECTS)
    + ")) as query from session_messages where content is not null and regexp_matches(content, '[?？]\\s*$')"
)
def rewritten_questions(spark, sf_dir):
    """Questions without their polite beginning, with the words of their aspects in both languages."""
    rows = table(spark, sf_dir, "session_messages").where(F.col("content").rlike(r"[?？]\s*$"))
    plain = F.regexp_replace(F.trim("content"), r"(?i)^(请帮我|请|帮我|麻烦|please|could you|can you)\s*", "")
    added = [F.when(F.col("content").rlike(f"(?i){a}"), b) for a, b in ASPECTS]
    return rows.select("message_id", F.trim(F.concat_ws(" ", plain, *added)).alias("query"))


@query(
    f"""with {V}, q as (select id as query_id, v from v where id % 100 = 0), s as (select query_id, id, label, list_cosine_similarity(v.v, q.v) as score from v, q),
 r as (select *, row_number() over (partition by query_id, label order by score desc, id) as n, max(score) over (partition by query_id, label) as top from s where score > 0)
 select query_id, label, id, round(score, 9) as score from r where n <= 2 qualify dense_rank() over (partition by query_id order by top desc, label) <= 4"""
)
def per_group_quota(spark, sf_dir):
    """The best two vectors of each of the four best labels: a limit per group, then over groups."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", doubles("embedding").alias("vector"))
    wanted = rows.where("id % 100 = 0").select(F.col("id").alias("query_id"), "vector")
    best = R.dense_per_group(rows, wanted, "label", 2)
    top = best.withColumn("top", F.max("score").over(Window.partitionBy("query_id", "label")))
    order = Window.partitionBy("query_id").orderBy(F.desc("top"), "label")
    return top.withColumn("n", F.dense_rank().over(order)).where("n <= 4").select("query_id", "label", "id", F.round("score", 9).alias("score"))


@query(
    """with s as (select distinct chunk_id, doc_id, position, token_count from chunks where doc_id is not null), b as (select *, ntile(4) over (partition by doc_id order by position, chunk_id) as bucket from s)
 select doc_id, bucket, arg_max(chunk_id, (coalesce(token_count, 0), chunk_id)) as chunk_id from b group by all"""
)
def position_buckets(spark, sf_dir):
    """From each quarter of a document's chunks the largest. A document's chunks are numbered through range partitions."""
    from sparkloom.operators.ordered import range_sorted

    rows = table(spark, sf_dir, "chunks").where("doc_id is not null and chunk_id is not null").select("chunk_id", "doc_id", "position", "token_count").distinct()
    parts = range_sorted(rows, ["doc_id"], ["position", "chunk_id"])
    sizes = parts.groupBy("doc_id", "part").agg(F.count("*").alias("rows"))
    over = Window.partitionBy("doc_id")
    before = over.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("offset", F.coalesce(F.sum("rows").over(before), F.lit(0))).withColumn("n", F.sum("rows").over(over))
    own = parts.withColumn("place", F.row_number().over(Window.partitionBy("doc_id", "part").orderBy("position", "chunk_id"))).join(sizes.drop("rows"), ["doc_id", "part"])
    at = F.col("place") + F.col("offset") - 1
    # ntile: the first n % 4 buckets hold one row more
    small, more = F.floor(F.col("n") / 4), F.col("n") % 4
    head = more * (small + 1)
    bucket = F.when(at < head, F.floor(at / (small + 1))).otherwise(more + F.floor((at - head) / F.greatest(small, F.lit(1)))) + 1
    return own.withColumn("bucket", bucket.cast("int")).groupBy("doc_id", "bucket").agg(F.max_by("chunk_id", F.struct(F.coalesce("token_count", F.lit(0)), "chunk_id")).alias("chunk_id"))


@query(f"select doc_id, case when {sql_tokens('text')} <= 200 then text end as whole, ({sql_tokens('text')}) > 200 as cut from documents where text is not null")
def trimmed_documents(spark, sf_dir):
    """Documents cut to 200 estimated tokens; those that fit come out whole."""
    rows = texts(spark, sf_dir).where("text is not null").withColumn("short", C.trimmed("text", 200))
    cut = X.token_estimate("text") > 200
    return rows.select("doc_id", F.when(~cut, F.col("short")).alias("whole"), cut.alias("cut"))


@query(
    """with c as (select distinct chunk_id, parent_chunk_id, text from chunks where text is not null), p as (select distinct parent_chunk_id, text from parent_chunks where text is not null)
 select chunk_id, length(p.text) > 600 as bounded, least(length(p.text), 600) as n from c join p using (parent_chunk_id)"""
)
def bounded_parents(spark, sf_dir):
    """Parents cut to 600 characters around their chunk."""
    chunks = table(spark, sf_dir, "chunks").where("text is not null").select("chunk_id", "parent_chunk_id", "text").distinct()
    parents = table(spark, sf_dir, "parent_chunks").where("text is not null").select("parent_chunk_id", F.col("text").alias("parent")).distinct()
    rows = chunks.join(parents, "parent_chunk_id").withColumn("context", C.around("parent", "text", 600))
    return rows.select("chunk_id", (F.length("parent") > 600).alias("bounded"), F.length("context").alias("n"))


def packets(spark, sf_dir):
    """Messages as packets of their session's context."""
    rows = O.message_records(table(spark, sf_dir, "session_messages")).where("content is not null")
    last = rows.groupBy("session").agg(F.max("created_at").alias("now"))
    age = (F.unix_micros(F.col("now").cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))) / 86400000000.0
    both = rows.join(last, "session")
    return both.select(F.col("session").alias("request"), F.col("message_id").alias("packet_id"), (F.col("created_at") == F.col("now")).alias("required"), F.lit(10).alias("priority"), F.least(F.lit(1.0), F.length("content") / 200.0).alias("relevance"), F.exp(-age / 30).alias("recency"), X.token_estimate("content").cast("long").alias("tokens"))


PACKETS = f"""
first as (select distinct on (message_id) message_id, lower(trim(session_id)) as request, created_at, content from session_messages
  where message_id is not null and session_id is not null and created_at is not null order by message_id, ingested_at, coalesce(role, ''), session_id),
own as (select *, max(created_at) over (partition by request) as now from first where content is not null),
packets as (select request, message_id as packet_id, created_at = now as required, least(1.0::double, length(content) / 200.0::double) as relevance, ({sql_tokens("content")})::bigint as tokens,
  0.7::double * least(1.0::double, length(content) / 200.0::double) + 0.3::double * exp(-((epoch_us(now) - epoch_us(created_at)) / 86400000000.0::double) / 30) + 10::double / 1000 as value from own),
listed as (select request, list({{'id': packet_id, 'n': tokens}} order by required desc, case when required then 10::double else value end desc, packet_id) as l from packets group by request),
sums as (select request, list_reduce(list_prepend([0::bigint], list_transform(l, lambda x: [x.n])), lambda a, b: list_append(a, case when list_sum(a) + b[1] <= 304 then b[1] else 0 end)) as taken, l from listed),
chosen as (select request, l[i].id as packet_id, l[i].n as tokens, taken[i + 1] = l[i].n as kept, list_sum(taken)::bigint as used from sums, unnest(range(1, len(l) + 1)) as r(i))"""


@query(f"with {PACKETS} select request, packet_id, kept, used from chosen")
def context_selection(spark, sf_dir):
    """The messages of each session that fit a prompt of 400 tokens."""
    return C.select(packets(spark, sf_dir), 400).select("request", "packet_id", "kept", "used")


@query(
    f"""with {PACKETS} select request, count(*) as packets, sum(kept::int) as kept, sum(c.tokens) as tokens, coalesce(sum(c.tokens) filter (kept), 0) as kept_tokens, round(avg(relevance) filter (kept), 9) as mean_relevance,
 sum((not kept and required)::int) as lost, round(case when sum(c.tokens) > 0 then coalesce(sum(c.tokens) filter (kept), 0) / sum(c.tokens) else 0 end, 9) as ratio from chosen c join packets using (request, packet_id) group by request"""
)
def context_quality(spark, sf_dir):
    out = C.quality(C.select(packets(spark, sf_dir), 400))
    return out.withColumn("mean_relevance", F.round("mean_relevance", 9)).withColumn("ratio", F.round("ratio", 9))


@query(
    f"""with {V}, s as (select q.id as query_id, v.id, v.label = q.label as same, list_cosine_similarity(v.v, q.v) as score from v, v q where q.id % 100 = 0),
 t as (select *, row_number() over (partition by query_id order by score desc, id) as rank from s where score > 0 qualify rank <= 9), n as (select query_id, count(*) as n from t group by 1)
 select query_id, count(*) as shown, sum(same::int) as relevant, sum((same and rank > n / 3.0 and rank <= 2 * n / 3.0)::int) as middle from t join n using (query_id) group by query_id"""
)
def lost_in_middle(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", doubles("embedding").alias("vector"))
    wanted = rows.where("id % 100 = 0").select(F.col("id").alias("query_id"), "vector", F.col("label").alias("wanted"))
    found = R.dense(rows, wanted, 9).join(rows.select("id", "label"), "id").join(wanted.select("query_id", "wanted"), "query_id")
    return C.lost_in_middle(found, F.col("label") == F.col("wanted"))


@query(
    rf"""with c as (select distinct chunk_id, parent_chunk_id, text from chunks where text is not null), p as (select distinct parent_chunk_id, lower(text) as source from parent_chunks where text is not null),
 t as (select chunk_id, source, list_distinct(list_concat(regexp_extract_all(lower(text), '[a-z0-9_]{{2,}}|[{HAN}]{{2,}}'), flatten(list_transform(regexp_extract_all(lower(text), '[{HAN}]{{3,}}'), lambda r: list_transform(range(1, length(r)), lambda i: substring(r, i, 2)))))) as terms from c join p using (parent_chunk_id))
 select chunk_id, round(case when len(terms) > 0 then len(list_filter(terms, lambda w: contains(source, w))) / len(terms) else 0 end, 9) as share from t"""
)
def grounded_chunks(spark, sf_dir):
    """Share of a chunk's terms that its parent holds."""
    chunks = table(spark, sf_dir, "chunks").where("text is not null").select("chunk_id", "parent_chunk_id", "text").distinct()
    parents = table(spark, sf_dir, "parent_chunks").where("text is not null").select("parent_chunk_id", F.col("text").alias("source")).distinct()
    return chunks.join(parents, "parent_chunk_id").select("chunk_id", F.round(X.lexical_fraction(X.query_terms("text"), "source"), 9).alias("share"))


@query(
    f"""with c as (select distinct chunk_id, parent_chunk_id, text from chunks where text is not null), p as (select distinct parent_chunk_id, lower(coalesce(text, '')) as source from parent_chunks),
 s as (select chunk_id, source, {sql_sentences("c.text")} as s from c join p using (parent_chunk_id)),
 e as (select chunk_id, source, (i - 1)::int as claim_no, s[i] as claim, {sql_query_terms("s[i]")} as terms from s, unnest(range(1, len(s) + 1)) as r(i)),
 f as (select *, case when len(terms) > 0 then len(list_filter(terms, lambda t: contains(source, t))) / len(terms) else 0 end as share from e)
 select chunk_id, claim_no, claim, round(share, 9) as share from f where share < 0.5"""
)
def unsupported_claims(spark, sf_dir):
    """Sentences of chunks that their parents do not support."""
    chunks = table(spark, sf_dir, "chunks").where("text is not null").select("chunk_id", "parent_chunk_id", F.col("text").alias("summary")).distinct()
    parents = table(spark, sf_dir, "parent_chunks").select("parent_chunk_id", F.col("text").alias("source")).distinct()
    return C.unsupported(chunks.join(parents, "parent_chunk_id")).where("not supported").select("chunk_id", "claim_no", "claim", F.round("share", 9).alias("share"))


@query(
    """with u as (select distinct on (event_id) event_id, lower(stage) as stage, model, latency_ms, success from usage_events order by event_id, received_at),
 a as (select stage, avg(latency_ms) as ms, count(*) as n, avg((success)::int) as ok from u where model like '%large' group by 1), b as (select stage, avg(latency_ms) as ms, count(*) as n, avg((success)::int) as ok from u where model like '%mini' group by 1)
 select a.stage, a.n as n_a, b.n as n_b, round(b.ms - a.ms, 6) as delta_ms, b.ok < a.ok as regressed from a join b on a.stage = b.stage"""
)
def run_comparison(spark, sf_dir):
    """Two runs by stage: deltas and regressions; both are one conditional aggregate."""
    u = O.first_copies(table(spark, sf_dir, "usage_events"), "event_id", "received_at").withColumn("stage", F.lower("stage"))
    a, b = F.col("model").endswith("large"), F.col("model").endswith("mini")
    each = u.where("stage is not null").groupBy("stage").agg(
        F.sum(a.cast("int")).alias("n_a"), F.sum(b.cast("int")).alias("n_b"), F.avg(F.when(a, F.col("latency_ms"))).alias("ms_a"), F.avg(F.when(b, F.col("latency_ms"))).alias("ms_b"),
        F.avg(F.when(a, F.col("success").cast("int"))).alias("ok_a"), F.avg(F.when(b, F.col("success").cast("int"))).alias("ok_b"),
    )
    return each.where("n_a > 0 and n_b > 0").select("stage", "n_a", "n_b", F.round(F.col("ms_b") - F.col("ms_a"), 6).alias("delta_ms"), (F.col("ok_b") < F.col("ok_a")).alias("regressed"))


@query(
    """select coalesce(case when success is not true then case when lower(error) similar to '.*(timeout|timed out|deadline).*' then 'timeout' when lower(error) similar to '.*(rate|429|quota).*' then 'rate_limit'
 when lower(error) similar to '.*(connect|network|reset|unreachable).*' then 'connectivity' when lower(error) similar to '.*(auth|401|403|key).*' then 'auth' when error is null then 'unknown' else 'other' end else 'none' end, 'none') as class, count(*) as n
 from (select distinct on (event_id) * from usage_events order by event_id, received_at) group by 1"""
)
def error_classes(spark, sf_dir):
    """Failures by the first rule that fits their message."""
    e = F.lower("error")
    kind = F.when(e.rlike("timeout|timed out|deadline"), "timeout").when(e.rlike("rate|429|quota"), "rate_limit").when(e.rlike("connect|network|reset|unreachable"), "connectivity").when(e.rlike("auth|401|403|key"), "auth").when(e.isNull(), "unknown").otherwise("other")
    u = O.first_copies(table(spark, sf_dir, "usage_events"), "event_id", "received_at")
    return u.groupBy(F.when(~F.coalesce("success", F.lit(False)), kind).otherwise("none").alias("class")).agg(F.count("*").alias("n"))


@query("select event_id, least(60, 0.5 * pow(2, (event_id % 10))) as delay, try_cast(json_extract_string(props, '$.k') as int) as k, try_cast(event_type as int) is null as text from events")
def coerced_values(spark, sf_dir):
    """Capped exponential back-off, and casts that give null instead of failing."""
    delay = F.least(F.lit(60.0), 0.5 * F.pow(F.lit(2.0), F.col("event_id") % 10))
    return table(spark, sf_dir, "events").select("event_id", delay.alias("delay"), F.get_json_object("props", "$.k").try_cast("int").alias("k"), F.col("event_type").try_cast("int").isNull().alias("text"))


@query("with p as (select o_custkey as packet, o_orderkey, o_orderpriority, o_orderdate from orders) select packet, o_orderkey from p qualify row_number() over (partition by packet order by o_orderpriority, o_orderdate desc, o_orderkey desc) = 1")
def keep_last_by_priority(spark, sf_dir):
    """Per packet the row of highest priority, the latest on ties: an aggregate, not a sort."""
    p = table(spark, sf_dir, "orders")
    first = F.min_by("o_orderkey", F.struct("o_orderpriority", -F.unix_micros(F.col("o_orderdate").cast("timestamp")), -F.col("o_orderkey")))
    return p.groupBy(F.col("o_custkey").alias("packet")).agg(first.alias("o_orderkey"))


@query("select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey order by l_shipdate, l_linenumber) as attempt from lineitem")
def attempt_numbers(spark, sf_dir):
    """Numbers within small groups; an order has a handful of lines."""
    order = Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_linenumber")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.row_number().over(order).alias("attempt"))


@query(
    """with m as (select distinct on (memory_id) memory_id, coalesce(memory_type, '') as kind, list_sort(list_distinct(regexp_extract_all(lower(content), '[a-z][a-z0-9_.+-]{2,}'))) as words
  from memories where content is not null and status = 'active' and memory_id is not null order by memory_id, updated_at desc, content desc),
 t as (select memory_id, kind, unnest(words) as w from m),
 p as (select a.memory_id from t a join t b on a.w = b.w and a.kind = b.kind and a.memory_id <> b.memory_id group by a.memory_id, b.memory_id having count(*) >= 3),
 n as (select memory_id, count(*) as links from p group by memory_id)
 select m.memory_id, min(m.memory_id) over (partition by kind, words) as class_id, coalesce(links, 0) as links from m left join n on n.memory_id = m.memory_id"""
)
def related_memories(spark, sf_dir):
    """Every active memory with its class of equal words, and the number of memories of its type that share three words or more."""
    return M.related(table(spark, sf_dir, "memories"))


@query("select asset_id, count(distinct region_id) as regions, count(distinct page_number) as pages, round(avg(confidence), 9) as confidence, sum(length(text)) as chars from (select distinct region_id, asset_id, page_number, confidence, text from ocr_regions) group by asset_id")
def asset_summary(spark, sf_dir):
    """Regions, pages and mean confidence per scanned asset."""
    rows = table(spark, sf_dir, "ocr_regions").select("region_id", "asset_id", "page_number", "confidence", "text").distinct()
    return rows.groupBy("asset_id").agg(F.countDistinct("region_id").alias("regions"), F.countDistinct("page_number").alias("pages"), F.round(F.avg("confidence"), 9).alias("confidence"), F.sum(F.length("text")).alias("chars"))


@query(f"with {HYBRID}, b as (select *, max(score) over (partition by query_id) as best from hybrid) select query_id, id, round(score, 9) as score, rank from b where score >= 0.75 * best and rank <= 3")
def threshold_and_floor(spark, sf_dir):
    """Results of the hybrid search that reach three quarters of their query's best score, three at most."""
    found = hybrid(spark, sf_dir)[3]
    best = found.withColumn("best", F.max("score").over(Window.partitionBy("query_id")))
    return best.where("score >= 0.75 * best and rank <= 3").select("query_id", "id", F.round("score", 9).alias("score"), "rank")


@query("select doc_id, substring(coalesce(text, ''), 1, 2000) as summary, length(coalesce(text, '')) > 2000 as more from documents")
def bounded_summaries(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    return texts(spark, sf_dir).select("doc_id", F.substring(t, 1, 2000).alias("summary"), (F.length(t) > 2000).alias("more"))


@query("select split_part(coalesce(canonical_path, ''), '/', 1) as root, lower(regexp_extract(canonical_path, '\\.([A-Za-z0-9]+)$', 1)) as ending, count(*) as n, sum(coalesce(n_chars, 0)) as chars from documents group by all")
def folder_counts(spark, sf_dir):
    root = F.split_part(F.coalesce("canonical_path", F.lit("")), F.lit("/"), F.lit(1))
    ending = F.lower(F.regexp_extract("canonical_path", r"\.([A-Za-z0-9]+)$", 1))
    return texts(spark, sf_dir).groupBy(root.alias("root"), ending.alias("ending")).agg(F.count("*").alias("n"), F.sum(F.coalesce("n_chars", F.lit(0))).alias("chars"))


@query("with m as (select distinct memory_id, source_session_id, memory_type, confidence, updated_at from memories) select source_session_id, count(*) as items, count(*) filter (memory_type = 'task') as tasks, max(updated_at) as last_at, arg_max(memory_id, (confidence, memory_id)) as surest from m where source_session_id is not null group by 1")
def session_memories(spark, sf_dir):
    m = table(spark, sf_dir, "memories").where("source_session_id is not null").select("memory_id", "source_session_id", "memory_type", "confidence", "updated_at").distinct()
    return m.groupBy("source_session_id").agg(F.count("*").alias("items"), F.sum((F.col("memory_type") == "task").cast("int")).alias("tasks"), F.max("updated_at").alias("last_at"), F.max_by("memory_id", F.struct("confidence", "memory_id")).alias("surest"))
