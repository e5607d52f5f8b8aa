"""Queries of block parsing, chunking, indexing, files and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sparkloom.operators import blocks as B
from sparkloom.plans.registry import query
from sparkloom.plans.text_queries import sql_sentences
from sparkloom.sources import files
from sparkloom.streaming import events as E
from sparkloom.tables import shared_dir, stored, table, texts

SQL_TYPE = r"regexp_replace(lower(trim(coalesce(source_type, ''))), '^\.', '')"


@query()
def document_blocks(spark, sf_dir):
    return B.blocks(texts(spark, sf_dir))


@query(
    rf"""with p as (select doc_id, unnest(regexp_split_to_array(text, '\n\s*\n')) as part from documents where text is not null and {SQL_TYPE} not in ('md', 'markdown', 'docx')),
 s as (select doc_id, regexp_replace(part, '^[\s\x0b\x{{1c}}-\x{{1f}}\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', '') as part from p),
 m as (select doc_id, regexp_replace(part, '(?i)^\[(page|slide|sheet)\s*:?\s+([^\]]+)\]\s*\n?', '') as part from s)
 select doc_id, count(*) as blocks from m where regexp_matches(part, '[^\s\x0b\x{{1c}}-\x{{1f}}\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]') group by doc_id"""
)
def marker_block_counts(spark, sf_dir):
    docs = texts(spark, sf_dir).where(~B.plain_type().isin(*B.MARKDOWN))
    return B.blocks(docs).groupBy("doc_id").agg(F.count("*").alias("blocks"))


@query()
def block_islands(spark, sf_dir):
    return B.islands(B.blocks(texts(spark, sf_dir)))


@query()
def document_chunks(spark, sf_dir):
    return B.chunks(texts(spark, sf_dir))


@query(f"select (select count(*) from documents where active = 1) as documents, (select count(distinct chunk_id) from chunks where active = 1) as chunks, (select coalesce(sum(len({sql_sentences('text')})), 0) from documents where active = 1 and text is not null) as sentences")
def index_stats(spark, sf_dir):
    docs = texts(spark, sf_dir).where("active = 1")
    a = docs.agg(F.count("*").alias("documents"))
    b = table(spark, sf_dir, "chunks").where("active = 1").agg(F.countDistinct("chunk_id").alias("chunks"))
    c = B.sentence_rows(docs).agg(F.count("*").alias("sentences"))
    return a.crossJoin(b).crossJoin(c)


CUT = "(select max(updated_at) - interval 30 day from documents)"


@query(
    f"""with k as (select doc_id, lower(trim(source)) || '/' || coalesce(canonical_path, '') as path, md5(coalesce(text, '')) as h, parser_version as v, updated_at from documents),
 old as (select distinct path, h, v from k where updated_at < {CUT})
 select k.doc_id, (o.h is not null) as unchanged from k left join old o on k.path is not distinct from o.path and k.h = o.h and k.v is not distinct from o.v where k.updated_at >= {CUT}"""
)
def incremental_skip(spark, sf_dir):
    """Documents of the last 30 days: unchanged if path, hash and parser are in the index of the time before."""
    docs = texts(spark, sf_dir)
    cut = docs.agg((F.max("updated_at") - F.expr("interval 30 days")).alias("cut"))
    path = F.concat(F.lower(F.trim("source")), F.lit("/"), F.coalesce("canonical_path", F.lit("")))
    rows = docs.crossJoin(F.broadcast(cut)).select("doc_id", path.alias("path"), F.md5(F.coalesce("text", F.lit(""))).alias("h"), F.col("parser_version").alias("v"), (F.col("updated_at") >= F.col("cut")).alias("new"))
    old = rows.where("not new").select("path", "h", "v").distinct().withColumn("there", F.lit(True)).alias("o")
    new = rows.where("new").alias("n")
    same = F.col("n.path").eqNullSafe(F.col("o.path")) & (F.col("n.h") == F.col("o.h")) & F.col("n.v").eqNullSafe(F.col("o.v"))
    return new.join(old, same, "left").select("n.doc_id", F.coalesce("o.there", F.lit(False)).alias("unchanged"))


@query("with t as (select doc_id, lower(trim(source)) || '|' || coalesce(title, '') as k, updated_at, active from documents) select doc_id, (active = 1 and row_number() over (partition by k order by updated_at desc nulls last, doc_id desc) = 1)::int as active from t")
def version_upsert(spark, sf_dir):
    """Older versions of a path become inactive: the newest per key is joined back, so no key is sorted in one task."""
    docs = texts(spark, sf_dir).select("doc_id", F.concat_ws("|", F.lower(F.trim("source")), F.coalesce("title", F.lit(""))).alias("k"), F.lower(F.trim("source")).isNull().alias("no_source"), "updated_at", "active")
    docs = docs.withColumn("k", F.when(~F.col("no_source"), F.col("k")))
    at = F.struct(F.coalesce("updated_at", F.lit("0001-01-01").cast("timestamp_ntz")), "doc_id")
    newest = docs.groupBy("k").agg(F.max_by("doc_id", at).alias("newest"))
    both = docs.alias("d").join(newest.alias("n"), F.col("d.k").eqNullSafe(F.col("n.k")))
    return both.select("doc_id", F.coalesce((F.col("active") == 1) & (F.col("doc_id") == F.col("newest")), F.lit(False)).cast("int").alias("active"))


@query("select doc_id, title, text, n_chars from documents")
def jsonl_round_trip(spark, sf_dir):
    """Documents written as JSON lines and read again."""
    path = f"{shared_dir(spark)}/jsonl/{uuid.uuid4().hex}"
    files.append_jsonl(texts(spark, sf_dir).select("doc_id", "title", "text", "n_chars"), path)
    return files.read_jsonl(spark, path, "doc_id long, title string, text string, n_chars long")


@query("select m.session_id, m.messages, m.transcript from (select lower(trim(session_id)) as session_id, count(*) as messages, sum(length(content)) as transcript from (select distinct on (message_id) message_id, session_id, content, created_at from session_messages where session_id is not null and message_id is not null and created_at is not null order by message_id, ingested_at, coalesce(role, ''), session_id) group by 1) m")
def session_export(spark, sf_dir):
    """Messages written in folders by day and read again; per session its messages and characters."""
    from sparkloom.operators.tables import message_records

    rows = message_records(table(spark, sf_dir, "session_messages")).withColumn("day", F.to_date("created_at"))
    rows = stored(rows, "day")
    return rows.groupBy(F.col("session").alias("session_id")).agg(F.count("*").alias("messages"), F.sum(F.length("content")).alias("transcript"))


# ---- streams ----


@query("select event_id, user_id, event_type, value from events")
def stream_replay(spark, sf_dir):
    """The event log through a stream and an exactly-once sink."""
    return E.drain(E.source(spark, f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value"), spark)


@query("select date_trunc('hour', ts)::timestamp as hour, event_type, count(*) as n, round(sum(value), 6) as value from events group by all")
def stream_hourly(spark, sf_dir):
    out = E.drain_updates(E.hourly(E.source(spark, f"{sf_dir}/events.parquet")), spark, ["hour", "event_type"])
    return out.select(F.col("hour").cast("timestamp_ntz").alias("hour"), "event_type", "n", F.round("value", 6).alias("value"))


@query("select distinct event_id, lower(stage) as stage, model from usage_events")
def stream_once(spark, sf_dir):
    """Usage events whose repeated deliveries are dropped by state."""
    out = E.once(E.source(spark, f"{sf_dir}/usage_events.parquet"), "event_id", "ts", "3650 days")
    return E.drain(out.select("event_id", F.lower("stage").alias("stage"), "model"), spark)


@query("select user_id, count(*) // 30 as fired from events group by user_id")
def stream_fired(spark, sf_dir):
    return E.drain_updates(E.fired(E.source(spark, f"{sf_dir}/events.parquet").select("user_id", "event_id")), spark, ["user_id"])


@query(
    """with e as (select user_id, ts, case when ts >= lag(ts) over w + interval 30 minute or lag(ts) over w is null then 1 else 0 end as starts from events window w as (partition by user_id order by ts)),
 s as (select *, sum(starts) over (partition by user_id order by ts rows unbounded preceding) as no from e)
 select user_id, min(ts)::timestamp as first_at, max(ts)::timestamp + interval 30 minute as closed_at, count(*) as n from s group by user_id, no"""
)
def activity_sessions(spark, sf_dir):
    """Session windows; the same function serves streams."""
    out = E.sessions(table(spark, sf_dir, "events"))
    return out.select("user_id", F.col("first_at").cast("timestamp_ntz").alias("first_at"), F.col("closed_at").cast("timestamp_ntz").alias("closed_at"), "n")
