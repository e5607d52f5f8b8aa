"""The queries of the subpackage: pN_ belongs to problem N."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.llm import conversations, mojibake, ocr, packing, personal, quantiles, splitting, tokens
from sparkloom.tables import stored, table, texts

QUERIES = {}
SQL = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def p2_found(spark, sf_dir):
    """Every message of every conversation that is kept."""
    rows = conversations.conversations(texts(spark, sf_dir, "session_messages"))
    return rows.where("kept").select(F.col("session").alias("session_id"), "turn_no", "message_id")


def _sql_speaker() -> str:
    edge = r"^[\p{Z}\p{C}\s<\[|:*]+|[\p{Z}\p{C}\s>\]|:*]+$"
    plain = rf"regexp_replace(lower(trim(regexp_replace(role, '{edge}', '', 'g'))), '[\s_-]+', ' ', 'g')"
    names = {k: ", ".join("'" + x.replace("_", " ").replace("-", " ") + "'" for x in v) for k, v in conversations.SPEAKERS.items()}
    return "case " + " ".join(f"when {plain} in ({v}) then '{k}'" for k, v in names.items()) + " end"


SQL["p2_found"] = rf"""
with one as (
  select distinct on (message_id) message_id, nullif(lower(regexp_replace(session_id, '^[\p{{Z}}\p{{C}}\s]+|[\p{{Z}}\p{{C}}\s]+$', '', 'g')), '') as s, {_sql_speaker()} as sp, created_at as t,
    coalesce(length(regexp_replace(content, '{conversations.UNSEEN}', '', 'g')) > 0, false) as visible, nullif(trim(json_extract_string(metadata, '$.reply_to')), '') as reply
  from session_messages where message_id is not null order by message_id, coalesce(ingested_at, created_at), coalesce(role, ''), coalesce(session_id, '')),
m as (select * from one where s is not null),
talk as (select *, lead(sp) over w as nxt, row_number() over w as n from m where sp is null or sp in ('user', 'assistant') window w as (partition by s order by t nulls first, message_id)),
bad as (select s from talk where (sp = 'user' and nxt is distinct from 'assistant') or (n = 1 and sp is distinct from 'user')),
lost as (select s from m where reply is not null and not exists (select 1 from m r where r.s = m.s and r.message_id = m.reply)),
good as (select s from m group by s having bool_or(sp = 'user') and bool_or(sp = 'assistant') and bool_and(sp is not null and t is not null and visible))
select s as session_id, cast(row_number() over (partition by s order by t, message_id) as int) as turn_no, message_id
from m where s in (select s from good) and s not in (select s from bad) and s not in (select s from lost)
"""


@query
def p2_threads(spark, sf_dir):
    """Per link tree of every session: its size, first and last turn."""
    rows = conversations.conversations(texts(spark, sf_dir, "session_messages"))
    return rows.groupBy(F.col("session").alias("session_id"), "root_turn", "kept").agg(F.count("*").alias("messages"), F.max("turn_no").alias("last_turn"))


@query
def p2_trees(spark, sf_dir):
    """Per session: its messages, and whether its link trees hold each of them once, every parent and root before its children."""
    rows = conversations.conversations(texts(spark, sf_dir, "session_messages"))
    ok = (F.col("root_turn") <= F.col("turn_no")) & F.coalesce((F.col("parent_turn") < F.col("turn_no")) & (F.col("parent_turn") >= F.col("root_turn")), F.col("root_turn") == F.col("turn_no"))
    out = rows.groupBy(F.col("session").alias("session_id")).agg(F.count("*").alias("messages"), (F.min(ok) & (F.max("turn_no") == F.count("*")) & (F.min("turn_no") == 1) & (F.sum("turn_no") == F.count("*") * (F.count("*") + 1) / 2)).alias("whole"))
    return out


SQL["p2_trees"] = r"""
with one as (
  select distinct on (message_id) message_id, nullif(lower(regexp_replace(session_id, '^[\p{Z}\p{C}\s]+|[\p{Z}\p{C}\s]+$', '', 'g')), '') as s
  from session_messages where message_id is not null order by message_id, coalesce(ingested_at, created_at), coalesce(role, ''), coalesce(session_id, ''))
select s as session_id, count(*) as messages, true as whole from one where s is not null group by s
"""


def _latencies(spark, sf_dir):
    return stored(quantiles.latencies(table(spark, sf_dir, "usage_events")))


@query
def p3_calls(spark, sf_dir):
    """Every call with its group's band: the first point whose exact percentile is not below the latency, null above all."""
    calls = stored(quantiles.latencies(table(spark, sf_dir, "usage_events"), "event_id"))
    values = quantiles.quantiles(calls, ["stage", "model"], table(spark, sf_dir, "quantile_points"))
    return quantiles.banded(calls, values, ["stage", "model"]).select("event_id", "stage", "model", "latency_ms", "band")


SQL["p3_calls"] = """
with ranked as (
  select *, row_number() over (partition by event_id order by received_at) as copy from usage_events),
calls as (
  select event_id, lower(trim(stage)) as stage, model, latency_ms from ranked where copy = 1 and latency_ms is not null and not isnan(latency_ms)),
placed as (
  select *, row_number() over (partition by stage, model order by latency_ms) as place, count(*) over (partition by stage, model) as n from calls),
points as (
  select p.stage, p.model, q.q, p.latency_ms as v
  from placed p join (select distinct q from quantile_points) q on p.place = greatest(1, cast(ceil(q.q * p.n) as bigint)))
select c.event_id, c.stage, c.model, c.latency_ms, min(p.q) as band
from calls c left join points p on c.stage is not distinct from p.stage and c.model is not distinct from p.model and p.v >= c.latency_ms
group by all
"""


@query
def p3_percentiles(spark, sf_dir):
    """Exact percentiles per stage and model: lower equals upper."""
    out = quantiles.quantiles(_latencies(spark, sf_dir), ["stage", "model"], table(spark, sf_dir, "quantile_points"))
    return out.select("stage", "model", "q", "n", F.col("lower").alias("latency_ms"), F.col("upper").alias("upper_ms"))


SQL["p3_percentiles"] = """
with ranked as (
  select *, row_number() over (partition by event_id order by received_at) as copy from usage_events),
calls as (
  select lower(trim(stage)) as stage, model, latency_ms from ranked where copy = 1 and latency_ms is not null and not isnan(latency_ms)),
placed as (
  select *, row_number() over (partition by stage, model order by latency_ms) as place, count(*) over (partition by stage, model) as n from calls)
select p.stage, p.model, q.q, p.n, p.latency_ms as latency_ms, p.latency_ms as upper_ms
from placed p join (select distinct q from quantile_points) q on p.place = greatest(1, cast(ceil(q.q * p.n) as bigint))
"""


@query
def p3_daily(spark, sf_dir):
    """Percentiles of every day (y-m-d), read off the day's histogram, with their bounds."""
    days = _latencies(spark, sf_dir).withColumn("day", F.date_format("day", "yyyy-MM-dd"))
    hist = quantiles.histogram(days, ["day", "stage", "model"])
    out = quantiles.histogram_quantiles(hist, ["day", "stage", "model"], table(spark, sf_dir, "quantile_points"))
    return out.select("day", "stage", "model", "q", "n", "lower", "upper")


def _bounds_sql(groups: str) -> str:
    """The cell of the value of nearest rank: sign, exponent and the first 12 bits of the fraction. That of 0 is the first of the subnormal numbers."""
    return f"""
with ranked as (
  select *, row_number() over (partition by event_id order by received_at) as copy from usage_events),
calls as (
  select strftime(ts, '%Y-%m-%d') as day, lower(trim(stage)) as stage, model, latency_ms from ranked where copy = 1 and latency_ms is not null and not isnan(latency_ms)),
placed as (
  select *, row_number() over (partition by {groups} order by latency_ms) as place, count(*) over (partition by {groups}) as n from calls),
points as (
  select p.*, q.q, case when p.latency_ms > 0 then pow(2.0, floor(log2(p.latency_ms)) - 12) end as step
  from placed p join (select distinct q from quantile_points) q on p.place = greatest(1, cast(ceil(q.q * p.n) as bigint)))
select {groups}, q, n, coalesce(floor(latency_ms / step) * step, 0) as lower, coalesce(floor(latency_ms / step) * step + step - step * pow(2.0, -40), pow(2.0, -1034) - pow(2.0, -1074)) as upper from points
"""


SQL["p3_daily"] = _bounds_sql("day, stage, model")


@query
def p3_combined(spark, sf_dir):
    """Percentiles of all days, read off the sum of the days' histograms, with their bounds."""
    days = quantiles.histogram(_latencies(spark, sf_dir), ["day", "stage", "model"])
    hist = quantiles.merged(days, ["stage", "model"])
    out = quantiles.histogram_quantiles(hist, ["stage", "model"], table(spark, sf_dir, "quantile_points"))
    return out.select("stage", "model", "q", "n", "lower", "upper")


SQL["p3_combined"] = _bounds_sql("stage, model")


def _items(spark, sf_dir):
    documents, limits = table(spark, sf_dir, "documents"), table(spark, sf_dir, "size_limits")
    for name, item_id, kind in (("parent_chunks", "parent_chunk_id", "parent"), ("chunks", "chunk_id", "chunk")):
        items = texts(spark, sf_dir, name)
        yield name, items, item_id, splitting.limited(items, item_id, kind, documents, limits)


@query
def p4_found(spark, sf_dir):
    """Items that had to be cut."""
    (a, *x), (b, *y) = _items(spark, sf_dir)
    both = splitting.split_items(*x).withColumn("source_table", F.lit(a)).unionByName(splitting.split_items(*y).withColumn("source_table", F.lit(b)))
    return both.where(F.size("spans") > 1).select("source_table", "item_id")


SQL["p4_found"] = r"""
with types as (select doc_id, regexp_replace(lower(trim(source_type)), '^[\s.]+|\s+$', '', 'g') as type from documents),
items as (
  select distinct 'parent_chunks' as source_table, parent_chunk_id as item_id, doc_id, text, 'parent' as kind from parent_chunks
  union all
  select distinct 'chunks', chunk_id, doc_id, text, 'chunk' from chunks)
select i.source_table, i.item_id
from items i left join types t on i.doc_id = t.doc_id
left join size_limits l on l.item_kind = i.kind and l.source_type = t.type
join size_limits d on d.item_kind = i.kind and d.source_type = 'default'
where length(i.text) > coalesce(l.max_chars, d.max_chars)
"""


def _pieces(spark, sf_dir):
    (a, *x), (b, *y) = _items(spark, sf_dir)
    return splitting.pieces(*x).withColumn("source_table", F.lit(a)).unionByName(splitting.pieces(*y).withColumn("source_table", F.lit(b)))


@query
def p4_pieces(spark, sf_dir):
    """The pieces of all items, in order."""
    return _pieces(spark, sf_dir).select("source_table", "item_id", "piece_no", "start_pos", "n_chars", "text")


@query
def p4_kept(spark, sf_dir):
    """Per item of the pieces: its length, whether every piece keeps the limit, and whether the pieces follow each other without a gap and rebuild the text."""
    piece = F.struct("piece_no", "start_pos", "n_chars", "max_chars", F.length("text").alias("length"))
    own = _pieces(spark, sf_dir).groupBy("source_table", "item_id").agg(F.array_sort(F.collect_list(piece)).alias("p"))
    end = lambda x: x["start_pos"] + x["n_chars"]
    first = F.struct(F.lit(0).alias("no"), F.lit(0).alias("end"), F.lit(-1).alias("start"), F.lit(True).alias("ok"))

    def step(acc, x):
        ok = acc["ok"] & (x["piece_no"] == acc["no"]) & (x["start_pos"] <= acc["end"]) & (x["start_pos"] > acc["start"]) & (end(x) >= acc["end"]) & (x["length"] == x["n_chars"])
        return F.struct((acc["no"] + 1).alias("no"), end(x).alias("end"), x["start_pos"].alias("start"), ok.alias("ok"))

    done = F.aggregate("p", first, step)
    return own.select("source_table", "item_id", done["end"].alias("n_chars"), F.forall("p", lambda x: x["n_chars"] <= x["max_chars"]).alias("within"), done["ok"].alias("in_order"))


SQL["p4_kept"] = """
select distinct 'parent_chunks' as source_table, parent_chunk_id as item_id, length(text) as n_chars, true as within, true as in_order from parent_chunks where text is not null
union all
select distinct 'chunks', chunk_id, length(text), true, true from chunks where text is not null
"""


@query
def p6_ids(spark, sf_dir):
    """Token ids of every document."""
    return tokens.encode_corpus(texts(spark, sf_dir, "documents"))


@query
def p6_decoded(spark, sf_dir):
    """Every document's text from its ids: equal to the text, empty for null."""
    return tokens.decode_corpus(tokens.encode_corpus(texts(spark, sf_dir, "documents")))


SQL["p6_decoded"] = "select doc_id, coalesce(text, '') as text from documents"


@query
def p8_found(spark, sf_dir):
    """Documents with damaged characters."""
    return mojibake.restore(texts(spark, sf_dir, "documents")).where("damaged > 0").select("doc_id")


@query
def p8_restored(spark, sf_dir):
    """All documents, the damaged ones restored as far as possible."""
    return mojibake.restore(texts(spark, sf_dir, "documents"))


def _messages(spark, sf_dir):
    a = texts(spark, sf_dir, "memories").select(F.lit("memories").alias("source_table"), F.col("memory_id").alias("record_id"), F.col("content").alias("text"))
    b = texts(spark, sf_dir, "session_messages").select(F.lit("session_messages").alias("source_table"), F.col("message_id").alias("record_id"), F.col("content").alias("text"))
    return a.unionByName(b)


@query
def p1_found(spark, sf_dir):
    """Every mention of personal information."""
    out = personal.find_mentions(_messages(spark, sf_dir), table(spark, sf_dir, "given_names"))
    return out.select("source_table", "record_id", F.explode("found").alias("m")).select("source_table", "record_id", "m.pii_type", "m.start_pos")


@query
def p1_redacted(spark, sf_dir):
    """All texts with placeholders."""
    out = personal.find_mentions(_messages(spark, sf_dir), table(spark, sf_dir, "given_names"), personal.secret_key(spark))
    return out.select("source_table", "record_id", F.col("redacted").alias("content"))


def _scans(spark, sf_dir):
    return ocr.examined(texts(spark, sf_dir, "ocr_regions"), texts(spark, sf_dir, "chunks"), texts(spark, sf_dir, "documents"))


@query
def p5_found(spark, sf_dir):
    """Kinds of noise in regions and chunks of scanned files."""
    regions, chunks = _scans(spark, sf_dir)
    a = ocr.noise(regions).select(F.lit("ocr_regions").alias("source_table"), "record_id", "noise_type")
    return a.unionByName(ocr.noise(chunks).select(F.lit("chunks").alias("source_table"), "record_id", "noise_type"))


@query
def p5_paragraphs(spark, sf_dir):
    """The running text of every scanned document, paragraph by paragraph, from its regions and from its chunks."""
    regions, chunks = _scans(spark, sf_dir)
    a = ocr.paragraphs(regions).withColumn("source_table", F.lit("ocr_regions"))
    return a.unionByName(ocr.paragraphs(chunks).withColumn("source_table", F.lit("chunks")))


def _packed(spark, sf_dir):
    """Every kind of container is filled with sizes by the tokenizer that it names."""
    containers = table(spark, sf_dir, "containers").select("container_kind", F.col("capacity_tokens").alias("capacity"), "tokenizer")
    docs = texts(spark, sf_dir, "documents")
    items = None
    for (name,) in sorted(containers.select("tokenizer").distinct().collect()):  # a short fixed list
        sizes = stored(tokens.count_tokens(docs, path=tokens.vocabulary_path(name)).select(F.col("doc_id").alias("key"), F.col("n_tokens").alias("size")))
        own = packing.pieces(sizes, containers.where(F.col("tokenizer") == name).drop("tokenizer"))
        items = own if items is None else items.unionByName(own)
    return packing.packed(stored(items))


@query
def p7_assigned(spark, sf_dir):
    """The container of every document, or of its pieces."""
    out = _packed(spark, sf_dir)
    return out.select("container_kind", "container_id", F.col("key").alias("doc_id"), "piece_no", F.col("size").alias("n_tokens"))


@query
def p7_fill(spark, sf_dir):
    """Per kind: containers, tokens, and the share of the capacity that is filled."""
    out = _packed(spark, sf_dir).groupBy("container_kind", "capacity").agg(F.countDistinct("container_id").alias("containers"), F.sum("size").alias("tokens"))
    return out.withColumn("filled", F.col("tokens") / (F.col("containers") * F.col("capacity")))


@query
def p7_placed(spark, sf_dir):
    """Per kind: documents placed, and how many are placed twice, divided though they fit, or in a container that holds too much."""
    out = _packed(spark, sf_dir)
    docs = out.groupBy("container_kind", "capacity", "key").agg(F.count("*").alias("pieces"), F.countDistinct("piece_no").alias("numbers"), F.sum("size").alias("size"))
    docs = docs.groupBy("container_kind").agg(F.count("*").alias("documents"), F.sum((F.col("pieces") != F.col("numbers")).cast("int")).alias("twice"), F.sum(((F.col("pieces") > 1) & (F.col("size") <= F.col("capacity"))).cast("int")).alias("divided"))
    bins = out.groupBy("container_kind", "capacity", "container_id").agg(F.sum("size").alias("size")).groupBy("container_kind").agg(F.sum((F.col("size") > F.col("capacity")).cast("int")).alias("overfull"))
    return docs.join(bins, "container_kind").select("container_kind", "documents", "twice", "divided", "overfull")


SQL["p7_placed"] = "select container_kind, (select count(*) from documents) as documents, 0 as twice, 0 as divided, 0 as overfull from containers"
