"""Queries of the text functions, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.functions.text import HAN, WS
from sparkloom.plans.registry import query
from sparkloom.tables import table, texts

#: The same character classes in DuckDB's regular expressions.
def sql_strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def sql_collapse(x: str) -> str:
    return sql_strip(rf"regexp_replace({x}, '[{WS}]+', ' ', 'g')")


def sql_tokens(x: str) -> str:
    other = rf"coalesce(length(regexp_replace({x}, '[^{HAN}]', '', 'g')) + length(regexp_replace({x}, '[{WS}A-Za-z0-9_{HAN}]', '', 'g')), 0)"
    return f"{other} + coalesce(list_sum(list_transform(regexp_extract_all({x}, '[A-Za-z0-9_]+'), lambda w: (length(w) + 3) // 4)), 0)"


def sql_sentences(x: str) -> str:
    marked = rf"regexp_replace(regexp_replace(regexp_replace({x}, '([。！？!?；;])[{WS}]*', '\1' || chr(1), 'g'), '([A-Za-z0-9]\.)[{WS}]+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: {sql_strip('s')}), lambda s: s <> '')"


@query(f"select doc_id, {sql_tokens('text')} as tokens from documents")
def token_estimate(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", T.token_estimate("text").alias("tokens"))


@query(f"select lang, count(*) as docs, sum({sql_tokens('text')}) as tokens, max({sql_tokens('text')}) as longest from documents group by lang")
def tokens_by_language(spark, sf_dir):
    tokens = T.token_estimate("text")
    return texts(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("docs"), F.sum(tokens).alias("tokens"), F.max(tokens).alias("longest"))


@query(f"select doc_id, unnest({sql_sentences('text')}) as sentence, generate_subscripts({sql_sentences('text')}, 1) as sentence_no from documents where text is not null")
def sentences(spark, sf_dir):
    rows = texts(spark, sf_dir).select("doc_id", F.posexplode(T.sentences("text")).alias("pos", "sentence"))
    return rows.select("doc_id", (F.col("pos") + 1).alias("sentence_no"), "sentence")


@query(f"select doc_id, {sql_collapse('text')} as text from documents")
def collapsed_text(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", T.collapse("text").alias("text"))


@query(
    rf"""with c as (select doc_id, text, length(text) as n,
 length(regexp_replace(text, '[^\x{{e000}}-\x{{f8ff}}\x{{0f00}}-\x{{0fff}}\x{{0}}-\x{{8}}\x{{e}}-\x{{1b}}\x{{fffd}}]', '', 'g')) as bad3,
 length(regexp_replace(text, '[^{WS}\x{{c}}\x{{21}}-\x{{7e}}{HAN}\x{{3040}}-\x{{30ff}}\x{{ac00}}-\x{{d7af}}\x{{ff00}}-\x{{ffef}}\p{{Nd}}\x{{2010}}-\x{{2027}}\x{{2030}}-\x{{205e}}\x{{3001}}-\x{{303f}}\x{{b7}}]', '', 'g')) as good from documents)
 select doc_id, round(case when n > 0 then good / (good + 3 * bad3 + n - bad3 - good)::double else 0 end, 9) as score from c"""
)
def text_quality(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", F.round(T.quality_score("text"), 9).alias("score"))


@query(
    rf"""with t as (select doc_id, length(text) as n_chars, {sql_strip("text")} as t from documents where text is not null), c as (select doc_id, n_chars, length(t) as n,
 length(regexp_replace(t, '[^\x{{e000}}-\x{{f8ff}}\x{{0f00}}-\x{{0fff}}]', '', 'g')) as rare, length(regexp_replace(t, '[^\x{{0530}}-\x{{1cff}}\x{{a000}}-\x{{abff}}]', '', 'g')) as exotic,
 length(regexp_replace(t, '[^\x{{e000}}-\x{{f8ff}}\x{{0f00}}-\x{{0fff}}\x{{0}}-\x{{8}}\x{{e}}-\x{{1b}}\x{{fffd}}]', '', 'g')) as bad3,
 length(regexp_replace(t, '[^{WS}\x{{c}}\x{{21}}-\x{{7e}}{HAN}\x{{3040}}-\x{{30ff}}\x{{ac00}}-\x{{d7af}}\x{{ff00}}-\x{{ffef}}\p{{Nd}}\x{{2010}}-\x{{2027}}\x{{2030}}-\x{{205e}}\x{{3001}}-\x{{303f}}\x{{b7}}]', '', 'g')) as good from t)
 select doc_id, n_chars from c where n >= 40 and (rare / n > 0.03 or exotic / n > 0.08 or good / (n + 2 * bad3) < 0.62)"""
)
def garbled_documents(spark, sf_dir):
    return texts(spark, sf_dir).where(T.is_garbled("text")).select("doc_id", F.length("text").alias("n_chars"))


@query(rf"select chunk_id, list_distinct(list_transform(regexp_extract_all(text, '\[(\d{{1,6}})\]', 1), lambda x: x::int)).list_filter(lambda x: x between 1 and 20).list_sort() as cited from chunks where text is not null")
def cited_numbers(spark, sf_dir):
    return table(spark, sf_dir, "chunks").where("text is not null").select("chunk_id", T.cited("text", F.lit(20)).alias("cited"))


@query("select doc_id, nullif(regexp_extract(text, '(?m)^#[ \\t]+(.+?)[ \\t]*$', 1), '') as heading from documents")
def first_heading(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", T.heading("text").alias("heading"))


@query(rf"select doc_id, regexp_replace(substring(regexp_replace(regexp_replace({sql_strip('title')}, '[^A-Za-z0-9_{HAN}-]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 28), '-+$', '', 'g') as slug from documents")
def title_slug(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", T.slug("title").alias("slug"))


@query(f"with t as (select message_id, {sql_collapse('content')} as t from session_messages) select message_id, case when length(t) > 28 then substring(t, 1, 28) || '...' else t end as title from t")
def message_titles(spark, sf_dir):
    return table(spark, sf_dir, "session_messages").select("message_id", T.short_title("content").alias("title"))


@query(
    r"""select message_id, regexp_replace(regexp_replace(regexp_replace(content, '(?i)\b(api[_-]?key|password|passwd|authorization|access[_-]?token|refresh[_-]?token|secret)\s*[:=]\s*[^\s,;]+', '\1=[REDACTED]', 'g'),
 '(?i)\b(bearer|basic)\s+[A-Za-z0-9._~+/=-]{8,}', '\1 [REDACTED]', 'g'), '(?i)\b([a-z][a-z0-9+.-]*://)[^\s/@:]+:[^\s/@]+@', '\1[REDACTED]@', 'g') as content,
 coalesce(regexp_matches(content, '(?i)api_key|apikey|secret|password|token=|bearer ') or regexp_matches(content, 'sk-[a-zA-Z0-9]{12,}'), false) as sensitive from session_messages"""
)
def secrets_redacted(spark, sf_dir):
    return table(spark, sf_dir, "session_messages").select("message_id", T.redact_secrets("content").alias("content"), T.is_sensitive("content").alias("sensitive"))


def sql_topic_terms(x: str) -> str:
    return rf"""list_sort(list_distinct(list_filter(list_concat(list_concat(regexp_extract_all(lower({x}), '[a-z][a-z0-9_.+-]{{2,}}'),
 flatten(list_transform(regexp_extract_all(lower({x}), '[{HAN}]{{2,}}'), lambda r: list_transform(range(1, length(r)), lambda i: substring(r, i, 2))))),
 flatten(list_transform(regexp_extract_all(lower({x}), '[{HAN}]{{3,}}'), lambda r: list_transform(range(1, length(r) - 1), lambda i: substring(r, i, 3))))),
 lambda t: t not in ('用户', '偏好', '项目', '决策', '使用', '采用', '改为', '调整', '希望', '以后'))))"""


@query(f"select memory_id, {sql_topic_terms('content')} as terms from memories where content is not null")
def memory_topic_terms(spark, sf_dir):
    return table(spark, sf_dir, "memories").where("content is not null").select("memory_id", F.array_sort(T.topic_terms("content")).alias("terms"))


@query(
    rf"""select g as gram, count(*) as n from (select unnest(flatten(list_transform(regexp_extract_all(text, '[{HAN}]{{2,}}'), lambda r: list_transform(range(1, length(r)), lambda i: substring(r, i, 2))))) as g from documents) group by g"""
)
def han_pair_counts(spark, sf_dir):
    return texts(spark, sf_dir).select(F.explode(T.han_grams("text", 2)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


@query("select doc_id, regexp_replace(lower(text), '[^a-z0-9_一-鿿]', '', 'g') as plain from documents")
def plain_answers(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", T.plain_answer("text").alias("plain"))


@query("select doc_id, case when length(text) > 600 then substring(text, 1, 200) || chr(10) || '[...]' || chr(10) || right(text, 393) else text end as text from documents")
def head_and_tail(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", T.head_and_tail("text", 600, 200).alias("text"))


@query(
    r"""with l as (select doc_id, list_filter(list_transform(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)), lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'), ' ')), lambda x: x <> '') as l from documents)
 select doc_id, array_to_string(list_filter(l, lambda x, i: i = 1 or x <> l[i - 1]), chr(10)) as text from l"""
)
def squeezed_lines(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", T.squeeze_lines("text").alias("text"))


def _sql_category() -> str:
    words = " ".join(f"when {' or '.join(f'contains(f, {chr(39)}{w}{chr(39)})' for w in ws)} then '{kind}'" for kind, ws in T.CATEGORY_WORDS)
    endings = " ".join(f"when regexp_extract(f, '\\.([^.]*)$', 1) in ({', '.join(repr(e) for e in es)}) then '{kind}'" for kind, es in T.CATEGORY_ENDINGS)
    return f"case when canonical_path is null then null {words} {endings} else 'other' end"


@query(rf"""with n as (select doc_id, canonical_path, lower(regexp_extract(canonical_path, '[^/\\]*$')) as f from documents) select doc_id, {_sql_category()} as category from n""")
def file_categories(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", T.file_category("canonical_path").alias("category"))


@query(r"select doc_id, regexp_replace(regexp_replace(regexp_replace(canonical_path, '^\s+|\s+$', '', 'g'), '#.*$', ''), '/+$', '').lower() as key, count(*) over (partition by regexp_replace(regexp_replace(regexp_replace(canonical_path, '^\s+|\s+$', '', 'g'), '#.*$', ''), '/+$', '').lower()) as same from documents where canonical_path is not null")
def canonical_paths(spark, sf_dir):
    docs = texts(spark, sf_dir).where("canonical_path is not null").select("doc_id", T.canonical_url("canonical_path").alias("key"))
    return docs.join(docs.groupBy("key").agg(F.count("*").alias("same")), "key").select("doc_id", "key", "same")


def _sql_urls(key: str, text: str, source: str) -> str:
    host = r"regexp_replace(lower(regexp_extract(url, '(?i)^https?://(?:[^/@?#]*@)?([^/:?#]+)', 1)), '^www\.', '')"
    path = "lower(regexp_extract(url, '(?i)^https?://[^/?#]*([^?#]*)', 1))"
    domains = "|".join(d.replace(".", r"\.") for d in T.NOISE_DOMAINS)
    return rf"""with u as (select {key}, unnest(list_transform(regexp_extract_all({text}, 'https?://[^\s<>"''()（），。；、]+'), lambda u: regexp_replace(u, '[.,;:!?）)】\]]+$', ''))) as url from {source} where {text} is not null),
 t as (select {key}, regexp_replace(case when regexp_matches(url, '[?&]uddg=[^&#]') then url_decode(regexp_extract(url, '[?&]uddg=([^&#]+)', 1)) else url end, '#.*$', '') as url from u),
 h as (select {key}, url, {host} as host, {path} as path from t)
 select distinct {key}, lower(regexp_replace(url, '/+$', '')) as url from h where host <> '' and not regexp_matches(host, '(^|\.)({domains})$') and host not in ({", ".join(map(repr, T.NOISE_HOSTS))}) and not regexp_matches(path, '\.({T.IMAGE_ENDINGS})$')"""


@query(_sql_urls("doc_id", "text", "documents"))
def text_urls(spark, sf_dir):
    """Addresses in texts, canonical, without noise, each once per document."""
    rows = texts(spark, sf_dir).select("doc_id", F.explode(T.urls("text")).alias("url")).withColumn("url", T.unwrap_url("url")).where(~T.is_noise_url("url"))
    return rows.select("doc_id", T.canonical_url("url").alias("url")).distinct()


def sql_entities(x: str) -> str:
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{sign}')"
    return x


@query(
    rf"""with d as (select doc_id, text, regexp_replace(regexp_replace(text, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'g'), '(?i)<(?:br|/p|/div|/tr|/li|/h[1-6])\b[^>]*>', chr(10), 'g') as t from documents where contains(lower(source_type), 'htm'))
 select doc_id, regexp_replace({sql_strip("regexp_replace(t, '<[^>]+>', ' ', 'g')")}, '[ \t]+', ' ', 'g') as text, {sql_collapse(sql_entities("regexp_replace(text, '<[^>]+>', '', 'g')"))} as flat from d"""
)
def html_plain(spark, sf_dir):
    """Web pages of the corpus as text, with their first heading."""
    docs = texts(spark, sf_dir).where(F.lower("source_type").contains("htm"))
    return docs.select("doc_id", T.html_to_text("text").alias("text"), T.strip_tags("text").alias("flat"))


@query("select message_id, try_cast(metadata as json) is not null as valid, json_extract_string(metadata, '$.client') as client, json_extract_string(metadata, '$.reply_to') as reply_to from session_messages where metadata is not null")
def message_metadata(spark, sf_dir):
    rows = table(spark, sf_dir, "session_messages").where("metadata is not null").withColumn("json", T.first_json("metadata"))
    return rows.select("message_id", F.col("json").isNotNull().alias("valid"), F.get_json_object("json", "$.client").alias("client"), F.get_json_object("json", "$.reply_to").alias("reply_to"))


@query("select doc_id, sha256(coalesce(text, '')) as digest, 'txt_' || substring(sha256(coalesce(text, '')), 1, 16) as content_id from documents")
def content_digest(spark, sf_dir):
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    return texts(spark, sf_dir).select("doc_id", digest.alias("digest"), F.concat(F.lit("txt_"), F.substring(digest, 1, 16)).alias("content_id"))


@query("select doc_id, coalesce(regexp_matches(text, '(^|[^0-9])' || year(created_at) || '\\s?[-/.年]\\s?0?' || month(created_at) || '\\s?[-/.月]\\s?0?' || day(created_at) || '([^0-9]|$)'), false) as named from documents")
def documents_naming_their_day(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", T.mentions_date("text", F.col("created_at")).alias("named"))


@query("select region_id, greatest(0, least(1, bbox.x0)) as x0, greatest(0, least(1, bbox.y0)) as y0, greatest(0, least(1, bbox.x1)) as x1, greatest(0, least(1, bbox.y1)) as y1 from ocr_regions where bbox is not null")
def clamped_boxes(spark, sf_dir):
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(f"bbox.{c}"))).alias(c)
    return table(spark, sf_dir, "ocr_regions").where("bbox is not null").select("region_id", *map(clamp, ("x0", "y0", "x1", "y1")))


@query(f"select chunk_id, case when parent_chunk_id is null then coalesce(source_label, 'document') || '#page-' || coalesce(page_number::varchar, '?') else coalesce(source_label, 'document') || '#chunk-' || position end as label, coalesce(token_count, 0) - ({sql_tokens('text')}) as off from chunks")
def chunk_labels(spark, sf_dir):
    name = F.coalesce("source_label", F.lit("document"))
    page = F.concat(name, F.lit("#page-"), F.coalesce(F.col("page_number").cast("string"), F.lit("?")))
    label = F.when(F.col("parent_chunk_id").isNull(), page).otherwise(F.concat(name, F.lit("#chunk-"), F.col("position").cast("string")))
    return table(spark, sf_dir, "chunks").select("chunk_id", label.alias("label"), (F.coalesce("token_count", F.lit(0)) - T.token_estimate("text")).alias("off"))


@query("select coalesce(n.lang, 'none') as lang, d.hour, count(*) as n from (select lang, hour(created_at) as hour from documents) d left join (select distinct lang from documents where lang is not null) n on n.lang = d.lang group by all")
def documents_by_hour(spark, sf_dir):
    docs = texts(spark, sf_dir).select(F.coalesce("lang", F.lit("none")).alias("lang"), F.hour("created_at").alias("hour"))
    return docs.groupBy("lang", "hour").agg(F.count("*").alias("n"))


@query(
    r"""select doc_id, array_to_string(list_transform(regexp_extract_all(lower(canonical_path), '\d+|\D+'), lambda p: case when regexp_matches(p, '^\d+$')
 then lpad(length(coalesce(nullif(ltrim(p, '0'), ''), '0'))::varchar, 9, '0') || coalesce(nullif(ltrim(p, '0'), ''), '0') else p end), '') as key from documents"""
)
def natural_order(spark, sf_dir):
    """Paths with keys in which numbers order by value."""
    return texts(spark, sf_dir).select("doc_id", T.natural_key("canonical_path").alias("key"))
