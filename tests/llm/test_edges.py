"""Empty tables, nulls in any column, repeated rows, ties, clashing columns and very long texts."""

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import conversations, mojibake, ocr, packing, personal, quantiles, splitting, tokens

DOCS = "doc_id long, text string, source_type string, type string, key string, row long"
LIMITS = [("md", "chunk", 40, 5), (None, "chunk", 9, 1), ("default", "chunk", 20, 4), ("default", "parent", 50, 5)]


@pytest.fixture(scope="module")
def limits(spark):
    return spark.createDataFrame(LIMITS, "source_type string, item_kind string, max_chars int, overlap_chars int")


def test_empty(spark, limits):
    docs = spark.createDataFrame([], DOCS)
    items = spark.createDataFrame([], "chunk_id string, doc_id long, text string")
    assert splitting.pieces(items, "chunk_id", splitting.limited(items, "chunk_id", "chunk", docs, limits)).count() == 0
    assert tokens.encode_corpus(docs).count() == tokens.count_tokens(docs).count() == tokens.decode_corpus(tokens.encode_corpus(docs)).count() == 0
    assert mojibake.restore(docs).count() == 0
    rows = spark.createDataFrame([], "source_table string, record_id string, text string")
    assert personal.find_mentions(rows, spark.createDataFrame([], "given_name string, lang string")).count() == 0
    regions = spark.createDataFrame([], "region_id string, doc_id long, page_number int, region_order int, text string")
    chunks = spark.createDataFrame([], "chunk_id string, doc_id long, parent_chunk_id string, position int, text string, page_number int")
    a, b = ocr.examined(regions, chunks, docs)
    assert ocr.noise(a).count() == ocr.noise(b).count() == ocr.paragraphs(a).count() == 0
    events = spark.createDataFrame([], "event_id long, ts timestamp, received_at timestamp, stage string, model string, latency_ms double")
    points = spark.createDataFrame([(0.5,), (None,), (0.5,)], "q double")
    assert quantiles.quantiles(quantiles.latencies(events), ["stage", "model"], points).count() == 0
    assert packing.packed(packing.pieces(spark.createDataFrame([], "key long, size long"), spark.createDataFrame([("a", 5)], "container_kind string, capacity int"))).count() == 0


def test_limits_by_type(spark, limits):
    docs = spark.createDataFrame([(1, "x", " .MD", "md", "k", 1), (2, "x", None, "md", "k", 1), (1, "x", " .MD", "md", "k", 1)], DOCS)
    text = "One short sentence. Another one here. "
    items = [("a", 1, text), ("a", 1, text), ("b", 2, text), ("c", None, text), ("d", 1, None), ("e", 9, ""), ("f", 1, text * 3000)]
    rows = spark.createDataFrame(items, "chunk_id string, doc_id long, text string")
    out = splitting.limited(rows, "chunk_id", "chunk", docs, limits)
    sizes = {r["item_id"]: (r["max_chars"], r["overlap_chars"]) for r in out.collect()}
    assert sizes == {"a": (40, 5), "b": (20, 4), "c": (20, 4), "d": (40, 5), "e": (20, 4), "f": (40, 5)}
    pieces = splitting.pieces(rows, "chunk_id", out).collect()
    assert {r["item_id"] for r in pieces} == {"a", "b", "c", "e", "f"}
    for item in "abcf":
        own = sorted((r for r in pieces if r["item_id"] == item), key=lambda r: r["piece_no"])
        whole = text * 3000 if item == "f" else text
        assert all(whole[r["start_pos"] : r["start_pos"] + r["n_chars"]] == r["text"] and len(r["text"]) <= sizes[item][0] for r in own)
        assert own[0]["start_pos"] == 0 and own[-1]["start_pos"] + own[-1]["n_chars"] == len(whole)


def test_repeated_calls_and_null_groups(spark):
    rows = [(1, 1, 5, "A", "m", 10.0), (1, 1, 9, "A", "m", 99.0), (2, 1, 1, "a ", "m", 20.0), (3, 1, 1, None, None, 7.0), (4, 1, 1, "a", "m", None), (None, 1, 1, "a", "m", 30.0)]
    df = spark.createDataFrame(rows, "event_id long, t long, r long, stage string, model string, latency_ms double").withColumn("ts", F.timestamp_seconds("t")).withColumn("received_at", F.timestamp_seconds("r"))
    out = quantiles.quantiles(quantiles.latencies(df), ["stage", "model"], spark.createDataFrame([(0.5,)], "q double")).collect()
    assert {(r["stage"], r["model"]): (r["n"], r["lower"]) for r in out} == {("a", "m"): (3, 20.0), (None, None): (1, 7.0)}


def test_very_long_texts(spark):
    long = "naïve café " * 60_000
    docs = spark.createDataFrame([(1, long, "txt", "t", "k", 1), (2, "x" * 200_000, None, None, None, None)], DOCS)
    assert {r["doc_id"]: r["n_tokens"] for r in tokens.count_tokens(docs).collect()}[1] == len(tokens.byte_encoder(f"{tokens.tokenizer_dir()}/byte_bpe_50k.tiktoken").encode_ordinary(long))
    assert {r["doc_id"]: r["text"] for r in mojibake.restore(docs).collect()}[1] == long
    assert personal.mentions(long, personal.Lexicon(set(), set(), set())) == []


def test_one_hot_session(spark):
    """A session of thousands of messages at one instant is split over partitions and comes out whole."""
    n = 3000
    rows = spark.range(n).select(F.format_string("m%06d", "id").alias("message_id"), F.lit("hot").alias("session_id"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.lit("same words").alias("content"), F.lit("2025-01-01 00:00:00").cast("timestamp_ntz").alias("created_at"), F.lit(None).cast("string").alias("metadata"), F.lit("2025-01-01 00:00:00").cast("timestamp_ntz").alias("ingested_at"))
    out = conversations.conversations(rows)
    assert out.where("kept").count() == n and out.agg(F.max("turn_no")).first()[0] == n


def test_items_without_a_limit_stay_whole(spark, limits):
    docs = spark.createDataFrame([(1, "x", "md", "md", "k", 1)], DOCS)
    rows = spark.createDataFrame([("a", 1, "word " * 50), ("b", None, "word " * 50)], "chunk_id string, doc_id long, text string")
    sizes = splitting.limited(rows, "chunk_id", "chunk", docs, limits.where("source_type = 'md'"))
    assert {r["item_id"]: r["n"] for r in splitting.pieces(rows, "chunk_id", sizes).groupBy("item_id").agg(F.count("*").alias("n")).collect()}["b"] == 1


def test_containers_name_their_tokenizer():
    assert tokens.vocabulary_path("byte_bpe_50k").endswith("byte_bpe_50k.tiktoken")
    for name in ("no_such_file", None, ""):
        with pytest.raises(ValueError):
            tokens.vocabulary_path(name)
