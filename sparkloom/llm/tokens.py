"""Encoding of the corpus through a table of its distinct words.

The text is split into words by the tokenizer's own pattern in the JVM. Each
distinct word is encoded once, in Spark; ids come back to their documents by
position. Words that make up at least ``1 / HOT_WORDS`` of all words (so no more
than ``HOT_WORDS`` of them, whatever the corpus) go to the tasks as a bounded
lookup; all others come back through a shuffled join on the word, where, by the
same bound, no key is hot.
"""

from __future__ import annotations

import base64
import functools
import os

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.tables import stored

#: At most so many words are looked up without a shuffle, each of at most HOT_CHARS code points.
HOT_WORDS = 1 << 16
HOT_CHARS = 64

#: Fixed value: the published split pattern of the byte-level vocabularies.
SPLIT = r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def tokenizer_dir() -> str:
    return os.environ.get("SPARKLOOM_TOKENIZERS", "/opt/tokenizers")


@functools.cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@functools.cache
def byte_encoder(path: str):
    """The byte-level encoder of a rank file; one per Python worker."""
    import tiktoken

    return tiktoken.Encoding("byte_bpe", pat_str=SPLIT, mergeable_ranks=ranks(path), special_tokens={})


def words_of(text: str | F.Column) -> F.Column:
    """The words of a text, in order; joined they give the text again. Null gives an empty list."""
    col = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_extract_all(col, F.lit("(?U)" + SPLIT), F.lit(0)), F.array().cast("array<string>"))


def distinct_words(docs: DataFrame, text: str) -> DataFrame:
    """word, n: every distinct word of the corpus with its count, counted per batch before the shuffle."""

    def count(batches):
        for batch in batches:
            counted = batch.column(0).flatten().value_counts()
            yield pa.RecordBatch.from_arrays([counted.field("values"), counted.field("counts")], names=["word", "n"])

    split = docs.where(F.length(text) > 0).select(words_of(text).alias("words"))
    return split.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary_path(name: str | None) -> str:
    """The vocabulary file of a byte-level tokenizer; an error for one that is not there."""
    path = f"{tokenizer_dir()}/{name}.tiktoken"
    if not name or not os.path.exists(path):
        raise ValueError(f"no vocabulary file for the tokenizer {name!r}: {path}")
    return path


def encode_words(words: DataFrame, path: str) -> DataFrame:
    """Adds ids to a table of distinct words: each is encoded exactly once."""

    def encode(batches):
        encoder = byte_encoder(path)
        for batch in batches:
            ids = [encoder.encode_ordinary(w) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], names=["word", "n", "ids"])

    return words.mapInArrow(encode, "word string, n long, ids array<int>")


class Vocabulary:
    """The encoded word table of a corpus: ``table`` (word, n, ids) and its bounded hot part."""

    def __init__(self, docs: DataFrame, text: str, path: str, hot_words: int = HOT_WORDS):
        self.table = stored(encode_words(distinct_words(docs, text), path))
        total = self.table.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
        self.is_hot = (F.col("n") * hot_words >= F.lit(total)) & (F.length("word") <= HOT_CHARS)
        hot = self.table.where(self.is_hot).select("word", "ids").toArrow().combine_chunks()
        self.hot = docs.sparkSession.sparkContext.broadcast(
            (hot.column("word").combine_chunks().cast(pa.string()), hot.column("ids").combine_chunks().cast(pa.list_(pa.int32())))
        )
        self.cold = self.table.where(~self.is_hot)


def _slots(docs: DataFrame, text: str, key: str, vocabulary: Vocabulary) -> DataFrame:
    """Per document: slots (place of each word in the hot table, -1 if it is not there) and the other words."""
    hot = vocabulary.hot

    def look_up(batches):
        known = hot.value[0]
        for batch in batches:
            words = pa.concat_arrays([batch.column(2)])
            flat = words.flatten()
            place = pc.fill_null(pc.index_in(flat, value_set=known), -1).cast(pa.int32())
            miss = pc.equal(place, -1)
            offsets = pc.subtract(words.offsets, words.offsets[0])
            upto = _running(miss.cast(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.ListArray.from_arrays(offsets, place), pa.ListArray.from_arrays(upto.take(offsets), flat.filter(miss))],
                names=["row", "key", "slots", "missed"],
            )

    split = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), words_of(text).alias("words"))
    kind = split.schema["key"].dataType.simpleString()
    return split.mapInArrow(look_up, f"row long, key {kind}, slots array<int>, missed array<string>")


def _running(counts: pa.Array) -> pa.Array:
    """0 and the running sums of ``counts``, as list offsets."""
    start = pa.array([0], pa.int32())
    return pa.concat_arrays([start, pc.cumulative_sum(counts).cast(pa.int32())]) if len(counts) else start


def encode_corpus(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None, hot_words: int = HOT_WORDS) -> DataFrame:
    """``key``, ids: the token ids of every text, without special tokens.

    A null and an empty text give an empty list. Strings of special tokens are
    ordinary text. Every input row gives one output row, repeated and null keys
    included; other columns are ignored, whatever their names.
    """
    path = path or f"{tokenizer_dir()}/byte_bpe_50k.tiktoken"
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    vocabulary = Vocabulary(docs, "text", path, hot_words)
    rows = stored(_slots(docs, "text", "key", vocabulary))
    hot = vocabulary.hot
    missed = rows.where(F.size("missed") > 0).select("row", F.posexplode("missed").alias("pos", "word"))
    found = missed.join(vocabulary.cold.select("word", "ids"), "word")
    rest = found.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", "ids"))).alias("rest"))

    def fill(batches):
        hot_ids = hot.value[1]
        for batch in batches:
            slots, rest = pa.concat_arrays([batch.column(1)]), batch.column(2).flatten()
            flat = slots.flatten()
            # ids of the hot table, then those of this batch's other words, in their order
            every = pa.concat_arrays([hot_ids, pa.concat_arrays([rest]).cast(hot_ids.type)])
            miss = pc.equal(flat, -1)
            nth = pc.add(_running(miss.cast(pa.int32()))[1:], len(hot_ids) - 1)
            taken = every.take(pc.if_else(miss, nth, flat))
            offsets = _running(pc.list_value_length(taken)).take(pc.subtract(slots.offsets, slots.offsets[0]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, taken.flatten())], names=["key", "ids"])

    whole = rows.select("row", "key", "slots").join(rest.select("row", F.col("rest.ids").alias("rest")), "row", "left")
    kind = rows.schema["key"].dataType.simpleString()
    return whole.select("key", "slots", "rest").mapInArrow(fill, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def count_tokens(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None, hot_words: int = HOT_WORDS) -> DataFrame:
    """``key``, n_tokens (long): the size of every text in tokens; 0 for a null or empty text. One row per input row."""
    path = path or f"{tokenizer_dir()}/byte_bpe_50k.tiktoken"
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    vocabulary = Vocabulary(docs, "text", path, hot_words)
    hot = vocabulary.hot

    def sizes(batches):
        known, ids = hot.value
        each = pc.list_value_length(ids).cast(pa.int64())
        for batch in batches:
            words = pa.concat_arrays([batch.column(2)])
            flat = words.flatten()
            place = pc.index_in(flat, value_set=known)
            miss = pc.is_null(place)
            offsets = pc.subtract(words.offsets, words.offsets[0])
            upto = pa.concat_arrays([pa.array([0], pa.int64()), pc.cumulative_sum(pc.fill_null(each.take(place), 0))]) if len(flat) else pa.array([0], pa.int64())
            ends = upto.take(offsets)
            missed = pa.ListArray.from_arrays(_running(miss.cast(pa.int32())).take(offsets), flat.filter(miss))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pc.subtract(ends[1:], ends[:-1]), missed], names=["row", "key", "known", "missed"])

    split = docs.select(F.monotonically_increasing_id().alias("row"), "key", words_of("text").alias("words"))
    kind = split.schema["key"].dataType.simpleString()
    rows = stored(split.mapInArrow(sizes, f"row long, key {kind}, known long, missed array<string>"))
    missed = rows.select("row", F.explode("missed").alias("word")).groupBy("row", "word").agg(F.count("*").alias("times"))
    lengths = vocabulary.cold.select("word", F.size("ids").alias("size"))
    rest = missed.join(lengths, "word").groupBy("row").agg(F.sum(F.col("times") * F.col("size")).alias("rest"))
    whole = rows.select("row", "key", "known").join(rest, "row", "left")
    return whole.select(F.col("key").alias(key), (F.col("known") + F.coalesce("rest", F.lit(0))).alias("n_tokens"))


def piece_table(docs: DataFrame, path: str | None = None) -> DataFrame:
    """id, piece (binary): the vocabulary as a table; its size is that of the vocabulary file."""
    path = path or f"{tokenizer_dir()}/byte_bpe_50k.tiktoken"
    rows = [(i, bytearray(b)) for b, i in ranks(path).items()]
    return docs.sparkSession.createDataFrame(rows, "id int, piece binary")


def decode_corpus(encoded: DataFrame, key: str = "doc_id", path: str | None = None) -> DataFrame:
    """``key``, text: the texts of id lists, by a join of every id with its piece. An empty or null list gives an empty text.

    One row per distinct key; the vocabulary is of fixed size and broadcast.
    """
    pieces = piece_table(encoded, path).select("id", F.hex("piece").alias("piece"))
    flat = encoded.select(F.col(key).alias("key"), F.posexplode_outer("ids").alias("pos", "id"))
    joined = flat.join(F.broadcast(pieces), "id", "left")
    per_doc = joined.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "piece"))).alias("parts"))
    text = F.decode(F.unhex(F.concat_ws("", F.col("parts.piece"))), "UTF-8")
    return per_doc.select(F.col("key").alias(key), F.coalesce(text, F.lit("")).alias("text"))
