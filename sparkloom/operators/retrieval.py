"""Search of a stated query set against all rows.

Sparse and dense search take queries and rows in blocks; each task keeps the
best rows per query, so only ``k`` rows per query and task are shuffled, never a
pair per match. In sparse search a query's k-th score so far bounds what counts:
terms too common to lift a document above that bound alone are only looked up
for documents that hold a rarer one. Ties are broken by id everywhere.
"""

from __future__ import annotations

from functools import reduce
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions import text as X
from sparkloom.functions import vectors as V
from sparkloom.tables import spread as spread_rows
from sparkloom.tables import stored

#: Queries that go to all tasks as one matrix; more are taken in blocks of so many. Rows that a task holds against them at once.
BLOCK = 8192
SLICE = 4096
#: Queries whose terms go to all tasks at once; scores that a task holds at once; rows and queries whose terms it looks up at once.
TERM_BLOCK = 16384
CELLS = 1 << 21
PAIRS = 1 << 15
#: Bound for tokens of a query; None for all.
QUERY_TOKENS = 40
#: Fixed values of the ranking function.
K1, B = 1.2, 0.75
TITLE_WEIGHT, TEXT_WEIGHT = 2.5, 1.0
RRF_K = 60
HASH_DIMENSIONS = 384


class Best:
    """The k best (score, id) per query so far."""

    def __init__(self, queries: list[int], k: int):
        self.queries, self.k = queries, k
        self.ids = [np.empty(0, np.int64) for _ in queries]
        self.scores = [np.empty(0) for _ in queries]
        self.last = np.full(len(queries), -np.inf)

    def add(self, ids: np.ndarray, scores: np.ndarray, least: float) -> None:
        """``scores``: rows by queries; only those above ``least`` count."""
        hits = (scores > least) & (scores >= self.last)
        for j in np.flatnonzero(hits.any(axis=0)):
            keep = hits[:, j]
            i, v = np.concatenate([self.ids[j], ids[keep]]), np.concatenate([self.scores[j], scores[keep, j]])
            order = np.lexsort((i, -v))[: self.k]
            self.ids[j], self.scores[j] = i[order], v[order]
            if len(order) == self.k:
                self.last[j] = v[order[-1]]

    def add_dots(self, ids: np.ndarray, dots: np.ndarray, norms: np.ndarray, squares: np.ndarray, least: float) -> None:
        """The same for exact ``dots`` in single precision and the squared norms of rows and queries: cosines are taken only where a dot product is near or above what counts."""
        bound = np.sqrt(squares) * np.maximum(least, self.last) * (1 - 1e-5)
        rows, columns = np.nonzero((dots >= np.multiply.outer(np.sqrt(norms).astype(np.float32), bound.astype(np.float32))) & (dots > 0))
        n = norms[rows] * squares[columns]
        scores = dots[rows, columns] / np.sqrt(np.where(n > 0, n, 1))
        good = np.flatnonzero((scores > least) & (scores >= self.last[columns]))
        good = good[np.argsort(columns[good], kind="stable")]
        each, start = np.unique(columns[good], return_index=True)
        for j, own in zip(each, np.split(good, start[1:]), strict=True) if len(each) else ():
            i, v = np.concatenate([self.ids[j], ids[rows[own]]]), np.concatenate([self.scores[j], scores[own]])
            order = np.lexsort((i, -v))[: self.k]
            self.ids[j], self.scores[j] = i[order], v[order]
            if len(order) == self.k:
                self.last[j] = v[order[-1]]

    def rows(self) -> pa.RecordBatch:
        sizes = [len(i) for i in self.ids]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(self.queries, np.int64), sizes)), pa.array(np.concatenate([np.empty(0, np.int64), *self.ids])), pa.array(np.concatenate([np.empty(0), *self.scores]))], names=["query_id", "id", "score"])


FOUND = "query_id long, id long, score double"


def best_of(found: DataFrame, k: int) -> DataFrame:
    """query_id, id, score, rank: the k best of each query."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search_terms(text: str | Column) -> Column:
    """All tokens of a text for sparse search, repeated ones included: words and pairs of Chinese characters."""
    low = F.lower(X.col(text))
    return F.concat(X.matches(low, "[a-z0-9_.@+-]{2,}"), X.han_grams(low, 2))


def query_set(docs: DataFrame, step: int = 100, most: int | None = QUERY_TOKENS) -> DataFrame:
    """query_id, text, tokens: every document whose id is divisible by ``step``, with its first ``most`` distinct tokens (all for None)."""
    chosen = docs.where((F.col("doc_id") % step == 0) & F.col("text").isNotNull())
    tokens = F.array_distinct(search_terms("text"))
    tokens = F.slice(tokens, 1, most) if most else tokens
    return chosen.select(F.col("doc_id").alias("query_id"), "title", "text", tokens.alias("tokens")).where(F.size("tokens") > 0)


def fields_of(docs: DataFrame, fields: dict[str, tuple[Column, float]]) -> DataFrame:
    """id, length and one array of tokens per field of a document."""
    tokens = docs.select(F.col("doc_id").alias("id"), *[t.alias(name) for name, (t, _) in fields.items()])
    length = sum((F.size(name) for name in fields), F.lit(0))
    return stored(tokens.withColumn("length", length))


class Terms:
    """The terms of a block of queries: a vocabulary in order, and per query the places of its terms in it with their factors."""

    def __init__(self, queries: np.ndarray, terms: pa.Array):
        self.names = sorted(pc.unique(terms).to_pylist())
        self.width = len(self.names)
        places = pc.index_in(terms, pa.array(self.names, pa.string())).to_numpy(zero_copy_only=False)
        self.ids, own = np.unique(queries, return_inverse=True)
        order = np.lexsort((places, own))
        self.own, self.places = own[order].astype(np.int32), places[order].astype(np.int32)
        self.first = np.searchsorted(self.own, np.arange(len(self.ids) + 1))

    def weighed(self, factors: np.ndarray) -> Terms:
        """``factors``: by place in the vocabulary, whose names are no longer needed; 0 for terms that no row holds."""
        self.names, self.factors = None, factors[self.places]
        by_factor = np.lexsort((self.places, self.factors, self.own))
        total = np.cumsum(self.factors[by_factor])
        before = np.concatenate([[0.0], total])[self.first[:-1]]
        self.upto = np.empty(len(total))
        self.upto[by_factor] = (total - before[self.own[by_factor]]) * (1 + 1e-9)
        return self

    def leading(self, bound: np.ndarray):
        """The entries of the terms that can bring a row to its query's bound, by place in the vocabulary, the start of each place, and what all others together can add."""
        common = self.upto < bound[self.own]
        rest = np.bincount(self.own, np.where(common, self.factors, 0), minlength=len(self.ids))
        entries = np.flatnonzero(~common)
        entries = entries[np.argsort(self.places[entries], kind="stable")]
        return entries, np.searchsorted(self.places[entries], np.arange(self.width + 1)), rest

    def best(self, batches, k: int, weight):
        """Record batches of the best rows seen. ``weight`` gives the weights, in [0, 1], of the counted terms of a batch."""
        n = len(self.ids)
        most = max(1, CELLS // max(n, self.width))
        held = np.zeros((most, self.width))
        kept = [(np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0))]
        bound, seen, due, size = np.zeros(n), 0, 1, 16
        entries, start, rest = self.leading(bound)
        for batch in batches:
            ids, lists, weights = batch.column("id").to_numpy(zero_copy_only=False), batch.column("at"), weight(batch)
            ends, flat, at = lists.offsets.to_numpy(), lists.values.to_numpy(), 0
            while at < len(ids):
                rows = min(most, size, len(ids) - at)
                part = slice(ends[at], ends[at + rows])
                row, place, w = np.repeat(np.arange(rows), np.diff(ends[at : at + rows + 1])), flat[part], weights[part]
                many = start[place + 1] - start[place]
                pick = entries[np.repeat(start[place] - np.cumsum(many) + many, many) + np.arange(many.sum())]
                scores = np.bincount(np.repeat(row, many) * n + self.own[pick], np.repeat(w, many) * self.factors[pick], minlength=rows * n)
                near = np.flatnonzero(scores.reshape(rows, n) >= np.maximum((bound - rest) * (1 - 1e-9), 1e-300))
                held[row, place] = w
                for i in range(0, len(near), PAIRS):
                    r, q = np.divmod(near[i : i + PAIRS], n)
                    many = self.first[q + 1] - self.first[q]
                    each = np.repeat(self.first[q] - np.cumsum(many) + many, many) + np.arange(many.sum())
                    # the full sum in the order of the terms, so that equal rows get equal scores
                    whole = np.bincount(np.repeat(np.arange(len(q)), many), held[np.repeat(r, many), self.places[each]] * self.factors[each], minlength=len(q))
                    good = (whole > 0) & (whole >= bound[q])
                    kept.append((q[good].astype(np.int32), ids[at + r[good]].astype(np.int64), whole[good]))
                held[row, place] = 0
                at, seen = at + rows, seen + rows
                if seen >= due or sum(len(x[0]) for x in kept[1:]) > max(n * k, PAIRS):
                    kept = [self.first_k(kept, k)]
                    full = np.bincount(kept[0][0], minlength=n) == k
                    last = np.searchsorted(kept[0][0], np.arange(n), side="right") - 1
                    bound[full] = kept[0][2][last[full]]
                if seen >= due:
                    due, size = 2 * seen, 2 * size
                    entries, start, rest = self.leading(bound)
        q, ids, scores = self.first_k(kept, k)
        yield pa.RecordBatch.from_arrays([pa.array(self.ids[q]), pa.array(ids), pa.array(scores)], names=["query_id", "id", "score"])

    @staticmethod
    def first_k(kept, k: int):
        """Of (query, id, score) the k best per query, by query and rank."""
        q, ids, scores = (np.concatenate(x) for x in zip(*kept, strict=True))
        order = np.lexsort((ids, -scores, q))
        q, ids, scores = q[order], ids[order], scores[order]
        best = np.arange(len(q)) - np.searchsorted(q, q) < k
        return q[best], ids[best], scores[best]


def term_counts(terms: DataFrame, weights: dict[str, float], names) -> DataFrame:
    """id, length, at, tf: the weighted counts of those terms of a row that ``names``, a broadcast list, has, by their places in it."""

    def count(batches):
        wanted = pa.array(names.value, pa.string())
        for batch in batches:
            cells, each = [], []
            for name, w in weights.items():
                lists = batch.column(name)
                places = pc.index_in(lists.flatten(), wanted)
                rows = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
                known = places.is_valid().to_numpy(zero_copy_only=False)
                cells.append(rows[known] * len(wanted) + places.drop_null().to_numpy())
                each.append(np.full(len(cells[-1]), w))
            cells, own = np.unique(np.concatenate(cells), return_inverse=True)
            rows, at = np.divmod(cells, max(1, len(wanted)))
            counts = np.bincount(own, np.concatenate(each), minlength=len(cells))
            ends = pa.array(np.searchsorted(rows, np.arange(batch.num_rows + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(at, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(counts, pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(pa.int64()), batch.column("length"), *lists], names=["id", "length", "at", "tf"])

    return terms.mapInArrow(count, "id long, length int, at array<int>, tf array<double>")


def bm25(docs: DataFrame, queries: DataFrame, k: int = 30, fields: dict[str, tuple[Column, float]] | None = None, block: int | None = None) -> DataFrame:
    """query_id, id, score, rank by BM25 with weighted fields, over the statistics of the whole corpus; exact.

    ``fields`` maps names to their tokens and weights; by default title and text.
    Texts and titles that are null have no tokens; documents without a match are
    in no result.

    The terms of TERM_BLOCK queries go to all tasks, which read the rows once for
    them and keep k rows per query. Terms whose factors together stay below the
    k-th score so far cannot bring a row among the best by themselves; so only the
    others are summed for all rows, and these are looked up for the rows that they
    may lift above it. More queries are taken block by block; then no block's
    counted terms are stored but counted twice, else the disk would hold them all.
    """
    fields = fields or {"title": (search_terms(F.coalesce("title", F.lit(""))), TITLE_WEIGHT), "body": (search_terms(F.coalesce("text", F.lit(""))), TEXT_WEIGHT)}
    spark = docs.sparkSession
    terms = fields_of(docs, fields)
    total = terms.agg(F.count("*").alias("n"), F.avg("length").alias("average")).first()
    n, average = total["n"], total["average"] or 1.0
    each = stored(queries.select(F.col("query_id").cast("long").alias("query_id"), F.explode("tokens").alias("term")).distinct())
    blocks = -(-each.select("query_id").distinct().count() // (block or TERM_BLOCK))

    def weight(batch: pa.RecordBatch) -> np.ndarray:
        tf, length = batch.column("tf"), batch.column("length").to_numpy(zero_copy_only=False)
        counts = tf.values.to_numpy()
        return counts / (counts + K1 * (1 - B + B * np.repeat(length, np.diff(tf.offsets.to_numpy())) / average))

    def search(b: int) -> DataFrame:
        asked = each.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toArrow()
        block = Terms(asked["query_id"].to_numpy(), asked["term"].combine_chunks())
        names = spark.sparkContext.broadcast(block.names)
        postings = term_counts(terms, {name: w for name, (_, w) in fields.items()}, names).where(F.size("at") > 0)
        if blocks == 1:
            postings = stored(postings)
            names.unpersist()
        df = np.zeros(len(block.names))
        held = postings.select(F.explode("at").alias("at")).groupBy("at").agg(F.count("*").alias("df")).toArrow()
        df[held["at"].to_numpy()] = held["df"].to_numpy()
        idf = np.log((n - df + 0.5) / (df + 0.5))
        shared = spark.sparkContext.broadcast(block.weighed(np.where(df > 0, np.where(idf > 0, idf, 1e-6) * (K1 + 1), 0.0)))
        return spread_rows(postings.where("id is not null")).mapInArrow(lambda batches: shared.value.best(batches, k, weight), FOUND)

    if blocks > 1:
        return reduce(DataFrame.unionByName, [stored(best_of(search(b), k)) for b in range(blocks)])
    return best_of(search(0) if blocks else spark.createDataFrame([], FOUND), k)


def sizes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The products of two lists of norms, from their squares; 1 where one is 0. Of whole numbers it is the root of an exact product."""
    a, b = np.where(a > 0, a, 1), np.where(b > 0, b, 1)
    if len(a) and len(b) and (a.max() > 1e300 / b.max() or a.min() < 1e-300 / b.min()):
        return np.outer(np.sqrt(a), np.sqrt(b))
    return np.sqrt(np.outer(a, b))


class Asked:
    """Queries as matrices, one per length of vector, with their squared norms and groups."""

    def __init__(self, rows: list[tuple]):
        self.widths = {}
        for width in sorted({len(v) for _, v, _ in rows if v}):
            own = [r for r in rows if len(r[1]) == width]
            matrix = np.nan_to_num(np.array([r[1] for r in own], float).T)
            self.widths[width] = [r[0] for r in own], matrix, (matrix * matrix).sum(axis=0), np.array([r[2] for r in own], object)

    def best(self, batches, k: int, least: float, how: str, kind: pa.DataType):
        """Record batches of query_id, id, score and group of the best rows seen, per query (how "all"), per query and group of the rows ("each") or per query among the rows of its group ("own")."""
        found: dict = {}
        whole_queries = {width: not (matrix % 1).any() for width, (_, matrix, _, _) in self.widths.items()}
        for whole in batches:
            for width, (ids, matrix, squares, groups) in self.widths.items():
                fits = whole.filter(pc.equal(pc.list_value_length(whole.column("vector")), width))
                rows_at_once = min(SLICE, max(1, CELLS // len(ids)))
                for at in range(0, fits.num_rows, rows_at_once):
                    part = fits.slice(at, rows_at_once)
                    x = np.nan_to_num(pa.concat_arrays([part.column("vector")]).flatten().to_numpy(zero_copy_only=False).reshape(-1, width))
                    norms, own = (x * x).sum(axis=1), part.column("id").to_numpy()
                    # no sum of products of whole numbers exceeds the product of the norms
                    single = least >= 0 and norms.max() * squares.max() < 2.0**48 and whole_queries[width] and not (x % 1).any()
                    labels = np.array(part.column("group").to_pylist(), object)
                    for g in [None] if how == "all" else dict.fromkeys(labels.tolist()):
                        rows = slice(None) if how == "all" else np.flatnonzero(labels == g)
                        columns = np.flatnonzero(groups == g) if how == "own" else slice(None)
                        if how == "own" and not len(columns):
                            continue
                        if (width, g) not in found:
                            found[width, g] = Best([ids[j] for j in columns] if how == "own" else ids, k)
                        if single:
                            found[width, g].add_dots(own[rows], x[rows].astype(np.float32) @ matrix[:, columns].astype(np.float32), norms[rows], squares[columns], least)
                            continue
                        found[width, g].add(own[rows], np.maximum(x[rows] @ matrix[:, columns], 0) / sizes(norms[rows], squares[columns]), least)
        for (_, g), b in found.items():
            out = b.rows()
            yield out.append_column("group", pa.array([g] * out.num_rows, kind))


def nearest(vectors: DataFrame, queries: DataFrame, k: int, least: float, how: str, group: str | None = None, block: int | None = None) -> DataFrame:
    """query_id, id, score, group: the best rows seen by each task for each query; a superset of the k best.

    Up to BLOCK queries go to all tasks, and the rows are read once. More are taken
    block by block, each of which reads the rows again, so that neither is shuffled;
    of each block only the k best rows of each query (and group for how "each") are
    stored.
    """
    kind = vectors.schema[group].dataType.simpleString() if group else "string"
    of = lambda df, key: df.select(F.col(key).cast("long").alias(key), "vector", (F.col(group) if group and group in df.columns else F.lit(None)).cast(kind).alias("group")).where("vector is not null")
    rows, asked = of(vectors, "id"), stored(of(queries, "query_id"))
    arrow = rows.select("group").limit(0).toArrow().schema.field(0).type
    blocks = -(-asked.count() // (block or BLOCK))
    order = Window.partitionBy("query_id", *["group"] * (how == "each")).orderBy(F.desc("score"), "id")

    def search(own: DataFrame) -> DataFrame:
        shared = vectors.sparkSession.sparkContext.broadcast([tuple(r) for r in own.orderBy("query_id").collect()])
        return rows.mapInArrow(lambda batches: Asked(shared.value).best(batches, k, least, how, arrow), f"{FOUND}, `group` {kind}")

    if blocks <= 1:
        return search(asked)
    parts = (search(asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)) for b in range(blocks))
    return reduce(DataFrame.unionByName, [stored(p.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).drop("n")) for p in parts])


def dense_per_group(vectors: DataFrame, queries: DataFrame, group: str, k: int) -> DataFrame:
    """query_id, id, score, group value: the k best rows of every group for each query, by cosine above 0.

    ``vectors`` has id, vector and the group column, ``queries`` query_id and
    vector. Each task keeps k rows per query and group it has seen.
    """
    found = nearest(vectors, queries.select("query_id", "vector"), k, 0.0, "each", group)
    order = Window.partitionBy("query_id", "group").orderBy(F.desc("score"), "id")
    return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).drop("n").withColumnRenamed("group", group)


def dense_in_group(vectors: DataFrame, queries: DataFrame, group: str, k: int) -> DataFrame:
    """query_id, id, score, rank, group value: the k best rows of each query's own group, by cosine above 0."""
    found = nearest(vectors, queries, k, 0.0, "own", group)
    return best_of(found, k).withColumnRenamed("group", group)


def dense(vectors: DataFrame, queries: DataFrame, k: int = 30, least: float = 0.0, block: int | None = None) -> DataFrame:
    """query_id, id, score, rank by cosine of ``vector`` (arrays of double of one length), above ``least``.

    Vectors of another length than the query, null and zero vectors match nothing.
    """
    return best_of(nearest(vectors, queries.select("query_id", "vector"), k, least, "all", block=block).drop("group"), k)


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def spread(lists: pa.Array) -> pa.Array:
    """The sums of the signs of words by bucket, as V.hash_buckets has them; each distinct word of a batch is hashed once."""
    n, words = len(lists), lists.flatten().dictionary_encode()
    codes = [sha256(w.encode()).digest() for w in words.dictionary.to_pylist()]
    buckets = np.array([int.from_bytes(c[:4], "big") % HASH_DIMENSIONS for c in codes], np.int64)
    signs = np.array([1.0 - 2 * (c[4] % 2) for c in codes])
    own = words.indices.to_numpy()
    cells = np.repeat(np.arange(n) * HASH_DIMENSIONS, np.diff(lists.offsets.to_numpy())) + buckets[own]
    v = np.bincount(cells, signs[own], minlength=n * HASH_DIMENSIONS)
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * HASH_DIMENSIONS, pa.int32()), pa.array(v, pa.float64()))


def hash_vectors(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, vector: hashed word vectors in whole numbers, whose cosines are equal for equal texts; zero for null and wordless texts."""
    return docs.select(F.col(key).alias("id"), spread(V.hash_words(F.coalesce(text, F.lit("")))).alias("vector"))


def fuse(channels: dict[str, DataFrame], k: int = 30) -> DataFrame:
    """query_id, id, score, rank, ranks: reciprocal rank fusion; ranks maps each channel to the row's rank in it."""
    every = [c.select("query_id", "id", F.lit(name).alias("channel"), F.col("rank").alias("place")) for name, c in channels.items()]
    both = every[0]
    for c in every[1:]:
        both = both.unionByName(c)
    fused = both.groupBy("query_id", "id").agg(F.sum(1 / (F.lit(RRF_K) + F.col("place"))).alias("score"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("channel", "place")))).alias("ranks"))
    return best_of(fused, k)


def fuse_by_hits(channels: dict[str, DataFrame], k: int = 30) -> DataFrame:
    """query_id, id, score, channels, rank: reciprocal rank fusion with the sorted names of the channels that found the row; ties go to more channels, then by id."""
    every = [c.select("query_id", "id", F.lit(name).alias("channel"), F.col("rank").alias("place")) for name, c in channels.items()]
    both = every[0]
    for c in every[1:]:
        both = both.unionByName(c)
    fused = both.groupBy("query_id", "id").agg(F.sum(1 / (F.lit(RRF_K) + F.col("place"))).alias("score"), F.array_sort(F.collect_set("channel")).alias("channels"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), F.desc(F.size("channels")), "id")
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rerank(found: DataFrame, queries: DataFrame, docs: DataFrame, k: int = 12) -> DataFrame:
    """query_id, id, score, rank: candidates by the share of query tokens in text and title and by the whole phrase; ties by the former score."""
    seen = docs.join(found.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    texts = seen.select(F.col("doc_id").alias("id"), F.lower(F.concat_ws("\n", "title", "text")).alias("body"), X.rerank_tokens(F.coalesce("title", F.lit(""))).alias("names"))
    wanted = queries.select("query_id", X.rerank_tokens("text").alias("wanted"), F.array_join(X.matches(F.lower("text"), "[a-z0-9_.+-]+"), " ").alias("phrase"))
    both = found.join(texts, "id").join(wanted, "query_id")
    n = F.greatest(F.size("wanted"), F.lit(1))
    found_in = lambda padded: F.size(F.filter("wanted", lambda t: X.word_bounded(F.col("body"), t, padded)))
    coverage = X.let(X.padded_words("body"), found_in) / n
    names = F.size(F.array_intersect("names", "wanted")) / n
    phrase = F.when((F.length("phrase") >= 6) & F.contains("body", F.col("phrase")), 0.12).otherwise(0.0)
    scored = both.select("query_id", "id", F.col("score").alias("before"), F.least(F.lit(1.0), 0.72 * coverage + 0.16 * names + phrase).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("before"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("before")


def marginal(score: np.ndarray, alike: np.ndarray, k: int, weight: float, first: list[int] = ()) -> list[int]:
    """Up to k places by maximal marginal relevance, after those of ``first``: the best of weight * score - (1 - weight) * highest likeness to the chosen; ties by place."""
    near, left, taken = np.zeros(len(score)), list(range(len(score))), []
    while left and len(taken) < k:
        gain = weight * score[left] - (1 - weight) * near[left]
        i = first[len(taken)] if len(taken) < len(first) else left[int(gain.argmax())]
        left.remove(i)
        taken.append(i)
        near = np.maximum(near, alike[i])
    return taken


def diversify(found: DataFrame, vectors: DataFrame, k: int = 5, weight: float = 0.72) -> DataFrame:
    """query_id, id, score, rank: maximal marginal relevance among the candidates of each query, by cosine.

    A candidate list is bounded by the k of the search before, so a query is one
    small group. Candidates without a vector are left out.
    """
    both = found.select("query_id", "id", "score", "rank").join(vectors.select("id", "vector"), "id")

    def choose(table: pa.Table) -> pa.Table:
        table = table.sort_by("rank")
        x = np.array(table["vector"].to_pylist(), float)
        squares = (x * x).sum(axis=1)
        taken = marginal(table["score"].to_numpy(), np.maximum(x @ x.T, 0) / sizes(squares, squares), k, weight)
        out = table.take(taken).select(["query_id", "id", "score"])
        return out.append_column("rank", pa.array(range(1, len(taken) + 1), pa.int32()))

    return both.groupBy("query_id").applyInArrow(choose, "query_id long, id long, score double, rank int")


def cover(found: DataFrame, vectors: DataFrame, k: int = 5, weight: float = 0.72) -> DataFrame:
    """query_id, id, score, rank: results that meet every claim, then maximal marginal relevance.

    ``found`` is a bounded list per query with query_id, id, score, rank and
    claims, the numbers of the claims (a document that has to be cited, a part of
    the question) that a candidate meets; null meets none. In the order of their
    numbers, each claim takes the best candidate left that meets it; the places
    that remain go by relevance, as a share of the query's best score, and
    likeness. Claims that nobody meets take no place.
    """
    both = found.select("query_id", "id", "score", "rank", "claims").join(vectors.select("id", "vector"), "id")

    def choose(table: pa.Table) -> pa.Table:
        table = table.sort_by("rank")
        claims = [set(c or ()) for c in table["claims"].to_pylist()]
        first: list[int] = []
        for c in sorted(set().union(*claims)):
            first += [i for i, own in enumerate(claims) if c in own and i not in first][:1]
        x = np.array(table["vector"].to_pylist(), float)
        size = np.linalg.norm(x, axis=1)
        x = x / np.where(size > 0, size, 1)[:, None]
        score = table["score"].to_numpy()
        taken = marginal(score / (score.max() or 1.0), np.maximum(x @ x.T, 0), k, weight, first)
        out = table.take(taken).select(["query_id", "id", "score"])
        return out.append_column("rank", pa.array(range(1, len(taken) + 1), pa.int32()))

    return both.groupBy("query_id").applyInArrow(choose, "query_id long, id long, score double, rank int")


def first_of_required(found: DataFrame, required: DataFrame, group: str, k: int) -> DataFrame:
    """query_id, id, group value, rank: the best result of each required group first, by group, then the others by rank; k in all.

    ``found`` is a bounded list per query, ``required`` has query_id and the group column.
    """
    best = Window.partitionBy("query_id", group).orderBy("rank")
    rows = found.join(required.select("query_id", group, F.lit(True).alias("required")).distinct(), ["query_id", group], "left")
    ahead = (F.row_number().over(best) == 1) & F.coalesce("required", F.lit(False))
    order = Window.partitionBy("query_id").orderBy(F.desc("ahead"), F.when(F.col("ahead"), F.col(group)), "rank")
    return rows.withColumn("ahead", ahead).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("query_id", "id", group, F.col("place").alias("rank"))


@F.pandas_udf(T.DoubleType())
def mean_of_best(left: pd.Series, right: pd.Series) -> pd.Series:
    """Mean over the tokens of the left of the highest cosine with a token of the right; a token is a list of twice the bucket, plus 1 where the sign is negative, and a zero vector if empty."""

    def matrix(tokens) -> np.ndarray:
        m = np.zeros((len(tokens), HASH_DIMENSIONS))
        for i, t in enumerate(tokens):
            for code in t:
                m[i, code >> 1] += -1 if code & 1 else 1
        n = np.linalg.norm(m, axis=1)
        return m / np.where(n > 0, n, 1)[:, None]

    out = []
    for a, b in zip(left, right, strict=True):
        best = np.full(len(a), -1.0)
        x = matrix(a)
        for i in range(0, len(b), 2048):
            best = np.maximum(best, (x @ matrix(b[i : i + 2048]).T).max(axis=1))
        out.append(float(best.mean()) if len(a) and len(b) else 0.0)
    return pd.Series(out)


def late_interaction(found: DataFrame, queries: DataFrame, docs: DataFrame, k: int, query_tokens: int | None = None, doc_tokens: int | None = None) -> DataFrame:
    """query_id, id, score, rank: candidates by the mean, over the query's tokens, of the highest cosine with a token of title and text; 0 without tokens.

    Tokens have hashed word vectors. All distinct tokens count, unless a limit is
    given for those of queries or documents. ``found`` is read twice, so it is stored.
    """
    found = stored(found.select("query_id", "id"))
    first = lambda c, n: F.slice(c, 1, n) if n else c
    code = lambda b: 2 * b["bucket"] + F.when(b["sign"] < 0, 1).otherwise(0)
    hashed = lambda c, n: F.transform(first(X.rerank_tokens(c), n), lambda t: F.transform(V.hash_buckets(t, HASH_DIMENSIONS), code))
    seen = docs.join(found.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    theirs = seen.select(F.col("doc_id").alias("id"), hashed(F.concat_ws("\n", "title", "text"), doc_tokens).alias("theirs"))
    asked = queries.select("query_id", hashed(F.coalesce("text", F.lit("")), query_tokens).alias("asked"))
    both = found.join(theirs, "id").join(asked, "query_id")
    return best_of(both.select("query_id", "id", F.greatest(F.lit(0.0), mean_of_best("asked", "theirs")).alias("score")), k)


def redundancy(found: DataFrame, vectors: DataFrame) -> DataFrame:
    """query_id, redundancy: mean positive cosine over the pairs of a query's results (bounded lists), 0 for a single one."""
    rows = found.select("query_id", "id", "rank").join(vectors, "id")
    a, b = rows.alias("a"), rows.alias("b")
    pairs = a.join(b, (F.col("a.query_id") == F.col("b.query_id")) & (F.col("a.rank") < F.col("b.rank")), "left")
    near = F.when(F.col("b.id").isNotNull(), F.greatest(V.cosine(F.col("a.vector"), F.col("b.vector")), F.lit(0.0)))
    return pairs.groupBy(F.col("a.query_id").alias("query_id")).agg(F.coalesce(F.avg(near), F.lit(0.0)).alias("redundancy"))


def rank_metrics(found: DataFrame, golds: DataFrame, k: int) -> DataFrame:
    """query_id, precision, recall, mrr, ndcg at k.

    ``found`` has query_id, id, rank and hit (whether the row is relevant),
    ``golds`` query_id and gold, the number of relevant rows. Queries without
    results score 0.
    """
    per = found.where(F.col("rank") <= k).withColumn("hit", F.coalesce(F.col("hit").cast("int"), F.lit(0)))
    per = per.groupBy("query_id").agg(
        F.sum("hit").alias("hits"), F.count("*").alias("shown"),
        F.sum(F.col("hit") / F.log2(F.col("rank") + 1)).alias("dcg"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"),
    )
    both = golds.join(per, "query_id", "left")
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least("gold", F.coalesce("shown", F.lit(1))), F.lit(1)).cast("int")), F.lit(0.0), lambda acc, i: acc + 1 / F.log2(i + 1.0))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return both.select("query_id", zero(F.col("hits") / F.col("shown")).alias("precision"), zero(F.col("hits") / F.col("gold")).alias("recall"), zero(1 / F.col("first")).alias("mrr"), zero(F.col("dcg") / ideal).alias("ndcg"))
