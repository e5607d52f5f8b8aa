"""Long-term memory items: state, time to live, superseding, search."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import text as X
from sparkloom.operators.retrieval import best_of, marginal
from sparkloom.tables import stored

#: Half-lives in days, tags that end an item, weights of the search score.
HALF_LIFE = {"task": 14, "artifact": 30, "fact": 120, "decision": 180, "preference": 365}
OTHER_HALF_LIFE = 90
ENDED = ["completed", "cancelled", "obsolete", "expired"]
TYPE_BONUS = {"preference": 0.05, "decision": 0.05}
#: Shared terms, as a share of the shorter list, that make two items one topic; weight of relevance against likeness.
SAME_TOPIC, MMR_WEIGHT = 0.65, 0.7
#: Classes of memories in a slice, two of which a task compares.
SLICE = 16384
#: Tasks at most in which slices meet; a task may hold several pairs of slices, one after the other.
TASKS = 10000


def half_life() -> Column:
    out = F.lit(OTHER_HALF_LIFE)
    for kind, days in HALF_LIFE.items():
        out = F.when(F.col("memory_type") == kind, days).otherwise(out)
    return out


def tags() -> Column:
    return F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.lower(F.trim(t)))


def ttl_days() -> Column:
    """Days to live by type and scope; null for items that stay."""
    stays = F.col("memory_type").isin("preference", "decision") | F.arrays_overlap(tags(), F.array(F.lit("completed"), F.lit("permanent")))
    short = F.col("scope") == "session"
    return F.when(F.coalesce(stays, F.lit(False)), None).when(F.col("memory_type") == "task", F.when(short, 30).otherwise(90)).when(F.col("memory_type") == "artifact", 90).when(F.col("memory_type") == "fact", F.when(short, 120).otherwise(365))


def state(memories: DataFrame) -> DataFrame:
    """Adds inactive, recency and plain_status; the time is that of the last update in the table, so results repeat."""
    now = memories.agg(F.max("updated_at").alias("now"))
    rows = memories.crossJoin(F.broadcast(now))
    ended = F.coalesce(F.arrays_overlap(tags(), F.array(*map(F.lit, ENDED))), F.lit(False)) | F.coalesce(F.col("expires_at") <= F.col("now"), F.lit(False))
    age = F.greatest(F.lit(0), F.unix_micros(F.col("now").cast("timestamp")) - F.unix_micros(F.col("updated_at").cast("timestamp"))) / 86400000000.0
    status = F.when(F.col("status").isin("deleted", "superseded", "archived", "pending"), F.col("status")).when((F.col("memory_type") == "preference") & (F.col("confidence") < 0.82), "pending").when(F.col("confidence") < 0.6, "pending").otherwise("active")
    return rows.withColumn("inactive", ended).withColumn("recency", F.exp(-F.log(F.lit(2.0)) * age / half_life())).withColumn("plain_status", status).drop("now")


def superseded(memories: DataFrame) -> DataFrame:
    """memory_id, superseded_by, topic: active decisions and preferences that a newer one of the same type and topic replaces."""
    rows = memories.where("status = 'active' and memory_type in ('decision', 'preference')").dropDuplicates(["memory_id"])
    topics = rows.select("memory_id", "memory_type", "updated_at", F.explode(F.filter("tags", lambda t: t.startswith("topic:"))).alias("topic"))
    newest = topics.groupBy("memory_type", "topic").agg(F.max_by("memory_id", F.struct("updated_at", "memory_id")).alias("superseded_by"))
    return topics.join(newest, ["memory_type", "topic"]).where("memory_id <> superseded_by").select("memory_id", "superseded_by", "topic").distinct()


def conflicts(memories: DataFrame) -> DataFrame:
    """memory_id, superseded_by: of every active decision and preference the newest one of its type and topic, if that came later, else null.

    Two items with topic tags are of one topic if they share one. Otherwise they
    are if at least SAME_TOPIC of the terms of the shorter stand in the other.
    Items without terms then have no topic. Of two that came at once, the
    greater id is the later; a null time is the earliest.

    No pairs of items are made: classes of equal terms meet, and each keeps its
    newest. The shorter list needs all but the last SAME_TOPIC of its terms, in
    the order of rarity, to meet every class that it can match.
    """
    active = memories.where("status = 'active' and memory_type in ('decision', 'preference') and memory_id is not null")
    one = active.groupBy("memory_id").agg(F.max_by(F.struct("memory_type", "content", "tags", "created_at"), F.struct("updated_at", "content")).alias("m")).select("memory_id", "m.*")
    when = F.struct(F.col("created_at").alias("at"), F.col("memory_id").alias("id"))
    topics = F.array_distinct(F.filter(F.coalesce("tags", F.array().cast("array<string>")), lambda t: t.startswith("topic:")))
    rows = one.select("memory_id", F.col("memory_type").alias("kind"), when.alias("when"), topics.alias("topics"), F.array_sort(X.topic_terms(F.coalesce("content", F.lit("")))).alias("terms"))
    rows = stored(rows.withColumn("tagged", F.size("topics") > 0))
    tags_ = rows.select("memory_id", "kind", "when", F.explode("topics").alias("topic"))
    by_tag = tags_.join(tags_.groupBy("kind", "topic").agg(F.max("when").alias("newest")), ["kind", "topic"]).groupBy("memory_id").agg(F.max("newest").alias("by_tag"))

    classes = stored(rows.where(F.size("terms") > 0).groupBy("kind", "tagged", "terms").agg(F.min("memory_id").alias("class_id"), F.max("when").alias("newest")))
    each = classes.select("kind", "class_id", F.explode("terms").alias("term"))
    ranked = each.join(each.groupBy("kind", "term").agg(F.count("*").alias("df")), ["kind", "term"]).groupBy("kind", "class_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "term"))), lambda x: x["term"]).alias("ranked"))
    n = F.size("ranked")
    prefix = F.slice("ranked", F.lit(1), n - F.ceil(n * SAME_TOPIC - 1e-9).cast("int") + 1)
    short = ranked.select("kind", F.col("class_id").alias("a"), F.explode(prefix).alias("term"))
    met = short.join(each.withColumnRenamed("class_id", "b"), ["kind", "term"]).where("a <> b").select("a", "b").distinct()
    side = lambda x: classes.select(F.col("class_id").alias(x), F.col("terms").alias(f"terms_{x}"), F.col("tagged").alias(f"tagged_{x}"), F.col("newest").alias(f"newest_{x}"))
    pairs = met.join(side("a"), "a").join(side("b"), "b").where("not (tagged_a and tagged_b) and size(terms_a) <= size(terms_b)")
    pairs = stored(pairs.where(F.size(F.array_intersect("terms_a", "terms_b")) / F.size("terms_a") >= SAME_TOPIC).select("a", "b", "newest_a", "newest_b"))
    near = pairs.select(F.col("a").alias("class_id"), F.col("newest_b").alias("w")).unionByName(pairs.select(F.col("b").alias("class_id"), F.col("newest_a").alias("w")))
    # a class of tagged items is one topic by their tags only
    own = classes.join(near.groupBy("class_id").agg(F.max("w").alias("w")), "class_id", "left")
    own = own.select("kind", "tagged", "terms", F.greatest("w", F.when(~F.col("tagged"), F.col("newest"))).alias("by_terms"))
    out = rows.join(by_tag, "memory_id", "left").join(own, ["kind", "tagged", "terms"], "left")
    last = F.greatest("by_tag", "by_terms")
    return out.select("memory_id", F.when(last > F.col("when"), last["id"]).alias("superseded_by"))


def related(memories: DataFrame, least: int = 3) -> DataFrame:
    """memory_id, class_id, links: of every active memory the class of those with the same words and type, named by its least id, and how many other memories of its type share ``least`` words or more with it.

    Classes meet, not their copies, in slices of SLICE by hash, every two of a type
    once. A task counts the shared words of one class with a whole slice by the
    lists of those that hold each word, so no pair leaves it; what is shuffled are
    the slices and a number per class and pair of slices. Memories with less words
    have no links; those without content are left out.
    """
    active = memories.where("content is not null and status = 'active' and memory_id is not null")
    one = active.groupBy("memory_id").agg(F.max_by(F.struct("memory_type", "content"), F.struct("updated_at", "content")).alias("m")).select("memory_id", "m.*")
    worded = stored(one.select("memory_id", F.coalesce("memory_type", F.lit("")).alias("kind"), F.array_sort(F.array_distinct(X.matches(F.lower("content"), "[a-z][a-z0-9_.+-]{2,}"))).alias("words")))
    classes = stored(worded.groupBy("kind", "words").agg(F.min("memory_id").alias("class_id"), F.count("*").alias("copies")))
    ready = classes.where(F.size("words") >= least)
    slices = ready.groupBy("kind").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices"))
    ready = ready.join(slices, "kind").withColumn("own", F.pmod(F.xxhash64("class_id"), "slices").cast("int"))
    pairs = ready.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    meet = pairs.select("kind", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), (F.col("own") > F.col("other")).alias("right"), "class_id", "copies", "words")
    # small data and long work: a task for each two slices, not one for so many bytes
    groups = slices.agg(F.coalesce(F.sum(F.col("slices") * (F.col("slices") + 1) / 2), F.lit(0)).cast("long")).first()[0]
    meet = meet.repartition(max(1, min(groups, TASKS)), "kind", "a", "b")
    links = meet.groupBy("kind", "a", "b").applyInArrow(lambda t: sharing(t, least), "kind string, class_id string, others long").groupBy("kind", "class_id").agg(F.sum("others").alias("others"))
    own = F.when(F.size("words") >= least, F.col("copies") - 1).otherwise(0)
    counts = classes.join(links, ["kind", "class_id"], "left").select("kind", "words", "class_id", (own + F.coalesce("others", F.lit(0))).alias("links"))
    return worded.join(counts, ["kind", "words"]).select("memory_id", "class_id", "links")


def sharing(table: pa.Table, least: int) -> pa.Table:
    """kind, class_id, others: the copies of the other slice's classes that share ``least`` words or more with each; of the same slice if there is no other.

    Counted per class of the left: a word's classes on the right are a stretch of one list.
    """
    table = table.combine_chunks()
    right, copies = table["right"].to_numpy(zero_copy_only=False), table["copies"].to_numpy()
    lists = table["words"].combine_chunks()
    codes = lists.flatten().dictionary_encode()
    width, codes, many = len(codes.dictionary), codes.indices.to_numpy(), np.diff(lists.offsets.to_numpy())
    row = np.repeat(np.arange(len(right)), many)
    alone = table["a"][0] == table["b"][0]
    left, side = np.flatnonzero(~right), np.flatnonzero(~right if alone else right)
    place = np.zeros(len(right), np.int64)
    place[side] = np.arange(len(side))
    there = np.ones(len(row), bool) if alone else right[row]
    order = np.flatnonzero(there)[np.argsort(codes[there], kind="stable")]
    holders, first = place[row[order]], np.searchsorted(codes[order], np.arange(width + 1))
    starts, others, weights = np.concatenate([[0], np.cumsum(many)]), np.zeros(len(right), np.int64), copies[side]
    back = np.zeros(len(side), np.int64)
    for i in left:
        found = [holders[first[c] : first[c + 1]] for c in codes[starts[i] : starts[i + 1]]]
        hit = np.flatnonzero(np.bincount(np.concatenate(found), minlength=len(side)) >= least)
        others[i] += weights[hit].sum()
        back[hit] += copies[i]
    if alone:  # each class has met itself
        others -= copies
    else:
        others[side] += back
    return pa.table({"kind": table["kind"], "class_id": table["class_id"], "others": pa.array(others)})


def search(queries: DataFrame, text: str, memories: DataFrame, k: int = 5) -> DataFrame:
    """query_id, id (memory_id), score, rank: active memories by the share of the query's terms that they hold, then recency and confidence.

    Terms meet in an equi-join, and shared terms are counted per pair.
    """
    rows = state(memories.where("content is not null").dropDuplicates(["memory_id"])).where("not inactive and plain_status = 'active'")
    mine = rows.select("memory_id", "recency", "confidence", "memory_type", X.topic_terms("content").alias("terms"))
    wanted = queries.select("query_id", X.topic_terms(text).alias("wanted")).where(F.size("wanted") > 0)
    each = wanted.select("query_id", F.size("wanted").alias("n"), F.explode("wanted").alias("term"))
    hits = mine.select("memory_id", "recency", "confidence", "memory_type", F.explode("terms").alias("term")).join(each, "term")
    bonus = F.lit(0.0)
    for kind, value in TYPE_BONUS.items():
        bonus = F.when(F.col("memory_type") == kind, value).otherwise(bonus)
    scored = hits.groupBy("query_id", "memory_id", "n", "recency", "confidence", "memory_type").agg(F.count("*").alias("same")).withColumn("share", F.col("same") / F.col("n"))
    score = 0.75 * F.col("share") + (0.15 * F.col("recency") + 0.1 * F.coalesce("confidence", F.lit(0.0)) + bonus) * F.least(F.lit(1.0), 4 * F.col("share"))
    return best_of(scored.select("query_id", F.col("memory_id").alias("id"), score.alias("score")).where("score > 0.08"), k)


def diverse(found: DataFrame, memories: DataFrame, k: int = 5, weight: float = MMR_WEIGHT) -> DataFrame:
    """query_id, id, score, rank: of each query's candidates (a bounded list) those of high score and little likeness to the chosen.

    Likeness is the share of words and Chinese pairs that two items have in common.
    """
    terms = F.array_distinct(X.matches(F.lower(F.coalesce("content", F.lit(""))), f"[a-z0-9_]+|[{X.HAN}]{{2}}"))
    worded = memories.dropDuplicates(["memory_id"]).select(F.col("memory_id").alias("id"), terms.alias("terms"))

    def choose(table: pa.Table) -> pa.Table:
        table = table.sort_by("rank")
        own = [set(t) for t in table["terms"].to_pylist()]
        alike = np.array([[len(a & b) / max(1, len(a | b)) for b in own] for a in own])
        taken = marginal(table["score"].to_numpy(), alike, k, weight)
        out = table.take(taken).select(["query_id", "id", "score"])
        return out.append_column("rank", pa.array(range(1, len(taken) + 1), pa.int32()))

    both = found.select("query_id", "id", "score", "rank").join(worded, "id")
    return both.groupBy("query_id").applyInArrow(choose, "query_id long, id string, score double, rank int")
