"""Operators on tables of events, messages and measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import text as X
from sparkloom.operators.ordered import range_sorted


def first_copies(df: DataFrame, key: str, arrived: str) -> DataFrame:
    """One row per key, the copy that arrived first (nulls last); rows without a key are kept as they are."""
    rest = [c for c in df.columns if c != key]
    order = F.coalesce(F.col(arrived), F.lit("9999-12-31").cast(df.schema[arrived].dataType))
    one = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("x")).select(key, "x.*")
    return one.unionByName(df.where(F.col(key).isNull()))


def message_records(messages: DataFrame) -> DataFrame:
    """session, message_id, created_at, content of every message with a session and a time, once per id."""
    rows = messages.where("message_id is not null and session_id is not null and created_at is not null")
    order = F.struct("ingested_at", F.coalesce("role", F.lit("")), "session_id")
    one = rows.groupBy("message_id").agg(F.min_by(F.struct("session_id", "created_at", "content"), order).alias("x"))
    return one.select(F.lower(F.trim("x.session_id")).alias("session"), "message_id", "x.created_at", "x.content")


def percentiles(df: DataFrame, group: str, value: str) -> DataFrame:
    """Median and 95th percentile by three definitions: linear between ranks, nearest rank, rounded rank.

    Exact: equal values are counted first, then places are summed up over the
    distinct values of a group. Null values must be left out before.
    """
    cells = df.groupBy(group, value).agg(F.count("*").alias("cell"))
    over = Window.partitionBy(group)
    upto = F.sum("cell").over(over.orderBy(value))
    rows = cells.withColumn("upto", upto).withColumn("n", F.sum("cell").over(over))

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("upto") >= place) & (F.col("upto") - F.col("cell") < place), F.col(value)))

    def linear(p: float) -> tuple[Column, Column, Column]:
        exact = (F.col("n") - 1) * p
        low = F.floor(exact)
        return at(low + 1), at(F.least(low + 2, F.col("n"))), F.max(exact - low)

    a, b, c = linear(0.5)
    d, e, f = linear(0.95)
    out = rows.groupBy(group).agg(
        a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d"), e.alias("e"), f.alias("f"),
        at(F.greatest(F.lit(1), F.ceil(F.lit(0.95) * F.col("n")))).alias("nearest_p95"), at(F.floor((F.col("n") - 1) * 0.95 + 0.5) + 1).alias("rounded_p95"),
    )
    between = lambda x, y, t: F.round(F.col(x) + (F.col(y) - F.col(x)) * F.col(t), 9)
    return out.select(group, between("a", "b", "c").alias("linear_p50"), between("d", "e", "f").alias("linear_p95"), "nearest_p95", "rounded_p95")


def streaks(df: DataFrame, group: str, order: list[str], bad: Column, least: int) -> DataFrame:
    """group, n, first, last: runs of at least ``least`` consecutive rows for which ``bad`` holds.

    Runs are found inside range partitions and joined where they touch their
    edges, so a group of any size is never sorted in one task.
    """
    rows = range_sorted(df.select(group, *order, F.coalesce(bad, F.lit(False)).alias("bad")), [group], order)
    block = Window.partitionBy(group, "part").orderBy(*order)
    numbered = rows.withColumn("good_before", F.sum((~F.col("bad")).cast("int")).over(block.rowsBetween(Window.unboundedPreceding, 0)))
    at = F.struct(*order)
    # a run inside a block; whether it touches the block's ends decides if it may go on in the next
    runs = numbered.where("bad").groupBy(group, "part", "good_before").agg(F.count("*").alias("n"), F.min(at).alias("first"), F.max(at).alias("last"))
    ends = rows.groupBy(group, "part").agg(F.min(at).alias("head"), F.max(at).alias("tail"))
    runs = runs.join(ends, [group, "part"]).withColumn("from_start", F.col("first") == F.col("head")).withColumn("to_end", F.col("last") == F.col("tail"))
    inner = runs.where("not from_start and not to_end").select(group, "n", "first", "last")
    edge = runs.where("from_start or to_end")  # at most two per group and partition
    blocks = ends.select(group, "part").withColumn("nth", F.row_number().over(Window.partitionBy(group).orderBy("part")))
    edge = edge.join(blocks, [group, "part"])
    order_runs = Window.partitionBy(group).orderBy("nth", "first")
    before = F.lag(F.struct("nth", "to_end")).over(order_runs)
    goes_on = F.col("from_start") & F.coalesce((before["nth"] == F.col("nth") - 1) & before["to_end"], F.lit(False))
    edge = edge.withColumn("start", (~goes_on).cast("int"))
    edge = edge.withColumn("run", F.sum("start").over(order_runs.rowsBetween(Window.unboundedPreceding, 0)))
    outer = edge.groupBy(group, "run").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last")).drop("run")
    return inner.unionByName(outer).where(F.col("n") >= least)


def trailing_sums(events: DataFrame) -> DataFrame:
    """user_id, event_id, last_hour, last_day: events in the hour and value in the day up to each event, itself and equal times included.

    Every event goes to its own day and to the next one, so a window is one
    user's two days and not the user's whole history.
    """
    day = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86400000000).cast("long")
    rows = events.select("user_id", "event_id", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), day.alias("own"))
    twice = rows.withColumn("day", F.explode(F.array("own", F.col("own") + 1)))
    w = Window.partitionBy("user_id", "day").orderBy("at")
    hour, whole = w.rangeBetween(-3600000000, 0), w.rangeBetween(-86400000000, 0)
    out = twice.withColumn("last_hour", F.count("*").over(hour)).withColumn("last_day", F.sum(F.col("value").cast("decimal(18,6)")).over(whole)).where("day = own")
    return out.select("user_id", "event_id", "last_hour", F.col("last_day").cast("decimal(18,2)").cast("double").alias("last_day"))


def token_f1(df: DataFrame, left: str, right: str) -> DataFrame:
    """Adds f1: twice the shared tokens, counted with their repetitions, over the tokens of both; 0 without any."""
    times = lambda tokens, t: F.size(F.filter(tokens, lambda x: x == t))

    def score(x: Column) -> Column:
        n = F.size(x["a"]) + F.size(x["b"])
        shared = F.aggregate(F.array_intersect(x["a"], x["b"]), F.lit(0), lambda acc, t: acc + F.least(times(x["a"], t), times(x["b"], t)))
        return F.when(n > 0, 2 * shared / n).otherwise(0.0)

    return df.withColumn("f1", X.let(F.struct(X.answer_tokens(left).alias("a"), X.answer_tokens(right).alias("b")), score))
