"""Contexts under a token budget: trimming, bounding, selection and their quality."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import text as X
from sparkloom.tables import stored

#: Weights of the selection score; tokens kept free for headings.
RELEVANCE_WEIGHT, RECENCY_WEIGHT, OVERHEAD = 0.7, 0.3, 96
SECTIONS = ["task", "workspace", "summary", "recent_message", "planner_state", "tool_output", "memory", "evidence"]


def trimmed(text: str | Column, budget: int) -> Column:
    """The longest beginning whose token estimate fits the budget, with an ellipsis if something is cut.

    Tokens are summed along the text in the row itself; nothing is searched.
    Null for null, empty for a budget below 1.
    """
    t = X.col(text)
    tokens = X.matches(t, f"[{X.HAN}]|[A-Za-z0-9_]+|[^{X.WS}A-Za-z0-9_{X.HAN}]|[{X.WS}]+")
    cost = lambda w: F.when(w.rlike("^[A-Za-z0-9_]"), F.floor((F.length(w) + 3) / 4)).when(w.rlike(f"^[{X.WS}]"), 0).otherwise(1).cast("int")
    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("length"), F.lit(False).alias("full"))

    def step(acc: Column, w: Column) -> Column:
        stop = acc["full"] | (acc["used"] + cost(w) > budget - 3)
        return F.struct((acc["used"] + cost(w)).alias("used"), F.when(stop, acc["length"]).otherwise(acc["length"] + F.length(w)).alias("length"), stop.alias("full"))

    kept = F.aggregate(tokens, start, step)["length"]
    cut = F.concat(F.substring(t, F.lit(1), kept), F.lit("..."))
    return F.when(F.lit(budget < 1), F.lit("")).when(X.token_estimate(t) <= budget, t).otherwise(cut)


def around(text: str | Column, part: str | Column, most: int) -> Column:
    """At most ``most`` characters of a text around a part of it; the beginning if the part does not occur."""
    t, p = X.col(text), X.col(part)
    at = F.greatest(F.instr(t, F.substring(p, 1, 80)) - F.floor((most - F.length(p)) / 2), F.lit(1)).cast("int")
    at = F.greatest(F.least(at, F.length(t) - most + 1), F.lit(1))
    return F.when(F.length(t) <= most, t).otherwise(F.substring(t, at, F.lit(most)))


def select(packets: DataFrame, budget: int) -> DataFrame:
    """Adds kept and used: packets of each request chosen under a token budget.

    ``packets`` has request, packet_id (unique in the request), required, priority,
    relevance, recency and tokens (not negative). Required ones come first by
    priority, the others by value; each is taken if it still fits what is left.
    Packets without a size are not taken.

    Of the packets of one size t at most budget / t are taken, and none behind one
    that no longer fits; so the choice, which depends on all before it, needs only
    the first budget / t of each size, whatever the number of packets.
    """
    value = RELEVANCE_WEIGHT * F.col("relevance") + RECENCY_WEIGHT * F.col("recency") + F.least(F.greatest("priority", F.lit(0)), F.lit(100)) / 1000
    rows = stored(packets.withColumn("value", F.when(F.col("required"), F.col("priority").cast("double")).otherwise(value)))
    room = max(32, budget - OVERHEAD)
    order = Window.partitionBy("request", "tokens").orderBy(F.desc("required"), F.desc("value"), "packet_id")
    first = rows.where(F.col("tokens").between(1, room)).select("request", "packet_id", "required", "value", "tokens").withColumn("n", F.row_number().over(order))
    first = first.where((F.col("n") <= room) & (F.col("n") * F.col("tokens") <= room)).drop("n")

    def choose(table: pa.Table) -> pa.Table:
        table = table.sort_by([("required", "descending"), ("value", "descending"), ("packet_id", "ascending")])
        used, kept = 0, []
        for n in table["tokens"].to_pylist():
            kept.append(used + n <= room)
            used += n if kept[-1] else 0
        return table.select(["request", "packet_id", "tokens"]).filter(pa.array(kept, pa.bool_()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in first.select("request", "packet_id", "tokens").schema.fields)
    taken = stored(first.groupBy("request").applyInArrow(choose, schema))
    used = taken.groupBy("request").agg(F.sum("tokens").cast("long").alias("used"))
    out = rows.join(taken.select("request", "packet_id", F.lit(True).alias("kept")), ["request", "packet_id"], "left").join(used, "request", "left")
    kept = F.coalesce("kept", F.col("tokens") == 0, F.lit(False))
    return out.select(*rows.columns, kept.alias("kept"), F.coalesce("used", F.lit(0)).cast("long").alias("used"))


def quality(chosen: DataFrame) -> DataFrame:
    """request, packets, kept, tokens, kept_tokens, ratio, mean_relevance, lost: how much of what was gathered is in the context."""
    k = F.col("kept")
    return chosen.groupBy("request").agg(
        F.count("*").alias("packets"), F.sum(k.cast("int")).alias("kept"), F.sum("tokens").alias("tokens"), F.coalesce(F.sum(F.when(k, F.col("tokens"))), F.lit(0)).alias("kept_tokens"),
        F.avg(F.when(k, F.col("relevance"))).alias("mean_relevance"), F.sum((~k & F.col("required")).cast("int")).alias("lost"),
    ).withColumn("ratio", F.when(F.col("tokens") > 0, F.col("kept_tokens") / F.col("tokens")).otherwise(F.lit(0.0)))


def lost_in_middle(ranked: DataFrame, relevant: Column) -> DataFrame:
    """query_id, shown, relevant, middle: relevant rows in the middle third of each result list (bounded by its k)."""
    n = F.count("*").over(Window.partitionBy("query_id"))
    rows = ranked.withColumn("n", n).withColumn("hit", relevant)
    middle = (F.col("rank") > F.col("n") / 3) & (F.col("rank") <= 2 * F.col("n") / 3)
    return rows.groupBy("query_id").agg(F.count("*").alias("shown"), F.sum(F.col("hit").cast("int")).alias("relevant"), F.sum((F.col("hit") & middle).cast("int")).alias("middle"))


def unsupported(claims: DataFrame) -> DataFrame:
    """Adds share and supported to (summary, source): sentences of a summary of whose terms the source holds less than half."""
    rows = claims.select("*", F.posexplode(X.sentences("summary")).alias("claim_no", "claim"))
    share = X.lexical_fraction(X.query_terms("claim"), F.coalesce("source", F.lit("")))
    return rows.withColumn("share", share).withColumn("supported", F.col("share") >= 0.5)
