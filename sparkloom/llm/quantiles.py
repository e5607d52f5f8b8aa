"""Percentiles per group by radix selection.

Doubles are mapped to integers of the same order. A pass counts, per group, the
next 16 bits of the values that share the digits found so far, and follows only
the digit that holds each target rank. Counts are summed before the shuffle, so
a group of any size costs at most 65,536 rows per pass and task. After four
passes the value is exact; stopped after ``passes`` passes the answer is the
lower end of an interval that surely holds the value, its upper end is returned
too. Histograms of the first digits add up over days and files.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.tables import stored

DIGIT = 16
PASSES = 64 // DIGIT
#: Bits of a mergeable histogram: sign, 11 of the exponent and 12 of the fraction, so values in a cell differ by less than 1 part in 4096.
CELL_BITS = 24


@F.pandas_udf(T.LongType())
def order_key(values: pd.Series) -> pd.Series:
    """An integer with the order of the double. -0.0 counts as 0.0."""
    bits = (values.to_numpy(np.float64) + 0.0).view(np.int64)
    return pd.Series(np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits))


@F.pandas_udf(T.DoubleType())
def key_value(keys: pd.Series) -> pd.Series:
    """The double of an order key."""
    bits = keys.to_numpy(np.int64)
    return pd.Series(np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits).view(np.float64))


def keyed(df: DataFrame, groups: list[Column], value: str) -> DataFrame:
    """Group columns and the order key of each value; nulls and NaN are left out."""
    ok = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    return ok.select(*groups, order_key(F.col(value).cast("double")).alias("radix"))


def target_ranks(counts: DataFrame, groups: list[str], points: DataFrame) -> DataFrame:
    """Groups, q, n and rank: the nearest rank ceil(q n), at least 1, of each point in (0, 1]."""
    q = points.select(F.col("q").cast("double").alias("q")).where("q is not null").distinct()
    rank = F.greatest(F.lit(1), F.ceil(F.col("q") * F.col("n"))).cast("long")
    return counts.crossJoin(F.broadcast(q)).withColumn("rank", F.least(rank, F.col("n")))


def _same(a: str, b: str, columns: list[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def quantiles(data: DataFrame, groups: list[str], points: DataFrame, passes: int = PASSES) -> DataFrame:
    """Groups, q, n, rank, lower, upper: the value of nearest rank of each q lies in [lower, upper].

    ``data`` has the groups and ``radix`` of keyed(). With all four passes lower
    and upper are the value itself. Null groups are groups of their own; an
    empty table gives no rows. ``points`` (one column q) is a short list.
    """
    todo = None
    for n in range(passes):
        shift = 64 - DIGIT * (n + 1)
        digit = F.shiftright("radix", shift)
        if todo is None:
            counted = stored(data.groupBy(*groups, digit.alias("digit")).agg(F.count("*").alias("cell")))
            sizes = counted.groupBy(*groups).agg(F.sum("cell").alias("n"))
            todo = target_ranks(sizes, groups, points).withColumn("left", F.col("rank"))
            cells = counted.alias("c").join(todo.alias("t"), _same("c", "t", groups))
        else:
            wanted = todo.select(*groups, "digit").distinct()
            kept = data.alias("d").join(wanted.alias("w"), _same("d", "w", groups) & (F.shiftright("d.radix", shift + DIGIT) == F.col("w.digit")), "left_semi")
            counted = kept.groupBy(*groups, F.shiftright("radix", shift).alias("digit")).agg(F.count("*").alias("cell"))
            cells = counted.alias("c").join(todo.alias("t"), _same("c", "t", groups) & (F.shiftright("c.digit", DIGIT) == F.col("t.digit")))
        flat = cells.select(*[F.col(f"t.{g}").alias(g) for g in groups], "t.q", "t.n", "t.rank", "t.left", "c.digit", "c.cell")
        upto = F.sum("cell").over(Window.partitionBy(*groups, "q").orderBy("digit"))
        at = flat.withColumn("upto", upto).where((F.col("upto") >= F.col("left")) & (F.col("upto") - F.col("cell") < F.col("left")))
        todo = stored(at.select(*groups, "q", "n", "rank", (F.col("left") - F.col("upto") + F.col("cell")).alias("left"), "digit"))
    rest = 64 - DIGIT * passes
    low = F.shiftleft("digit", rest)
    return todo.select(*groups, "q", "n", "rank", key_value(low).alias("lower"), key_value(low.bitwiseOR(F.lit((1 << rest) - 1))).alias("upper"))


def histogram(data: DataFrame, groups: list[str], bits: int = CELL_BITS) -> DataFrame:
    """Groups, digit, cell: a summary that adds up. Summaries of parts of the data, unioned and summed, are that of the whole."""
    return data.groupBy(*groups, F.shiftright("radix", 64 - bits).alias("digit")).agg(F.count("*").alias("cell"))


def merged(parts: DataFrame, groups: list[str]) -> DataFrame:
    """The sum of histograms over everything but ``groups``."""
    return parts.groupBy(*groups, "digit").agg(F.sum("cell").alias("cell"))


def histogram_quantiles(hist: DataFrame, groups: list[str], points: DataFrame, bits: int = CELL_BITS) -> DataFrame:
    """As quantiles(), read off a histogram: the value lies in [lower, upper], which differ by less than 2 ** (12 - bits) of the value."""
    sizes = hist.groupBy(*groups).agg(F.sum("cell").alias("n"))
    todo = target_ranks(sizes, groups, points)
    upto = F.sum("cell").over(Window.partitionBy(*groups).orderBy("digit"))
    running = hist.withColumn("upto", upto)
    at = running.alias("c").join(todo.alias("t"), _same("c", "t", groups) & (F.col("c.upto") >= F.col("t.rank")) & (F.col("c.upto") - F.col("c.cell") < F.col("t.rank")))
    low = F.shiftleft("c.digit", 64 - bits)
    return at.select(*[F.col(f"t.{g}").alias(g) for g in groups], "t.q", "t.n", "t.rank", key_value(low).alias("lower"), key_value(low.bitwiseOR(F.lit((1 << (64 - bits)) - 1))).alias("upper"))


def banded(data: DataFrame, values: DataFrame, groups: list[str]) -> DataFrame:
    """Adds latency_ms and band to ``data``: the least q whose value is not below the row's, null if there is none.

    ``values`` is the result of quantiles() for the same groups: one row per
    group and point, collected to one short array per group.
    """
    steps = values.groupBy(*groups).agg(F.array_sort(F.collect_list(F.struct("q", order_key("lower").alias("at")))).alias("steps"))
    joined = data.alias("d").join(steps.alias("s"), _same("d", "s", groups), "left").select("d.*", "s.steps")
    first = F.try_element_at(F.filter("steps", lambda x: x["at"] >= F.col("radix")), F.lit(1))
    return joined.select(*data.columns, key_value("radix").alias("latency_ms"), first["q"].alias("band"))


def calls(events: DataFrame) -> DataFrame:
    """One row per event_id: the copy received first. Copies without an id are calls of their own."""
    first = F.min_by(F.struct("ts", "stage", "model", "latency_ms"), F.coalesce("received_at", F.col("ts")))
    known = events.where("event_id is not null").groupBy("event_id").agg(first.alias("x")).select("event_id", "x.*")
    return known.unionByName(events.where("event_id is null").select("event_id", "ts", "stage", "model", "latency_ms"))


def latencies(events: DataFrame, *more: str) -> DataFrame:
    """day, stage (lower case), model and radix of every call with a latency, and ``more`` columns of calls()."""
    groups = [F.to_date("ts").alias("day"), F.lower(F.trim("stage")).alias("stage"), F.col("model"), *map(F.col, more)]
    return keyed(calls(events), groups, "latency_ms")
