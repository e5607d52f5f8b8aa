"""Order inside groups of any size, without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.tables import stored


def range_sorted(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``df`` stored in range partitions by (group, order), with their number in ``part``: a large group spans several."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(df.repartitionByRange(n, *group, *order).withColumn("part", F.spark_partition_id()))


def with_neighbours(df: DataFrame, group: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Adds prev_X and next_X for each X of ``columns``: the values of the rows before and after in the group.

    ``order`` must be unique in the group; the group columns must not be null.
    Null at the ends of a group and where the neighbour's value is null. An
    empty table stays empty.
    """
    rows = range_sorted(df, group, order)
    value = F.struct(*columns)
    block = Window.partitionBy("part", *group).orderBy(*order)
    near = rows.withColumn("own_prev", F.lag(value).over(block)).withColumn("own_next", F.lead(value).over(block))
    key = F.struct(*order)
    ends = rows.groupBy(*group, "part").agg(F.min_by(value, key).alias("head"), F.max_by(value, key).alias("tail"))
    over = Window.partitionBy(*group).orderBy("part")  # as many rows per group as it has partitions
    ends = ends.withColumn("edge_prev", F.lag("tail").over(over)).withColumn("edge_next", F.lead("head").over(over))
    ends = ends.where("edge_prev is not null or edge_next is not null").select(*group, "part", "edge_prev", "edge_next")
    joined = near.join(ends, [*group, "part"], "left")
    out = joined.select(*df.columns, F.coalesce("own_prev", "edge_prev").alias("p"), F.coalesce("own_next", "edge_next").alias("n"))
    return out.select(*df.columns, *[F.col(f"p.{c}").alias(f"prev_{c}") for c in columns], *[F.col(f"n.{c}").alias(f"next_{c}") for c in columns])


def with_running(df: DataFrame, group: list[str], order: list[str], sums: dict[str, Column] | None = None, latest: dict[str, Column] | None = None) -> DataFrame:
    """Adds, for each row, what the rows before it in the group add up to.

    ``sums`` names running sums (0 at the start of a group), ``latest`` running
    maxima (null at the start; a struct that begins with the order gives the
    latest row that is not null). ``order`` must be unique in the group. Rows are
    range-partitioned; a partition carries over one row per group to those
    behind it, so a group of any size is never in one task.
    """
    sums, latest = sums or {}, latest or {}
    extra = df.withColumns({f"own_{n}": c for n, c in {**sums, **latest}.items()})
    rows = range_sorted(extra, group, order)
    block = Window.partitionBy("part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumns({**{n: F.coalesce(F.sum(f"own_{n}").over(block), F.lit(0)) for n in sums}, **{n: F.max(f"own_{n}").over(block) for n in latest}})
    carried = rows.groupBy(*group, "part").agg(*[F.sum(f"own_{n}").alias(f"sum_{n}") for n in sums], *[F.max(f"own_{n}").alias(f"max_{n}") for n in latest])
    over = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows per group as it has partitions
    carried = carried.select(*group, "part", *[F.sum(f"sum_{n}").over(over).alias(f"from_{n}") for n in sums], *[F.max(f"max_{n}").over(over).alias(f"from_{n}") for n in latest])
    several = carried.where(" or ".join(f"from_{n} is not null" for n in [*sums, *latest]))
    both = inside.join(several, [*group, "part"], "left")
    total = [(F.col(n) + F.coalesce(f"from_{n}", F.lit(0))).alias(n) for n in sums]
    return both.select(*df.columns, *total, *[F.coalesce(n, f"from_{n}").alias(n) for n in latest])
