"""Filling containers of fixed capacity.

Documents over the capacity are divided into full pieces and a rest. Pools of
bounded size, made by a hash of the key, are packed on their own: items above a
third of the capacity are matched greedily, at most two to a bin, the largest
with the largest that fits; all others go to the bin with the least room left
that takes them. Each pool leaves at most about one bin poorly filled.
"""

from __future__ import annotations

import bisect

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items of a pool on average; a pool is one group, so this bounds the work and memory of a task.
POOL_ITEMS = 20_000


def pack(sizes: list[int], capacity: int) -> list[int]:
    """The bin of every item; items are no larger than the capacity, and items of size 0 fit anywhere."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    bins = [-1] * len(sizes)
    rooms: list[int] = []
    large = [i for i in order if 3 * sizes[i] > capacity]
    # match the largest free item with the largest that fits beside it
    waiting = [(sizes[i], -i) for i in reversed(large)]  # ascending by size
    while waiting:
        size, i = waiting.pop()
        bins[-i] = len(rooms)
        room = capacity - size
        k = bisect.bisect_right(waiting, (room, 1)) - 1
        if k >= 0:
            other, j = waiting.pop(k)
            bins[-j] = len(rooms)
            room -= other
        rooms.append(room)
    gaps = sorted((room, b) for b, room in enumerate(rooms))
    for i in order[len(large) :]:
        size = sizes[i]
        k = bisect.bisect_left(gaps, (size, -1))
        if k < len(gaps):
            room, b = gaps.pop(k)
        else:
            room, b = capacity, len(rooms)
            rooms.append(capacity)
        bins[i] = b
        bisect.insort(gaps, (room - size, b))
    return bins


def pieces(sizes: DataFrame, containers: DataFrame) -> DataFrame:
    """container_kind, capacity, key, piece_no, size: documents as items; only those over the capacity are divided.

    ``sizes`` has key and size (0 for an empty or null text); ``containers`` is a
    short list of container_kind and capacity, of which rows without a positive
    capacity hold nothing and are left out.
    """
    kinds = containers.where("capacity > 0 and container_kind is not null").select("container_kind", F.col("capacity").cast("long").alias("capacity")).dropDuplicates(["container_kind"])
    both = sizes.join(F.broadcast(kinds))
    full = F.greatest(F.ceil(F.col("size") / F.col("capacity")), F.lit(1)).cast("int")
    cut = both.withColumn("piece_no", F.explode(F.sequence(F.lit(0), full - 1)))
    rest = F.least("capacity", F.col("size") - F.col("piece_no") * F.col("capacity"))
    return cut.select("container_kind", "capacity", "key", "piece_no", rest.cast("long").alias("size"))


def packed(items: DataFrame, pool_items: int = POOL_ITEMS) -> DataFrame:
    """Adds container_id: the items of pieces() with their container.

    Every item is placed once, and no container holds more than its capacity. A
    pool is drawn by key and piece, so repeated keys spread as well; full pieces
    are containers of their own.
    """
    whole = items.where("size = capacity").withColumn("container_id", F.concat_ws("/", "container_kind", F.lit("full"), "key", "piece_no"))
    part = items.where("size < capacity")
    pools = max(1, -(-part.groupBy("container_kind").count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("n")).first()["n"] // pool_items))
    part = part.withColumn("pool", F.pmod(F.xxhash64("key", "piece_no"), F.lit(pools)))
    kind = items.schema["key"].dataType.simpleString()

    def fill(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("piece_no", "ascending")])
        name, pool, capacity = table["container_kind"][0].as_py(), table["pool"][0].as_py(), table["capacity"][0].as_py()
        bins = pack(table["size"].to_pylist(), capacity)
        ids = pa.array([f"{name}/{pool}/{b}" for b in bins], pa.string())
        return table.select(["container_kind", "capacity", "key", "piece_no", "size"]).append_column("container_id", ids)

    schema = f"container_kind string, capacity long, key {kind}, piece_no int, size long, container_id string"
    filled = part.groupBy("container_kind", "pool").applyInArrow(fill, schema)
    return filled.unionByName(whole.select(*filled.columns))
