"""Streams over event tables: replay, windows, duplicates, counters with state."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from sparkloom.tables import shared_dir


def source(spark: SparkSession, path: str) -> DataFrame:
    """The files of a table as a stream. A stream reads folders and patterns; this pattern fits the path alone, be it a file or a folder, on any file system."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def drain(stream: DataFrame, spark: SparkSession, mode: str = "append") -> DataFrame:
    """All that is there now, through a checkpointed file sink: exactly once, also after a restart."""
    place = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    run = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/out")


def drain_updates(stream: DataFrame, spark: SparkSession, keys: list[str]) -> DataFrame:
    """The last state of each key of an update stream. A batch that is repeated after a failure replaces itself."""
    place = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/out/batch={number}")

    run = stream.writeStream.outputMode("update").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).foreachBatch(write).start()
    run.awaitTermination()
    rows = spark.read.parquet(f"{place}/out")
    newest = Window.partitionBy(*keys).orderBy(F.desc("batch"))
    return rows.withColumn("n_th", F.row_number().over(newest)).where("n_th = 1").drop("n_th", "batch")


def hourly(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Count and value per type and hour, with a watermark for late rows."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("hour"), "event_type", "n", "value")


def once(events: DataFrame, key: str, time: str, late: str = "30 days") -> DataFrame:
    """Each key once, within the watermark."""
    return events.withColumn("at", F.col(time).cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark([key])


def fired(events: DataFrame, every: int = 30) -> DataFrame:
    """user_id, fired: how often each user's count has reached another ``every`` events; the count is kept as state."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        count = state.get[0] if state.exists else 0
        new = count + sum(len(f) for f in frames)
        state.update((new,))
        yield pd.DataFrame({"user_id": [key[0]], "fired": [new // every]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, fired long", "count long", "update", GroupStateTimeout.NoTimeout)


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Activity sessions per user, closed by a gap."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp"))
    grouped = timed.groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.col("w.start").alias("first_at"), F.col("w.end").alias("closed_at"), "n")
