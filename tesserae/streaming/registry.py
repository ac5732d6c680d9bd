"""Keyed task state: events (artifact_id, event_id, ts, status) folded in order, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(events: DataFrame) -> DataFrame:
    """(artifact_id, status, attempts, updated_at): the last status of each key, and how often it was done or failed."""
    return events.groupBy("artifact_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.count_if(F.col("status").isin("valid", "failed")).alias("attempts"), F.max("ts").alias("updated_at"))


def on_load(registry: DataFrame) -> DataFrame:
    """What was running when the registry was saved did not end: it is stale."""
    return registry.withColumn("status", F.when(F.col("status") == "running", "stale").otherwise(F.col("status")))


def live(entries: DataFrame, now: str, days: float) -> DataFrame:
    """Entries (created_at) younger than so many days at a given time."""
    age = F.unix_micros(F.lit(now).cast("timestamp_ntz").cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))
    return entries.where(age < int(days * 86_400_000_000))


def changed_documents(now: DataFrame, before: DataFrame) -> DataFrame:
    """Documents (file_name, hash) that are new or whose hash differs: only these are processed again."""
    return now.join(before, ["file_name", "hash"], "left_anti")


def stream(events: DataFrame, watermark: str = "1 day") -> DataFrame:
    """The same registry over a stream of events (ts a timestamp); `update` output gives a row whenever a key changes."""
    return events.withWatermark("ts", watermark).groupBy("artifact_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.count_if(F.col("status").isin("valid", "failed")).alias("attempts"), F.max("ts").alias("updated_at"))


def run_stream(events: DataFrame, path: str, checkpoint: str):
    """Runs the registry over what is there and stops; each batch's changed keys are written below `path`, one folder a batch."""

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")  # a repeated batch replaces itself

    return stream(events).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def read_registry(spark, path: str) -> DataFrame:
    """The newest row of each key among the batches that a stream wrote."""
    rows = spark.read.parquet(path)
    return rows.groupBy("artifact_id").agg(F.max_by(F.struct("status", "attempts", "updated_at"), "batch").alias("r")).select("artifact_id", "r.*")
