"""Streams: each micro-batch becomes one sealed run of a store, and sessions with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.sources.store import Store


def append_runs(stream: DataFrame, store: Store, checkpoint: str, order: str | None = None) -> StreamingQuery:
    """Seal one run per micro-batch. Of a page's rows in a batch the one with the greatest order counts (a column of the
    stream; without it the greatest values do). The root notes each batch with its seal, so that a batch which is
    replayed after a failure is not sealed again."""
    values = store.values

    def seal(batch: DataFrame, batch_id: int) -> None:
        if store.refresh().root.get("batches", {}).get(checkpoint, -1) >= batch_id:
            return
        by = F.struct(*([order] if order else []), *values)
        rows = batch.groupBy("page").agg(F.max_by(F.struct(*values), by).alias("x")).select("page", "x.*")

        def note(root: dict) -> dict:
            root.setdefault("batches", {})[checkpoint] = batch_id
            return root

        if not batch.isEmpty():
            store.put(rows)
            store.seal(note=note)

    return stream.writeStream.foreachBatch(seal).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions per user of events that are at most so late: the settle rule of seals as a session gap."""
    s = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return s.agg(F.count(F.lit(1)).alias("events"), F.max("value").alias("top")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", "top")


def batch_sessions(spark: SparkSession, events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    s = events.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return s.agg(F.count(F.lit(1)).alias("events"), F.max("value").alias("top")).groupBy("events").agg(F.count(F.lit(1)).alias("sessions"), F.max("top").alias("top"))
