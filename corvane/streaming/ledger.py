"""Streaming twins: idempotent ledger appends, and event-time windows (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def dedup(stream: DataFrame, key: list[str], time: str | None = None, delay: str = "1 day") -> DataFrame:
    """First sighting of each key; with an event time, state older than the delay is dropped."""
    if time is None:
        return stream.dropDuplicates(key)
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(key)


def append_to(stream: DataFrame, path: str, checkpoint: str, key: str, once: bool = True) -> StreamingQuery:
    """Appends to a Parquet ledger only rows whose key it lacks, batch by batch; a repeated batch adds nothing.

    Rows that repeat a key inside one batch all stay, as in ledger.append. Of the ledger only the key column is read,
    between the batch's least and greatest key, a filter that reaches the files' statistics.
    """
    schema = stream.schema

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        try:
            old = spark.read.schema(schema).parquet(path).select(key)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            old = spark.createDataFrame([], schema).select(key)
        batch = batch.persist()
        try:
            least, most = batch.agg(F.min(key), F.max(key)).first()
            old = old.where(F.col(key).between(F.lit(least), F.lit(most)))
            fresh = batch.join(old, key, "left_anti")
            fresh.select(*schema.names).write.mode("append").parquet(path)
        finally:
            batch.unpersist()

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def tumbling(events: DataFrame, size: str = "1 hour", delay: str = "10 minutes", time: str = "ts", group: str = "event_type", value: str = "value") -> DataFrame:
    """window_start, group, n, total; the same expression serves batch and stream."""
    e = events.withColumn(time, F.col(time).cast("timestamp"))
    e = e.withWatermark(time, delay) if events.isStreaming else e
    g = e.groupBy(F.window(time, size), group).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("window.start").alias("window_start"), group, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour", time: str = "ts", user: str = "user_id") -> DataFrame:
    """user, session_start, session_end, n."""
    e = events.withColumn(time, F.col(time).cast("timestamp"))
    e = e.withWatermark(time, delay) if events.isStreaming else e
    g = e.groupBy(user, F.session_window(time, gap)).agg(F.count("*").alias("n"))
    return g.select(user, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")
