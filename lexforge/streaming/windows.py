"""Event-time operators. Each takes a batch or a streaming table; on a stream a watermark bounds the state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, late: str) -> DataFrame:
    return events.withWatermark("ts", late) if events.isStreaming else events


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total) in windows that don't overlap."""
    g = _timed(events, late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "1 hour", step: str = "15 minutes", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, mean) in overlapping windows."""
    g = _timed(events, late).groupBy(F.window("ts", width, step).alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "mean")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(user_id, start, end, n): runs of a user's events less than a gap apart."""
    g = _timed(events, late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def bursts(events: DataFrame, kind: str = "error", most: int = 5, width: str = "1 day", late: str = "2 hours") -> DataFrame:
    """(start, n): windows with more events of a kind than `most`."""
    g = _timed(events.where(F.col("event_type") == kind), late).groupBy(F.window("ts", width).alias("w")).agg(F.count("*").alias("n")).where(F.col("n") > most)
    return g.select(F.col("w.start").alias("start"), "n")


def alerts(events: DataFrame, threshold: float) -> DataFrame:
    """Rows above a threshold with their severity: high beyond one and a half times it. Stateless."""
    return events.where(F.col("value") > threshold).withColumn("severity", F.when(F.col("value") > 1.5 * threshold, "high").otherwise("medium"))


def fresh(events: DataFrame, key: str, late: str = "1 day") -> DataFrame:
    """Each key once; on a stream, within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def pipeline(items: DataFrame, step, out: str, checkpoint: str):
    """Run a stage over what is new in a stream of items and stop: `step` maps a batch to (id, status, error) rows, which are appended to `out`.

    Exactly once by batch number: a batch that is tried again overwrites its own folder.
    """

    def write(batch: DataFrame, number: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return items.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
