"""Incremental suppression on streams: findings arrive, each fingerprint is passed on once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factloom.sources.sinks import append_findings


def first_findings(stream: DataFrame, time_col: str = "effective_at", horizon: str = "30 days") -> DataFrame:
    """A stream with one row for each fingerprint within the horizon; the watermark bounds the state."""
    return stream.withWatermark(time_col, horizon).dropDuplicatesWithinWatermark(["fingerprint"])


def activity(stream: DataFrame, time_col: str = "ts", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums of events by type in tumbling windows, closed by the watermark."""
    return stream.withWatermark(time_col, late).groupBy(F.window(time_col, window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def append_stream(stream: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Append the new findings of each micro-batch; a batch that is run again stores the same rows again in place of its own."""

    def store(batch: DataFrame, batch_id: int) -> None:
        append_findings(batch, root, f"stream-{batch_id:012d}")

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
