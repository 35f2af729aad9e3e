"""Events as a stream into weekly counts: late events up to the watermark count, repeated ids once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import week_end


def weekly_events(events: DataFrame, lateness: str = "14 days") -> DataFrame:
    """events (event_id, ts timestamp, event_type, value), batch or stream -> week, event_type, n, value. Works on
    both: on a stream, state is dropped once the watermark has passed, so it stays bounded."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        stamped = stamped.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"])
    else:
        stamped = stamped.dropDuplicates(["event_id"])
    # windows of seven days that begin on Mondays
    weeks = stamped.groupBy(F.window("ts", "7 days", "7 days", "4 days").alias("w"), "event_type")
    sums = weeks.agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(28,6)")).alias("value"))
    return sums.select(week_end(F.col("w.start")).alias("week"), "event_type", "n", "value")


def write_weekly(events: DataFrame, path: str, checkpoint: str, lateness: str = "14 days"):
    """Starts the stream that appends finished weeks to Parquet under path."""
    return weekly_events(events, lateness).writeStream.outputMode("append").option("checkpointLocation", checkpoint).format("parquet").option("path", path).trigger(availableNow=True).start()
