"""Play progress and daily counts over streams and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallgrass.functions import score

#: Share of a duration from which an episode is completed, for good.
COMPLETE = 0.95


def progress(events: DataFrame) -> DataFrame:
    """Per (work_id, episode_id): the last ratio, and whether any event completed it.

    Events: work_id, episode_id, at, position, duration. A stream needs output
    mode 'complete' or 'update', as nothing ends. Of events at one time the
    greatest ratio counts as the last.
    """
    e = events.withColumn("ratio", score.progress_ratio("position", "duration"))
    done = F.max((F.coalesce(F.col("position") / F.when(F.col("duration") > 0, F.col("duration")), F.lit(0.0)) >= COMPLETE).cast("int")) == 1
    last = F.max(F.struct("at", "ratio"))
    return e.groupBy("work_id", "episode_id").agg(last.alias("last"), done.alias("completed")).select("work_id", "episode_id", F.col("last.ratio").alias("ratio"), "completed", F.col("last.at").alias("updated_at"))


def daily(events: DataFrame, time: str, key: Column, late: str = "1 day") -> DataFrame:
    """Counts by day and key. A stream's late rows are taken until the watermark passes their day."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, "1 day").alias("w"), key.alias("key")).agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("day"), "key", "n")
