"""Keep-best, recency and top-k operators: ranking by windows with total orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_best(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in `order`, which must be total. Spark limits the window's groups before the shuffle."""
    ranked = rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_nth = 1").drop("_nth")


def recent_priority(history: DataFrame, work: str, played_at: str, event: str, per: str) -> DataFrame:
    """Per (per, work): first_index in the history of `per`, newest first, play_count and score = 12 / (1 + first_index) + 4 * min(play_count, 4)."""
    newest = Window.partitionBy(per).orderBy(F.col(played_at).desc(), F.col(event).desc())
    placed = history.withColumn("_i", F.row_number().over(newest) - 1)
    grouped = placed.groupBy(per, work).agg(F.min("_i").alias("first_index"), F.count("*").alias("play_count"))
    return grouped.withColumn("score", F.lit(12.0) / (1 + F.col("first_index")) + 4 * F.least("play_count", F.lit(4)))


def recent_rank(history: DataFrame, work: str, per: str, order: list[Column], last: bool = False) -> DataFrame:
    """Index of a work's first (or last) play in the history of `per`."""
    placed = history.withColumn("_i", F.row_number().over(Window.partitionBy(per).orderBy(*order)) - 1)
    return placed.groupBy(per, work).agg((F.max("_i") if last else F.min("_i")).alias("recent_rank"))


def running_bounds(parts: DataFrame, group: str, number: str, count: str) -> DataFrame:
    """Absolute first and last place of each part, from the counts of the parts before it."""
    before = Window.partitionBy(group).orderBy(number).rowsBetween(Window.unboundedPreceding, 0)
    return parts.withColumn("last_place", F.sum(count).over(before)).withColumn("first_place", F.col("last_place") - F.col(count) + 1)


def sort_nulls_as(column: str, value, ascending: bool = True) -> Column:
    """Sort key with nulls in the place of `value`."""
    key = F.coalesce(F.col(column), F.lit(value))
    return key.asc() if ascending else key.desc()
