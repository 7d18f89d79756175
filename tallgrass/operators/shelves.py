"""Shelves: works in the orders of the category pages, and a random showcase for each of many sessions.

Titles compare as Chinese readers expect (collation zh: digits, Han by
pronunciation, Latin without regard to case unless all else is equal). Null
titles count as '', equal titles end in work_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: the language whose rules order titles.
COLLATION = "zh_Hans_CHN"

# Groups of a work's episodes in order; groups without a place come last.
EPISODE_GROUPS = {"season": 0, "special": 1, "sps": 1, "auxiliary": 2, "movie": 3, "op_ed": 4}

ORDERS = ("recent", "title", "titleDesc", "ratingDesc", "ratingAsc", "yearDesc", "yearAsc")

_DIGITS = 4  # hexadecimal digits of a work's hash that name its block: at most 65,536 blocks a pool


def by_title(title="title") -> Column:
    """A title as a sort key of its language."""
    return F.collate(F.coalesce(F.col(title), F.lit("")), COLLATION)


def order_of(order: str) -> list[Column]:
    """Sort keys of one of ORDERS over title, rating, year and recent_rank (null: never played, last).

    Null ratings are 0, null years 0 downwards and 9999 upwards. Every order ends in the title upwards and work_id.
    """
    rating = F.coalesce("rating", F.lit(0.0))
    first = {
        "recent": [F.col("recent_rank").asc_nulls_last()],
        "title": [],
        "titleDesc": [by_title().desc()],
        "ratingDesc": [rating.desc()],
        "ratingAsc": [rating.asc()],
        "yearDesc": [F.coalesce("year", F.lit(0)).desc()],
        "yearAsc": [F.coalesce("year", F.lit(9999)).asc()],
    }
    if order not in first:
        raise ValueError(f"no such order: {order}")
    return [*first[order], by_title().asc(), F.col("work_id").asc()]


def shelf(works: DataFrame, category: str, order: str, most: int, recent: DataFrame | None = None) -> DataFrame:
    """Each category's first `most` works that have a poster, in an order, with their place (from 1).

    works: work_id, title, poster, rating, year and the category, whose null is a
    category of its own. recent: work_id, recent_rank, at most one row a work;
    only the order 'recent' needs it. Each task keeps at most `most` works of a
    category before the shuffle, so a category of any size fits.
    """
    shown = works.where(F.trim(F.coalesce("poster", F.lit(""))) != "")
    if order == "recent":
        if recent is None:
            raise ValueError("the order 'recent' needs the ranks")
        shown = shown.join(recent.select("work_id", "recent_rank"), "work_id", "left")
    place = F.row_number().over(Window.partitionBy(category).orderBy(*order_of(order)))
    return shown.withColumn("place", place).where(F.col("place") <= max(0, most))


def episode_order(group="group_type", season="season_number", episode="episode_number", title="title", key="episode_id") -> list[Column]:
    """Sort keys of a work's episodes: group, season (null as 999), number (null as 9999), title by code point, id."""
    place = F.lit(9)
    for name, n in EPISODE_GROUPS.items():
        place = F.when(F.col(group) == name, n).otherwise(place)
    return [place.asc(), F.coalesce(season, F.lit(999)).asc(), F.coalesce(episode, F.lit(9999)).asc(), F.coalesce(title, F.lit("")).asc(), F.col(key).asc()]


def _number(*parts) -> Column:
    """A non-negative number below 2**52 that hangs on the parts alone."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])), 1, 13), 16, 10).cast("long")


def _blocks(works: DataFrame) -> DataFrame:
    """pool, work_id, _block: each pool's distinct works, a block of them in one partition."""
    block = F.substring(F.md5(F.col("work_id").cast("string")), 1, _DIGITS)
    return works.select("pool", "work_id").dropna().withColumn("_block", block).repartition("pool", "_block").dropDuplicates(["pool", "_block", "work_id"])


def _positions(w: DataFrame) -> DataFrame:
    """pool, work_id, position: each pool's works numbered from 0 by (md5 of work_id, work_id), block by block."""
    order = [F.md5(F.col("work_id").cast("string")), F.col("work_id")]
    w = w.withColumn("_n", F.row_number().over(Window.partitionBy("pool", "_block").orderBy(*order)) - 1)
    sizes = w.groupBy("pool", "_block").agg(F.count("*").alias("_size"))
    before = F.sum("_size").over(Window.partitionBy("pool").orderBy("_block")) - F.col("_size")
    starts = sizes.select("pool", "_block", before.alias("_start"))  # at most 16**_DIGITS rows a pool
    return w.join(starts, ["pool", "_block"]).select("pool", "work_id", (F.col("_start") + F.col("_n")).alias("position"))


def session_showcase(sessions: DataFrame, works: DataFrame, most: int = 8, seed: str = "") -> DataFrame:
    """session, slot (from 0), work_id: for each session `most` works of its pool at random (all, if fewer), in random order.

    sessions: session, pool; works: pool, work_id. Rows with a null take no part,
    repeated rows count once, a session of several pools gets a showcase for
    each (pool is returned, too), and `most` of 0 or less shows nothing. The same session, works and seed give the same
    showcase however often and wherever it runs; another set of works draws
    anew, as a digest of the set is part of every hash. Works are numbered within their pool; a session draws distinct
    numbers, one hash for each slot, and fetches their works by an equi-join. So
    sessions cost what they show and never meet the whole pool.
    """
    blocks = _blocks(works)
    placed = _positions(blocks)
    totals = blocks.groupBy("pool").agg(F.count("*").alias("_total"), F.bit_xor(_number("work_id")).alias("_set"))
    asked = sessions.where(F.lit(most > 0)).select("session", "pool").dropna().distinct().join(totals, "pool")
    steps = F.sequence(F.greatest(F.col("_total") - max(1, most), F.lit(0)), F.col("_total") - 1)

    def drawn(taken: Column, last: Column) -> Column:  # a number up to `last`, or `last` itself where that is taken: every set is as likely
        n = _number(F.lit(seed), "session", "_set", last) % (last + 1)
        return F.concat(taken, F.array(F.when(F.array_contains(taken, n), last).otherwise(n)))

    numbers = F.aggregate(steps, F.array().cast("array<bigint>"), drawn)
    mixed = F.array_sort(F.transform(numbers, lambda n: F.struct(_number(F.lit(seed), "session", "_set", F.lit("slot"), n).alias("by"), n.alias("position"))))
    draws = asked.select("session", "pool", F.posexplode(mixed).alias("slot", "_at")).select("session", "pool", "slot", F.col("_at.position").alias("position"))
    return draws.join(placed, ["pool", "position"]).select("session", "pool", "slot", "work_id")
