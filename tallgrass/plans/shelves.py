"""Queries of shelves and session showcases. Parts stand for works, with Han characters in their titles; customers for sessions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallgrass.operators import shelves
from tallgrass.session import table

from .base import query

_SEVEN = {
    "recent": "recent_rank ASC NULLS LAST, ",
    "title": "",
    "titleDesc": "title COLLATE zh DESC, ",
    "ratingDesc": "coalesce(rating, 0) DESC, ",
    "ratingAsc": "coalesce(rating, 0), ",
    "yearDesc": "coalesce(year, 0) DESC, ",
    "yearAsc": "coalesce(year, 9999), ",
}
_TITLED = """SELECT p_partkey AS work_id, translate(split_part(p_name, ' ', 1), 'aeiou', '阿李王张白') AS title, p_brand AS category, CASE WHEN p_partkey % 6 = 0 THEN ' ' ELSE 'p' END AS poster,
    CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_size * 0.5 END AS rating, CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE 1990 + p_size % 30 END AS year FROM part"""


def _titled(spark: SparkSession, d: str) -> DataFrame:
    p, key = table(spark, d, "part"), F.col("p_partkey")
    return p.select(
        key.alias("work_id"),
        F.translate(F.split_part("p_name", F.lit(" "), F.lit(1)), "aeiou", "阿李王张白").alias("title"),
        F.col("p_brand").alias("category"),
        F.when(key % 6 == 0, " ").otherwise("p").alias("poster"),
        F.when(key % 9 != 0, F.col("p_size") * 0.5).alias("rating"),
        F.when(key % 10 != 0, 1990 + F.col("p_size") % 30).alias("year"),
    )


@query(
    f"""WITH w AS ({_TITLED}), h AS (SELECT l_partkey AS work_id, max(l_shipdate) AS played FROM lineitem WHERE l_partkey % 3 = 0 GROUP BY 1),
    r AS (SELECT work_id, date_diff('day', played, DATE '2100-01-01') AS recent_rank FROM h), s AS (SELECT w.*, recent_rank FROM w LEFT JOIN r USING (work_id) WHERE trim(poster) <> '')
    SELECT * FROM ({" UNION ALL ".join(f"SELECT '{o}' AS sorted_by, category, work_id, row_number() OVER (PARTITION BY category ORDER BY {c}title COLLATE zh, work_id) AS place FROM s" for o, c in _SEVEN.items())}) WHERE place <= 12"""
)
def category_shelves(spark: SparkSession, d: str) -> DataFrame:
    """The first twelve works of every category in each of the seven orders; a work's rank is the days since it was last shipped."""
    works = _titled(spark, d)
    played = table(spark, d, "lineitem").where("l_partkey % 3 = 0").groupBy(F.col("l_partkey").alias("work_id")).agg(F.max("l_shipdate").alias("_played"))
    recent = played.select("work_id", F.date_diff(F.lit("2100-01-01").cast("date"), F.col("_played").cast("date")).alias("recent_rank"))
    each = [shelves.shelf(works, "category", o, 12, recent).select(F.lit(o).alias("sorted_by"), "category", "work_id", F.col("place").cast("long").alias("place")) for o in shelves.ORDERS]
    return reduce(DataFrame.unionByName, each)


@query(
    """WITH RECURSIVE p AS (SELECT p_brand AS pool, p_partkey AS work_id, row_number() OVER (PARTITION BY p_brand ORDER BY md5(p_partkey::VARCHAR), p_partkey) - 1 AS position, count(*) OVER (PARTITION BY p_brand) AS n, bit_xor(('0x' || substr(md5(p_partkey::VARCHAR), 1, 13))::BIGINT) OVER (PARTITION BY p_brand) AS m FROM part),
    s AS (SELECT c_custkey AS session, pool, n, m FROM customer JOIN (SELECT DISTINCT pool, n, m FROM p) ON pool = 'Brand#' || (1 + c_nationkey)),
    draw AS (SELECT session, pool, n, m, greatest(n - 8, 0) AS j, []::BIGINT[] AS got FROM s
        UNION ALL SELECT session, pool, n, m, j + 1, list_append(got, CASE WHEN list_contains(got, t) THEN j ELSE t END) FROM (SELECT *, ('0x' || substr(md5('home/' || session || '/' || m || '/' || j), 1, 13))::BIGINT % (j + 1) AS t FROM draw WHERE j < n)),
    taken AS (SELECT session, pool, m, unnest(got) AS position FROM draw WHERE j = n),
    placed AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ('0x' || substr(md5('home/' || session || '/' || m || '/slot/' || position), 1, 13))::BIGINT, position) - 1 AS slot FROM taken)
    SELECT session, slot, work_id FROM placed JOIN p USING (pool, position)"""
)
def session_showcase(spark: SparkSession, d: str) -> DataFrame:
    """Eight works at random for every customer, out of the brand that belongs to its nation."""
    brand = F.concat(F.lit("Brand#"), (F.col("c_nationkey") + 1).cast("string"))
    sessions = table(spark, d, "customer").select(F.col("c_custkey").alias("session"), brand.alias("pool"))
    works = table(spark, d, "part").select(F.col("p_brand").alias("pool"), F.col("p_partkey").alias("work_id"))
    return shelves.session_showcase(sessions, works, 8, "home").select("session", F.col("slot").cast("long").alias("slot"), "work_id")


_GROUPS = "['season', 'special', 'sps', 'auxiliary', 'movie', 'op_ed', 'extra']"


@query(
    f"""WITH e AS (SELECT l_orderkey AS work_id, l_linenumber AS episode_id, {_GROUPS}[1 + l_linenumber % 7] AS group_type, CASE WHEN l_quantity < 10 THEN NULL ELSE l_linenumber % 3 END AS season_number, CASE WHEN l_discount < 0.02 THEN NULL ELSE l_suppkey % 4 END AS episode_number, CASE WHEN l_tax < 0.02 THEN NULL ELSE l_returnflag END AS title FROM lineitem)
    SELECT work_id, episode_id, row_number() OVER (PARTITION BY work_id ORDER BY CASE group_type WHEN 'season' THEN 0 WHEN 'special' THEN 1 WHEN 'sps' THEN 1 WHEN 'auxiliary' THEN 2 WHEN 'movie' THEN 3 WHEN 'op_ed' THEN 4 ELSE 9 END, coalesce(season_number, 999), coalesce(episode_number, 9999), coalesce(title, ''), episode_id) AS place FROM e"""
)
def episode_places(spark: SparkSession, d: str) -> DataFrame:
    """Every episode's place in its work; orders stand for works, their lines for episodes."""
    line = F.col("l_linenumber")
    groups = F.array(*[F.lit(g) for g in ("season", "special", "sps", "auxiliary", "movie", "op_ed", "extra")])
    e = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("work_id"),
        line.alias("episode_id"),
        F.get(groups, (line % 7).cast("int")).alias("group_type"),
        F.when(F.col("l_quantity") >= 10, line % 3).alias("season_number"),
        F.when(F.col("l_discount") >= 0.02, F.col("l_suppkey") % 4).alias("episode_number"),
        F.when(F.col("l_tax") >= 0.02, F.col("l_returnflag")).alias("title"),
    )
    place = F.row_number().over(Window.partitionBy("work_id").orderBy(*shelves.episode_order()))
    return e.select("work_id", "episode_id", place.cast("long").alias("place"))
