"""Queries of duplicates: files of one episode, cards of one title. Orders stand for files, parts for works."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.operators import duplicates
from tallgrass.session import table

from .base import query

# Both engines read this text: the files, from columns of orders.
_FILES = """SELECT o_custkey % 20 AS plan, o_orderkey AS item_id, o_orderkey % 1000 AS position, CASE WHEN o_custkey % 5 > 0 THEN 'card' || (o_custkey % 4) END AS card, CASE WHEN o_orderkey % 15 = 0 THEN 'subtitle' ELSE 'video' END AS resource_type, 'generate_strm' AS action,
    CASE WHEN o_orderkey % 7 = 0 THEN 'special' WHEN o_orderkey % 7 = 1 THEN NULL ELSE 'season' END AS group_type, CASE WHEN o_orderkey % 11 > 0 THEN o_custkey % 3 END AS season_number, CASE WHEN o_orderkey % 13 > 0 THEN o_orderkey % 20 END AS episode_number, CASE WHEN o_orderkey % 2 > 0 THEN 1 END AS special_number,
    o_orderkey % 3 = 0 AS needs_review, CASE WHEN o_orderkey % 4 = 0 THEN 'Own' WHEN o_orderkey % 4 = 1 THEN '' END AS title, CASE WHEN o_orderkey % 6 = 0 THEN split('old', ',') END AS warnings, o_orderkey % 8 = 0 AS is_extra,
    'W ' || (o_custkey % 4) AS work_title, CASE WHEN o_custkey % 2 = 0 THEN 'Orig' END AS original_title, 'Series (' || (o_custkey % 3) || CASE WHEN o_custkey % 3 = 0 THEN ') x' ELSE ') ' END AS series_group, '/m//F' || (o_orderkey % 50) AS real_path,
    CASE WHEN o_orderkey % 9 = 0 THEN '1080P/' ELSE 'a/' END || CASE o_orderkey % 5 WHEN 0 THEN 'w' || (o_custkey % 4) WHEN 1 THEN 'ORIG' ELSE 'e' END || CASE o_custkey % 7 WHEN 0 THEN '.720p' WHEN 1 THEN '.2160p.HEVC' WHEN 2 THEN '.FLAC' WHEN 3 THEN '.x265.flac' ELSE '' END || '-' || o_orderkey || '.mkv' AS relative_path FROM orders"""


def _files(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(_FILES.replace("FROM orders", "FROM {orders}"), orders=table(spark, d, "orders"))


@query(
    f"""WITH i AS ({_FILES}), s AS (SELECT *, coalesce(card, '') AS c, lower(relative_path) AS low, resource_type = 'video' AND coalesce(group_type, '') = 'season' AND season_number IS NOT NULL AND episode_number IS NOT NULL AS m FROM i),
    r AS (SELECT item_id, count(*) OVER (PARTITION BY plan, c, season_number, episode_number) AS files, row_number() OVER (PARTITION BY plan, c, season_number, episode_number ORDER BY is_extra,
        CASE regexp_extract(low, '(2160|1080|720|480)p', 1) WHEN '2160' THEN 4 WHEN '1080' THEN 3 WHEN '720' THEN 2 WHEN '480' THEN 1 ELSE 0 END DESC, CASE WHEN low LIKE '%hevc%' OR low LIKE '%x265%' THEN 2 ELSE 0 END + CASE WHEN low LIKE '%flac%' THEN 1 ELSE 0 END DESC,
        CASE WHEN split_part(low, '/', 2) LIKE '%' || lower(replace(work_title, ' ', '')) || '%' THEN 2 WHEN original_title IS NOT NULL AND split_part(low, '/', 2) LIKE '%orig%' THEN 1 ELSE 0 END DESC, length(relative_path), relative_path DESC) AS place FROM s WHERE m),
    j AS (SELECT i.*, coalesce(files, 1) > 1 AS several, files, coalesce(files > 1 AND place > 1, false) AS d FROM i LEFT JOIN r USING (item_id))
    SELECT item_id, CASE WHEN d THEN 'ignore' ELSE action END AS action, CASE WHEN d THEN 'ignored' ELSE group_type END AS group_type, CASE WHEN NOT d THEN season_number END AS season_number, CASE WHEN NOT d THEN episode_number END AS episode_number, CASE WHEN NOT d THEN special_number END AS special_number, NOT d AND needs_review AS needs_review,
        CASE WHEN d AND coalesce(title, '') = '' THEN printf('S%02d', season_number) || printf('E%02d', episode_number) || ' 重复版本' ELSE title END AS title, concat_ws('|', CASE WHEN warnings IS NOT NULL THEN 'old' END, CASE WHEN several THEN '同一季集存在多个来源文件（' || files || ' 个），' || CASE WHEN d THEN '已自动跳过重复版本' ELSE '已自动保留此版本' END END) AS warnings FROM j"""
)
def resolved_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Files after all but the best of each episode are ignored."""
    done = duplicates.resolved(_files(spark, d))
    return done.select("item_id", "action", "group_type", "season_number", "episode_number", "special_number", "needs_review", "title", F.concat_ws("|", "warnings").alias("warnings"))


@query(
    f"""WITH i AS ({_FILES}), k AS (SELECT *, row_number() OVER (PARTITION BY plan, season_number, episode_number ORDER BY regexp_matches(series_group, '[(]\\d+[)]\\s*$'), lower(replace(real_path, '//', '/')), item_id) AS n, count(*) OVER (PARTITION BY plan, season_number, episode_number) AS variants FROM i)
    SELECT plan, season_number, episode_number, item_id, variants FROM k WHERE n = 1"""
)
def episode_variants(spark: SparkSession, d: str) -> DataFrame:
    """The file of each episode that is shown, of folders named after their series."""
    return duplicates.shown_variants(_files(spark, d).withColumn("work_title", F.lit("")), ["plan", "season_number", "episode_number"])


@query(
    """WITH w AS (SELECT p_partkey AS work_id, CASE p_partkey % 6 WHEN 0 THEN 'work ' ELSE 'Work' END || p_size || CASE p_partkey % 7 WHEN 0 THEN ' S01' WHEN 1 THEN ' season 2' WHEN 2 THEN ' 第 3 季' ELSE '' END AS title, p_partkey % 5 > 0 AS local, p_partkey % 9 AS k, p_partkey % 4 AS n FROM part),
    l AS (SELECT *, lower(replace(title, ' ', '')) AS t, CASE k WHEN 0 THEN '' WHEN 1 THEN '特别篇' WHEN 2 THEN '' WHEN 3 THEN 'Final' ELSE '第' || n || '季' END AS label FROM w),
    c AS (SELECT *, count(*) OVER (PARTITION BY local, t) AS cards FROM l)
    SELECT work_id, CASE WHEN local AND cards > 1 AND label <> '' AND NOT contains(t, lower(label)) AND NOT (starts_with(label, '第') AND regexp_matches(title, '(?i)(S0*' || n || '\\b|Season\\s*0*' || n || '\\b|第\\s*' || n || '\\s*季)')) THEN title || ' ' || label ELSE title END AS title FROM c"""
)
def split_titles(spark: SparkSession, d: str) -> DataFrame:
    """Titles of works that are told apart by their seasons."""
    key, n = F.col("p_partkey"), (F.col("p_partkey") % 4).cast("int")
    end = F.when(key % 7 == 0, " S01").when(key % 7 == 1, " season 2").when(key % 7 == 2, " 第 3 季").otherwise("")
    season = lambda group, label, number: F.struct(F.lit(group).alias("group_type"), F.lit(label).cast("string").alias("label"), number.cast("int").alias("season_number"))
    one, special = season("season", None, n), season("sps", "x", n)
    seasons = F.when(key % 9 == 0, F.array(one, one)).when(key % 9 == 1, F.array(special)).when(key % 9 == 2, None).when(key % 9 == 3, F.array(special, season("season", "Final", n))).otherwise(F.array(one))
    works = table(spark, d, "part").select(
        key.alias("work_id"),
        F.concat(F.when(key % 6 == 0, "work ").otherwise("Work"), F.col("p_size").cast("string"), end).alias("title"),
        F.when(key % 5 > 0, "local").alias("source"),
        F.lit("main_series").alias("card_type"),
        F.lit("tv").alias("media_type"),
        seasons.alias("seasons"),
    )
    return duplicates.split_titles(works).select("work_id", "title")
