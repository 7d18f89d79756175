"""Queries of plan previews and targets. Orders stand for the items of twenty plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.operators import preview
from tallgrass.session import table

from .base import query

# Both engines read this text: the items, from columns of orders.
_ITEMS = f"""SELECT o_custkey % 20 AS plan, o_orderkey AS item_id, o_orderkey AS position, CASE WHEN o_orderkey % 10 = 0 THEN 'subtitle' WHEN o_orderkey % 50 = 1 THEN NULL ELSE 'video' END AS resource_type,
    CASE o_orderkey % 7 WHEN 0 THEN 'ignore' WHEN 1 THEN 'attach_only' ELSE 'generate_strm' END AS action, CASE o_custkey % 9 WHEN 0 THEN 'special' WHEN 1 THEN 'movie' WHEN 2 THEN 'op_ed' WHEN 3 THEN '' WHEN 4 THEN NULL ELSE 'season' END AS group_type,
    CASE WHEN o_orderkey % 11 > 0 THEN o_custkey % 3 END AS season_number, CASE WHEN o_orderkey % 13 > 0 THEN o_orderkey % 400 END AS episode_number, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 4 END AS special_number,
    CASE WHEN o_custkey % 17 = 0 THEN '' ELSE 'w' || (o_custkey % 40) END AS work_id, CASE WHEN o_custkey % 19 = 0 THEN 'C' || (o_custkey % 5) ELSE '' END AS canonical_work_id,
    CASE WHEN o_custkey % 23 = 0 THEN NULL WHEN o_orderkey % 37 = 0 THEN 'Work ' || (o_custkey % 40) || ' Director' WHEN o_orderkey % 3 = 0 THEN '  WORK   ' || (o_custkey % 40) ELSE 'Work ' || (o_custkey % 40) END AS work_title,
    CASE WHEN o_orderkey % 41 = 0 THEN 'Remake' ELSE '' END AS original_title, CASE WHEN o_custkey % 29 = 0 THEN NULL ELSE 'Series ' || (o_custkey % 10) END AS series_group, CASE WHEN o_custkey % 3 = 0 THEN 'standalone' ELSE 'main_series' END AS card_type,
    CASE WHEN o_custkey % 2 = 0 THEN 'movie' ELSE 'tv' END AS media_type, 'anime_series' AS show_type, 'a/' || o_orderkey AS relative_path, CASE WHEN o_orderkey % 31 > 0 THEN 2000 + o_custkey % 5 END AS year,
    CASE o_orderkey % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'high' END AS confidence, CASE WHEN o_orderkey % 9 = 0 THEN 'o' ELSE '' END AS user_override_id, o_orderkey % 4 = 0 AS needs_review,
    CASE WHEN o_orderkey % 16 = 0 THEN split('x{preview.DUPLICATE_MARK}', ',') WHEN o_orderkey % 24 = 0 THEN split('{preview.DUPLICATE_MARK},other', ',') END AS warnings,
    CASE o_custkey % 4 WHEN 0 THEN 'local' WHEN 1 THEN NULL ELSE 'baidu' END AS source, CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE 'card' || (o_custkey % 8) END AS card, 'Title ' || (o_custkey % 10) AS local_title,
    CASE WHEN o_custkey % 6 = 0 THEN 'sub' || (o_orderkey % 2) WHEN o_custkey % 6 = 1 THEN 'sub' END AS subwork, CASE WHEN o_orderkey % 5 = 0 THEN 2010 + o_orderkey % 9 END AS file_year, CASE WHEN o_custkey % 8 > 0 THEN 1990 + o_custkey % 8 END AS own_year FROM orders"""

_TAKEN = "coalesce(resource_type = 'video' AND action = 'generate_strm', false)"
_TITLE = "trim(regexp_replace(lower(coalesce({}, '')), '\\s+', ' ', 'g'))"
_FLAGS = f"""i AS ({_ITEMS}), t AS (SELECT *, coalesce(group_type, '') AS g, {_TAKEN} AS tk, CASE WHEN lower(concat_ws(' ', relative_path, work_title, original_title)) LIKE '%remake%' THEN 'remake' WHEN lower(coalesce(work_title, '')) LIKE '%director%' THEN 'director' ELSE coalesce(year::VARCHAR, '') END AS b,
        {_TITLE.format("work_title")} AS wt, {_TITLE.format("series_group")} AS st FROM i),
    s AS (SELECT *, CASE WHEN tk AND g = 'season' AND season_number IS NOT NULL AND episode_number IS NOT NULL THEN CASE WHEN canonical_work_id <> '' THEN canonical_work_id WHEN wt <> '' THEN wt || '|' || b WHEN st <> '' THEN st || '|' || b ELSE work_id END END AS same FROM t),
    f0 AS (SELECT *, same IS NOT NULL AND count(*) OVER (PARTITION BY plan, same, season_number, episode_number) > 1 AS dup FROM s),
    f AS (SELECT *, tk AND (dup OR (needs_review AND item_id % 16 > 0)) AS rev, tk AND coalesce(confidence, '') = 'low' AND user_override_id = '' AS low, tk AND g = '' AS ung, tk AND coalesce(work_title, '') = '' AS untitled, tk AND g = 'season' AND (season_number IS NULL OR episode_number IS NULL) AS part FROM f0)"""


def _items(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(_ITEMS.replace("FROM orders", "FROM {orders}"), orders=table(spark, d, "orders"))


@query(
    f"""WITH {_FLAGS} SELECT plan, count(*) AS total_items, count(*) FILTER (WHERE resource_type = 'video') AS video_count, count(*) FILTER (WHERE action = 'generate_strm') AS generate_strm_count, count(*) FILTER (WHERE action = 'ignore') AS ignored_count, count(*) FILTER (WHERE action = 'attach_only') AS attach_only_count,
    count(*) FILTER (WHERE low) AS low_confidence_count, count(*) FILTER (WHERE rev) AS needs_review_count, count(*) FILTER (WHERE ung) AS ungrouped_video_count, count(*) FILTER (WHERE dup) AS duplicate_episode_count, count(*) FILTER (WHERE needs_review) AS said_review_count,
    count(DISTINCT CASE WHEN tk AND g NOT IN ('ignored', 'op_ed') THEN CASE WHEN work_id <> '' THEN 'id|' || work_id ELSE 'f|' || card_type || '|' || coalesce(series_group, work_title, '') || '|' || coalesce(year::VARCHAR, '') END END) AS work_count FROM f GROUP BY plan"""
)
def preview_counts(spark: SparkSession, d: str) -> DataFrame:
    """What the preview of each plan counts."""
    return preview.counts(preview.flagged(_items(spark, d)))


@query(
    f"""WITH {_FLAGS} SELECT plan, 'low_confidence' AS code, 'warning' AS level, NULL AS episode_of, item_id FROM f WHERE low UNION ALL SELECT plan, 'needs_review', 'warning', NULL, item_id FROM f WHERE rev UNION ALL SELECT plan, 'ungrouped_video', 'warning', NULL, item_id FROM f WHERE ung
    UNION ALL SELECT plan, 'duplicate_episode', 'error', same, item_id FROM f WHERE dup UNION ALL SELECT plan, 'missing_work_title', 'error', NULL, item_id FROM f WHERE untitled UNION ALL SELECT plan, 'missing_group_type', 'error', NULL, item_id FROM f WHERE ung UNION ALL SELECT plan, 'season_incomplete', 'error', NULL, item_id FROM f WHERE part"""
)
def preview_issues(spark: SparkSession, d: str) -> DataFrame:
    """The items of each issue."""
    return preview.issues(preview.flagged(_items(spark, d))).select("plan", "code", "level", "episode_of", "item_id")


@query(
    f"""WITH i AS ({_ITEMS}) SELECT plan, work_id, card_type, group_type, season_number, count(*) AS item_count, arg_min(coalesce(work_title, '-'), position) AS work_title, arg_min(coalesce(year, -1), position) AS year, arg_min(media_type, position) AS media_type, arg_min(coalesce(series_group, '-'), position) AS series_group
    FROM i WHERE resource_type = 'video' AND action = 'generate_strm' GROUP BY ALL"""
)
def preview_groups(spark: SparkSession, d: str) -> DataFrame:
    """Items by plan, work, card, group and season; null titles as '-', null years as -1."""
    g = preview.groups(_items(spark, d)).drop("show_type")
    return g.withColumns({"work_title": F.coalesce("work_title", F.lit("-")), "series_group": F.coalesce("series_group", F.lit("-")), "year": F.coalesce("year", F.lit(-1))})


@query(
    f"""WITH i AS ({_ITEMS}), r AS (SELECT plan, coalesce(resource_type, '') AS k, count(*) AS n FROM i GROUP BY ALL), a AS (SELECT plan, action AS k, count(*) AS n FROM i GROUP BY ALL)
    SELECT plan, by_resource_type, by_action FROM (SELECT plan, string_agg(k || '=' || n, ',' ORDER BY k) AS by_resource_type FROM r GROUP BY 1) JOIN (SELECT plan, string_agg(k || '=' || n, ',' ORDER BY k) AS by_action FROM a GROUP BY 1) USING (plan)"""
)
def plan_kinds(spark: SparkSession, d: str) -> DataFrame:
    """How many items of each kind and action a plan has."""
    flat = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias(c)
    return preview.kinds(_items(spark, d)).select("plan", flat("by_resource_type"), flat("by_action"))


@query(
    f"""WITH i AS (SELECT * REPLACE (coalesce(card, '') AS card, coalesce(source, '') AS source, coalesce(series_group, '') AS series_group) FROM ({_ITEMS})), v AS (SELECT * FROM i WHERE resource_type = 'video' AND action = 'generate_strm' AND group_type IN ('season', 'special', 'movie')),
    s AS (SELECT *, CASE group_type WHEN 'movie' THEN NULL WHEN 'special' THEN coalesce(season_number, 0) ELSE season_number END AS sn FROM v WHERE NOT (group_type = 'special' AND media_type = 'movie' AND (plan, card) IN (SELECT (plan, card) FROM v WHERE group_type = 'movie'))),
    g AS (SELECT plan, source, canonical_work_id, series_group, local_title, group_type, sn AS season_number, card, count(*) AS item_count, arg_min(work_id, position) AS work_id, arg_min(coalesce(year, -1), position) AS first_year, arg_min(coalesce(own_year, -1), position) AS own, min(file_year) AS fy, bool_or(needs_review) AS nr,
        count(DISTINCT CASE WHEN coalesce(episode_number, special_number) IS NOT NULL THEN coalesce(season_number, sn, -1) || '/' || coalesce(episode_number, special_number) END) AS episode_count, CASE WHEN count(DISTINCT subwork) = 1 THEN min(subwork) ELSE '' END AS subwork FROM s GROUP BY plan, source, canonical_work_id, series_group, local_title, group_type, sn, card)
    SELECT substr(sha1(concat_ws(':', source, canonical_work_id, series_group, local_title, group_type, CASE WHEN season_number > 0 THEN season_number::VARCHAR ELSE '' END, CASE WHEN group_type = 'movie' THEN 'movie' ELSE 'tv' END, card)), 1, 16) AS target_id, plan, season_number, work_id, first_year, subwork,
        CASE WHEN group_type = 'season' AND fy IS NOT NULL THEN fy WHEN own >= 0 THEN own END AS scrape_year, nr OR (own < 0 AND (group_type <> 'season' OR fy IS NULL)) AS needs_review, item_count, episode_count, CASE group_type WHEN 'season' THEN 0 WHEN 'special' THEN 1 ELSE 2 END AS group_place FROM g"""
)
def scrape_targets(spark: SparkSession, d: str) -> DataFrame:
    """The targets of all plans."""
    t = preview.targets(_items(spark, d)).withColumn("first_year", F.coalesce("first_year", F.lit(-1)))
    return t.select("target_id", "plan", "season_number", "work_id", "first_year", "subwork", "scrape_year", "needs_review", "item_count", "episode_count", "group_place")
