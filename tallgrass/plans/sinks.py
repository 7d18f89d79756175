"""Queries of what is written, and of identities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.functions import identity
from tallgrass.session import table
from tallgrass.sources import mirror, scans

from .base import query


@query(
    """WITH i AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey % 100 AS w, l_linenumber AS e, l_linenumber % 4 AS g, 'p/' || l_orderkey || '/' || l_linenumber AS path FROM lineitem),
    t AS (SELECT *, CASE g WHEN 0 THEN '/m/W' || w WHEN 1 THEN '/m/W' || w || '/Season 2' WHEN 2 THEN '/m/W' || w || '/SPs' ELSE '/m/W' || w END AS folder, CASE g WHEN 0 THEN 'W' || w || ' (2005)' WHEN 1 THEN 'W' || w || ' - S02E' || lpad(e::VARCHAR, 2, '0') WHEN 2 THEN 'SP' || e ELSE 'W' || w END AS name FROM i),
    r AS (SELECT *, row_number() OVER (PARTITION BY folder, name ORDER BY path, id) AS n FROM t)
    SELECT id, folder || '/' || name || CASE WHEN n > 1 THEN ' - ' || 'SP' || e || ' ' || left(sha1(path), 8) ELSE '' END || '.strm' AS target FROM r"""
)
def mirror_targets(spark: SparkSession, d: str) -> DataFrame:
    g = F.col("l_linenumber") % 4
    group = F.when(g == 0, "movie").when(g == 1, "season").when(g == 2, "special").otherwise("other")
    items = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), group.alias("group_type"), F.concat(F.lit("W"), (F.col("l_orderkey") % 100).cast("string")).alias("work_title"), F.lit(None).cast("string").alias("title"), F.lit(2).alias("season"), F.col("l_linenumber").alias("episode"), F.lit(2005).alias("year"), F.concat(F.lit("p/"), "l_orderkey", F.lit("/"), "l_linenumber").alias("path"), F.concat(F.lit("SP"), "l_linenumber", F.lit(".mkv")).alias("name"))
    return mirror.targets(items, F.lit("/m"))


@query("SELECT l_orderkey * 10 + l_linenumber AS id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey::VARCHAR, l_orderkey * 10 + l_linenumber) AS n FROM lineitem WHERE l_returnflag <> 'N'")
def stable_sequence(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_suppkey", "l_returnflag", F.col("l_orderkey").cast("string").alias("path"))
    return mirror.sequence(items, "l_suppkey", F.col("l_returnflag") != "N", "path").withColumn("n", F.col("n").cast("long"))


@query(
    """SELECT p_partkey, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' || chr(10) || '<tvshow>' || chr(10) || '  <title>' || p_name || '</title>' || chr(10) || CASE WHEN p_size % 2 = 0 THEN '  <year>' || p_size || '</year>' || chr(10) ELSE '' END || '  <genre>a &amp; b</genre>' || chr(10) || '  <genre>' || p_brand || '</genre>' || chr(10) || '</tvshow>' || chr(10) AS xml FROM part"""
)
def side_files(spark: SparkSession, d: str) -> DataFrame:
    fields = {"title": F.col("p_name"), "year": F.when(F.col("p_size") % 2 == 0, F.col("p_size")), "plot": F.lit("")}
    return table(spark, d, "part").select("p_partkey", mirror.side_file("tvshow", fields, {"genre": F.array(F.lit("a & b"), F.lit(""), "p_brand"), "studio": F.lit(None).cast("array<string>")}).alias("xml"))


@query("SELECT p_name, CAST(p_size % 7 AS INT) AS year FROM part")
def side_file_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """What is written is what is read."""
    xml = mirror.side_file("movie", {"title": F.col("p_name"), "year": (F.col("p_size") % 7).cast("string")}, {})
    files = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("file"), F.encode(xml, "UTF-8").alias("content"))
    return scans.xml_files(files).select(F.col("title").alias("p_name"), "year")


@query(
    """WITH r AS (SELECT event_id, row_number() OVER w AS n, sum(user_id) OVER w AS b FROM events WINDOW w AS (ORDER BY epoch_us(ts) // 1000000 DESC, event_id DESC ROWS UNBOUNDED PRECEDING)) SELECT event_id FROM r WHERE n > 600 OR b > 9000"""
)
def cache_eviction(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.unix_timestamp("ts").alias("used"), "user_id")
    return mirror.evicted(e, "event_id", "used", "user_id", 600, 9000)


@query(
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'remake' WHEN 1 THEN '导演版' ELSE (2000 + user_id % 20)::VARCHAR END AS bucket, CASE event_id % 3 WHEN 0 THEN 'front' WHEN 1 THEN 'back' ELSE '' END AS part, CASE event_id % 3 WHEN 0 THEN 'ncop' WHEN 1 THEN 'sp' ELSE 'main' END AS kind, 'show ' || user_id AS related, CASE WHEN event_id % 2 = 0 THEN 'source:baidu:a/show ' || user_id ELSE 'source:baidu:w' || user_id END AS card FROM events"""
)
def identities(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    k3, k4, user = F.col("event_id") % 3, F.col("event_id") % 4, F.col("user_id").cast("string")
    name = F.concat(F.lit("show "), user)
    text = F.when(k4 == 0, "A Remake").when(k4 == 1, "A 导演版 director").otherwise("A")
    title = F.when(k3 == 0, F.lit("Film Part 1")).when(k3 == 1, F.lit("Film 后篇")).otherwise("Film")
    group, mark = F.when(k3 == 0, "auxiliary").when(k3 == 1, "special").otherwise("season"), F.when(k3 == 0, "NCOP1").otherwise("x")
    path = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("A/"), name, F.lit("/S1/x.mkv"))).otherwise("Season 1/x.mkv")
    return e.select("event_id", identity.version_bucket(text, 2000 + F.col("user_id") % 20).alias("bucket"), identity.part_marker(title).alias("part"), identity.kind(group, mark).alias("kind"), identity.related_title(F.concat(name, F.lit(" 剧场版 [x]"))).alias("related"), identity.card(F.lit("baidu"), path, F.lit(False), F.concat(F.lit("W"), user)).alias("card"))
