"""Queries of library reads: filters, summaries, dedup and likeness. Parts stand for works, brands for sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallgrass.operators import library
from tallgrass.session import stored, table

from .base import query

_S = "CASE p_size % 5 WHEN 0 THEN 'pan115' WHEN 1 THEN 'baidu' WHEN 2 THEN 'local' WHEN 3 THEN 'openlist' ELSE 'zdisk' END"
_WORKS = f"""SELECT p_partkey AS work_id, p_name AS title, p_type AS original_title, {_S} AS source, CASE WHEN p_partkey % 2 = 0 THEN [{_S}, 'local'] ELSE [] END AS sources, CASE WHEN p_size % 2 = 0 THEN 'tv' ELSE 'movie' END AS media_type, p_brand AS show_type,
    CASE p_partkey % 4 WHEN 0 THEN 'ready' WHEN 1 THEN 'waiting_review' WHEN 2 THEN 'waiting_metadata' ELSE 'ready' END AS state, p_partkey % 3 > 0 AS complete, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_retailprice END AS rating, CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE 1990 + p_size % 30 END AS year, p_size AS n_episodes, CASE WHEN p_partkey % 6 = 0 THEN '' ELSE 'p' END AS poster FROM part"""


def _works(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "part").createOrReplaceTempView("part_as_works")
    return spark.sql(_WORKS.replace("[]", "array()").replace("[", "array(").replace("]", ")").replace("FROM part", "FROM part_as_works"))


@query(f"WITH w AS ({_WORKS}) SELECT work_id FROM w WHERE (contains(lower(title), 'an') OR contains(lower(original_title), 'an')) AND (source = 'local' OR list_contains(sources, 'local')) AND media_type = 'tv'")
def library_query(spark: SparkSession, d: str) -> DataFrame:
    return library.matching(_works(spark, d), q=" AN ", source="local", media_type="tv").select("work_id")


@query(f"WITH w AS ({_WORKS}) SELECT work_id, state FROM w WHERE state IN ('waiting_review', 'source_unavailable') OR state = 'ready' OR work_id IN (SELECT ps_ FROM (SELECT DISTINCT l_partkey AS ps_ FROM lineitem WHERE l_quantity > 49))")
def visible_works(spark: SparkSession, d: str) -> DataFrame:
    named = table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("work_id"))
    return library.visible(_works(spark, d), named).select("work_id", "state")


@query("SELECT p_partkey AS work_id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def watch_status(spark: SparkSession, d: str) -> DataFrame:
    status = table(spark, d, "lineitem").select(F.col("l_partkey").alias("work_id"), F.when(F.col("l_returnflag") == "R", "seen").otherwise("").alias("status"))
    return library.with_watch_status(_works(spark, d), status, "empty").select("work_id")


@query(
    f"""WITH w AS ({_WORKS}), e AS (SELECT unnest(CASE WHEN len(sources) = 0 THEN [source] ELSE list_distinct(sources) END) AS source, n_episodes, poster, state FROM w)
    SELECT source, count(*) AS works, CAST(sum(n_episodes) AS BIGINT) AS episodes, count(*) FILTER (poster <> '') AS posters, count(*) FILTER (state = 'ready') AS scraped FROM e GROUP BY 1"""
)
def works_by_source(spark: SparkSession, d: str) -> DataFrame:
    return library.source_summary(_works(spark, d).withColumn("fanart", F.lit(None).cast("string"))).drop("fanarts")


@query(
    f"""WITH w AS (SELECT *, CASE work_id % 5 WHEN 0 THEN 'completed' WHEN 1 THEN 'tracking' WHEN 2 THEN 'paused' ELSE NULL END AS tracking, CASE WHEN work_id % 7 = 0 THEN 'seasonal' ELSE '' END AS scope, CASE show_type WHEN 'Brand#11' THEN 'anime_series' WHEN 'Brand#12' THEN 'anime_movie' ELSE 'live_series' END AS kind FROM ({_WORKS})),
    s AS (SELECT *, CASE WHEN tracking = 'completed' THEN false WHEN tracking IN ('tracking', 'paused') THEN true ELSE scope = 'seasonal' END AS seasonal FROM w)
    SELECT count(*) FILTER (seasonal) AS seasonal, count(*) FILTER (kind = 'anime_series' AND NOT seasonal) AS anime_series, count(*) FILTER (kind = 'anime_movie') AS anime_movie, count(*) FILTER (kind = 'live_series') AS live_series, count(*) FILTER (kind = 'live_movie') AS live_movie FROM s"""
)
def category_views(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("work_id") % 5
    w = _works(spark, d).withColumn("tracking", F.when(k == 0, "completed").when(k == 1, "tracking").when(k == 2, "paused")).withColumn("scope", F.when(F.col("work_id") % 7 == 0, "seasonal").otherwise(""))
    show = F.when(F.col("show_type") == "Brand#11", "anime_series").when(F.col("show_type") == "Brand#12", "anime_movie").otherwise("live_series")
    seasonal = library.is_seasonal("scope", "tracking")
    return w.agg(*(F.count_if(library.in_category(show, seasonal, v)).alias(v) for v in ("seasonal", "anime_series", "anime_movie", "live_series", "live_movie")))


@query(
    f"""WITH w AS ({_WORKS}), s AS (SELECT 'titleDesc' AS o, work_id, row_number() OVER (ORDER BY lower(title) DESC, lower(title), work_id) AS place FROM w UNION ALL SELECT 'ratingAsc', work_id, row_number() OVER (ORDER BY coalesce(rating, 0), lower(title), work_id) FROM w
    UNION ALL SELECT 'yearDesc', work_id, row_number() OVER (ORDER BY coalesce(year, 0) DESC, lower(title), work_id) FROM w UNION ALL SELECT 'yearAsc', work_id, row_number() OVER (ORDER BY coalesce(year, 9999), lower(title), work_id) FROM w UNION ALL SELECT 'episodesDesc', work_id, row_number() OVER (ORDER BY n_episodes DESC, lower(title), work_id) FROM w)
    SELECT o, work_id FROM s WHERE place <= 20"""
)
def sort_orders(spark: SparkSession, d: str) -> DataFrame:
    """The first page of each order."""
    w, out = _works(spark, d), None
    for o in ("titleDesc", "ratingAsc", "yearDesc", "yearAsc", "episodesDesc"):
        page = w.orderBy(*library.sort_key(o)).limit(20).select(F.lit(o).alias("o"), "work_id")
        out = page if out is None else out.unionByName(page)
    return out


@query(
    f"""WITH w AS ({_WORKS}), r AS (SELECT l_partkey AS work_id, min(l_orderkey) AS recent_rank FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), t AS (SELECT p_partkey AS work_id, p_type AS related FROM part WHERE p_partkey % 3 = 0)
    SELECT work_id, recent_rank, rating FROM w LEFT JOIN r USING (work_id) LEFT JOIN t USING (work_id) WHERE contains(lower(concat_ws(' ', nullif(title, ''), nullif(original_title, ''), related)), 'an') AND (source = 'local' OR list_contains(sources, 'local'))"""
)
def search_rank(spark: SparkSession, d: str) -> DataFrame:
    """All local works whose own or related titles hold a word."""
    recent = table(spark, d, "lineitem").where("l_returnflag = 'A'").groupBy(F.col("l_partkey").alias("work_id")).agg(F.min("l_orderkey").alias("recent_rank"))
    titles = table(spark, d, "part").where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("work_id"), F.array("p_type").alias("related_titles"))
    return library.searched(_works(spark, d).join(titles, "work_id", "left"), " An ", recent, "local")


@query(
    f"""WITH w AS (SELECT work_id, row_number() OVER (ORDER BY coalesce(rating, 0) DESC, lower(title), work_id) - 1 AS i FROM ({_WORKS}))
    SELECT work_id, 'featured' AS part, i::INT AS slot FROM w WHERE i < 5 UNION ALL SELECT work_id, 'side', (i - 5)::INT FROM w WHERE i BETWEEN 5 AND 7"""
)
def featured_side(spark: SparkSession, d: str) -> DataFrame:
    return library.showcase(_works(spark, d), library.sort_key("ratingDesc"))


@query(
    """WITH w AS (SELECT p_partkey AS work_id, p_brand AS show_type, coalesce(p_retailprice, 0) AS rating, list_distinct(string_split(lower(p_name), ' ')) AS tags FROM part), e AS (SELECT work_id, unnest(tags) AS tag FROM w),
    s AS (SELECT a.work_id, b.work_id AS other, 3 * count(*) AS points FROM e a JOIN e b USING (tag) WHERE a.work_id <> b.work_id GROUP BY 1, 2), p AS (SELECT work_id, other, points FROM s UNION ALL SELECT a.work_id, b.work_id, 0 FROM w a JOIN w b USING (show_type) WHERE a.work_id <> b.work_id),
    q AS (SELECT work_id, other, max(points) AS points FROM p GROUP BY 1, 2), r AS (SELECT q.work_id, other, points + CASE WHEN a.show_type = b.show_type THEN 2 ELSE 0 END AS score, b.rating FROM q JOIN w a ON a.work_id = q.work_id JOIN w b ON b.work_id = other)
    SELECT work_id, other, score, row_number() OVER (PARTITION BY work_id ORDER BY score DESC, rating DESC, other) AS place FROM r QUALIFY place <= 6"""
)
def similar_topk(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "part").select(F.col("p_partkey").alias("work_id"), F.col("p_brand").alias("show_type"), F.split("p_name", " ").alias("tags"), F.col("p_retailprice").alias("rating"))
    return library.similar(w).withColumn("place", F.col("place").cast("long"))


@query(
    """WITH e AS (SELECT DISTINCT p_partkey AS work_id, 0 AS rank, p_name AS name FROM part UNION SELECT p_partkey, 1, p_type || p_brand || p_size FROM part), p AS (SELECT a.work_id, b.work_id AS other, a.rank FROM e a JOIN e b ON a.rank = b.rank AND a.name = b.name WHERE a.work_id <> b.work_id)
    SELECT work_id, other, min(rank) AS relation, count(*) AS shared FROM p GROUP BY 1, 2"""
)
def related_overlap(spark: SparkSession, d: str) -> DataFrame:
    keys = F.array(F.struct(F.lit(0).alias("rank"), F.col("p_name").alias("name")), F.struct(F.lit(1).alias("rank"), F.concat("p_type", "p_brand", F.col("p_size").cast("string")).alias("name")))
    return library.related(table(spark, d, "part").select(F.col("p_partkey").alias("work_id"), keys.alias("keys")), "keys", lambda rows: stored(rows, "related"))


_EP = "SELECT l_orderkey AS work_id, CASE WHEN l_linenumber > 4 THEN 'special' ELSE 'season' END AS group_type, l_suppkey % 2 AS season, CASE WHEN l_linenumber = 7 THEN 0 ELSE l_linenumber % 3 END AS episode, l_linenumber AS episode_id, CASE l_returnflag WHEN 'A' THEN 'local' WHEN 'N' THEN 'pan115' ELSE 'other' END AS source FROM lineitem"


def _eps(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "lineitem").createOrReplaceTempView("lineitem_as_episodes")
    return spark.sql(_EP.replace("FROM lineitem", "FROM lineitem_as_episodes"))


@query(f"SELECT work_id, group_type, season, episode, episode_id FROM ({_EP}) QUALIFY row_number() OVER (PARTITION BY work_id, group_type, season, episode, CASE WHEN episode > 0 THEN '' ELSE episode_id::VARCHAR END ORDER BY CASE source WHEN 'pan115' THEN 0 WHEN 'local' THEN 2 ELSE 99 END, episode_id) = 1")
def dedup_episode(spark: SparkSession, d: str) -> DataFrame:
    return library.merged_episodes(_eps(spark, d)).select("work_id", "group_type", "season", "episode", "episode_id")


@query(
    f"""WITH e AS ({_EP}), s AS (SELECT *, CASE WHEN group_type = 'special' AND season = 1 THEN 'sps' ELSE group_type END AS g FROM e), n AS (SELECT work_id, group_type, season, count(*) AS n FROM e GROUP BY 1, 2, 3)
    SELECT s.work_id, g AS group_type, s.season, arg_min('t' || episode_id, (source <> 'local', episode_id % 2 <> 0, -episode, 't' || episode_id)) AS title, bool_or(source = 'local') AS scraped, any_value(n) AS episode_count FROM s JOIN n ON n.work_id = s.work_id AND n.season = s.season AND n.group_type = s.group_type GROUP BY 1, 2, 3"""
)
def merge_seasons(spark: SparkSession, d: str) -> DataFrame:
    """Seasons of all orders; some of the specials' under their other name."""
    e = _eps(spark, d)
    group = F.when((F.col("group_type") == "special") & (F.col("season") == 1), "sps").otherwise(F.col("group_type"))
    seasons = e.select("work_id", group.alias("group_type"), "season", F.concat(F.lit("t"), "episode_id").alias("title"), (F.col("source") == "local").alias("scraped"), F.when(F.col("episode_id") % 2 == 0, F.col("episode_id")).alias("tmdb_id"), F.col("episode").alias("episode_count"))
    return library.merged_seasons(seasons, e)


@query(
    """WITH c AS (SELECT c_nationkey, c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS title, CASE WHEN c_custkey % 5 < 4 THEN NULL ELSE c_mktsegment END AS plot FROM customer)
    SELECT c_nationkey, arg_min(title, c_custkey) FILTER (title <> '') AS title, arg_min(plot, c_custkey) FILTER (plot <> '') AS plot FROM c GROUP BY 1"""
)
def merge_first_nonempty(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_nationkey", "c_custkey", F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_name")).alias("title"), F.when(F.col("c_custkey") % 5 >= 4, F.col("c_mktsegment")).alias("plot"))
    return library.first_non_empty(c, "c_nationkey", ["title", "plot"], [F.col("c_custkey").asc()])


@query(
    f"""WITH w AS ({_WORKS}) SELECT show_type, CASE min(CASE state WHEN 'ready' THEN 0 WHEN 'waiting_review' THEN 1 ELSE 3 END) WHEN 0 THEN 'ready' WHEN 1 THEN 'waiting_review' ELSE 'waiting_metadata' END AS state FROM (SELECT show_type || work_id % 50 AS show_type, state FROM w) GROUP BY 1"""
)
def merged_states(spark: SparkSession, d: str) -> DataFrame:
    w = _works(spark, d).withColumn("show_type", F.concat("show_type", (F.col("work_id") % 50).cast("string")))
    return library.merged_state(w, "show_type", "state")


@query("SELECT l_orderkey, bool_and(l_linestatus = 'F') AS ready, count(*) AS targets FROM lineitem GROUP BY 1")
def targets_complete(spark: SparkSession, d: str) -> DataFrame:
    return library.ready_works(table(spark, d, "lineitem"), "l_orderkey", F.col("l_linestatus") == "F")


@query(f"SELECT show_type, arg_max(work_id, (complete, n_episodes, work_id)) AS work_id FROM ({_WORKS}) GROUP BY 1")
def dedup_works(spark: SparkSession, d: str) -> DataFrame:
    """The most complete work of each key, the later of equal ones."""
    return library.deduplicated(_works(spark, d), F.col("show_type"), [F.col("complete"), F.col("n_episodes")], "work_id").select("show_type", "work_id")


@query(
    """WITH w AS (SELECT l_orderkey AS work_id, list_sort(list_distinct(list(l_returnflag))) AS sources, count(*) FILTER (l_returnflag <> 'N') AS n FROM lineitem GROUP BY 1) SELECT work_id, array_to_string(list_filter(sources, lambda s: s <> 'N'), ',') AS sources, n AS n_episodes FROM w WHERE n > 0"""
)
def source_removed(spark: SparkSession, d: str) -> DataFrame:
    """Works without what one source gave."""
    w = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("work_id")).agg(F.array_sort(F.collect_set("l_returnflag")).alias("sources"), F.collect_list(F.struct(F.col("l_returnflag").alias("source"), "l_linenumber")).alias("episodes"))
    w = w.withColumn("counts", F.map_from_entries(F.transform("sources", lambda s: F.struct(s, F.lit(1)))))
    return library.without_source(w, "N").select("work_id", F.array_join("sources", ",").alias("sources"), F.size("episodes").cast("long").alias("n_episodes"))


@query("WITH n AS (SELECT l_suppkey, l_orderkey, l_returnflag AS s, count(*) AS n FROM lineitem GROUP BY 1, 2, 3), m AS (SELECT l_suppkey, s, max(n) AS n FROM n GROUP BY 1, 2) SELECT l_suppkey, string_agg(s || '=' || n, ',' ORDER BY s) AS counts FROM m GROUP BY 1")
def best_counts(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "lineitem").groupBy("l_suppkey", "l_orderkey", "l_returnflag").agg(F.count("*").alias("n"))
    maps = n.groupBy("l_suppkey", "l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("l_returnflag", "n"))).alias("counts"))
    out = library.best_counts(maps, "l_suppkey", "counts")
    return out.select("l_suppkey", F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("counts"))


@query("SELECT DISTINCT l_orderkey AS work_id, l_linenumber AS episode_id FROM lineitem WHERE (l_quantity > 30 OR l_returnflag = 'A' OR l_tax > 0.05) AND NOT (l_orderkey, l_linenumber) IN (SELECT (l_orderkey, l_linenumber) FROM lineitem WHERE l_discount > 0.08)")
def watched_set(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "lineitem").withColumnsRenamed({"l_orderkey": "work_id", "l_linenumber": "episode_id"})
    return library.watched(e.where("l_quantity > 30"), e.where("l_returnflag = 'A'"), e.where("l_tax > 0.05"), e.where("l_discount > 0.08"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) THEN 'stale' WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'done' END AS status FROM orders")
def review_pruning(spark: SparkSession, d: str) -> DataFrame:
    reviews = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("target_id"), F.when(F.col("o_orderstatus") == "O", "pending").otherwise("done").alias("status"))
    return library.pruned_reviews(reviews, table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("target_id"))).select("o_orderkey", "status")


@query(
    """WITH e AS (SELECT conv_id, count(*) FILTER (role = 'user') AS u, count(*) FILTER (role = 'assistant') AS a FROM conversations GROUP BY 1) SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 7 WHEN u > 0 THEN u * 2 ELSE a END AS n FROM e"""
)
def main_episode_count(spark: SparkSession, d: str) -> DataFrame:
    """Turns as seasons (of the user, with two episodes each) and episodes."""
    c = table(spark, d, "conversations")
    of = lambda role, group: F.collect_list(F.when(F.col("role") == role, F.struct(F.lit(group).alias("group_type"), F.lit(2).alias("episode_count"))))
    g = c.groupBy("conv_id").agg(of("user", "season").alias("seasons"), of("assistant", "season").alias("episodes"))
    return g.select("conv_id", library.main_episodes(F.when(F.col("conv_id") % 3 == 0, 7), "seasons", "episodes").alias("n"))


@query("SELECT o_custkey, o_orderkey, max(o_totalprice) OVER (PARTITION BY o_custkey) = o_totalprice AS is_latest FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 3")
def latest_revisions(spark: SparkSession, d: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc()))
    most = F.max("o_totalprice").over(Window.partitionBy("o_custkey"))
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", (most == F.col("o_totalprice")).alias("is_latest"), n.alias("n")).where("n <= 3").drop("n")
