"""Queries of the library over the driver tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallgrass.operators import rank, relate
from tallgrass.session import table

from . import cards, catalog, duplicates, matches, media, merges, previews, sequences, shelves, sinks, trees, watches, works  # noqa: F401
from .base import QUERIES, SQL, query

FLAGSHIP = "recent_priority"

@query(
    """WITH h AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS i FROM events)
    SELECT user_id, event_type, min(i) AS first_index, count(*) AS play_count, 12.0::DOUBLE / (1 + min(i)) + 4 * least(count(*), 4) AS score FROM h GROUP BY 1, 2"""
)
def recent_priority(spark: SparkSession, d: str) -> DataFrame:
    return rank.recent_priority(table(spark, d, "events"), "event_type", "ts", "event_id", "user_id").withColumn("first_index", F.col("first_index").cast("long"))


def _recent(spark: SparkSession, d: str, last: bool) -> DataFrame:
    order = [F.col("ts").desc(), F.col("event_id").desc()]
    return rank.recent_rank(table(spark, d, "events"), "event_type", "user_id", order, last).withColumn("recent_rank", F.col("recent_rank").cast("long"))


_RECENT_SQL = "SELECT user_id, event_type, {}(i) AS recent_rank FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS i FROM events) GROUP BY 1, 2"


@query(_RECENT_SQL.format("min"))
def recent_rank_first(spark: SparkSession, d: str) -> DataFrame:
    return _recent(spark, d, False)


@query(_RECENT_SQL.format("max"))
def recent_rank_last(spark: SparkSession, d: str) -> DataFrame:
    return _recent(spark, d, True)


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def continue_item(spark: SparkSession, d: str) -> DataFrame:
    return rank.keep_best(table(spark, d, "events"), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", "event_id", "event_type", "value")


@query("SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def history_page(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(50).select("event_id", "user_id", "event_type")


@query(
    """WITH m AS (SELECT l_orderkey, l_linenumber, l_quantity, max(l_quantity) OVER (PARTITION BY l_orderkey) AS most FROM lineitem)
    SELECT l_orderkey, l_linenumber, least(l_quantity / most, 1.0) AS ratio, max(CASE WHEN l_quantity * 10 >= most * 9 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) = 1 AS completed FROM m"""
)
def progress_state(spark: SparkSession, d: str) -> DataFrame:
    """Progress ratio and sticky completion: once done, always done."""
    rows = table(spark, d, "lineitem").withColumn("most", F.max("l_quantity").over(Window.partitionBy("l_orderkey")))
    done = F.max((F.col("l_quantity") * 10 >= F.col("most") * 9).cast("int")).over(Window.partitionBy("l_orderkey").orderBy("l_linenumber"))
    return rows.select("l_orderkey", "l_linenumber", F.least(F.col("l_quantity") / F.col("most"), F.lit(1.0)).alias("ratio"), (done == 1).alias("completed"))


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE contains(lower(p_name), 'an') AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#13')")
def library_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where(F.lower("p_name").contains("an") & F.col("p_brand").isin("Brand#11", "Brand#12", "Brand#13")).select("p_partkey", "p_name", "p_brand")


@query(
    """SELECT count(*) AS n_works, count(*) FILTER (p_size > 25) AS n_large, count(*) FILTER (p_retailprice IS NULL) AS n_unrated, count(DISTINCT p_brand) AS n_sources FROM part"""
)
def library_totals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").agg(F.count("*").alias("n_works"), F.count_if(F.col("p_size") > 25).alias("n_large"), F.count_if(F.col("p_retailprice").isNull()).alias("n_unrated"), F.countDistinct("p_brand").alias("n_sources"))


@query("SELECT p_type, count(*) AS n, count(*) FILTER (p_size <= 10) AS n_small, count(*) FILTER (p_size > 10) AS n_rest FROM part GROUP BY p_type")
def category_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy("p_type").agg(F.count("*").alias("n"), F.count_if(F.col("p_size") <= 10).alias("n_small"), F.count_if(F.col("p_size") > 10).alias("n_rest"))


@query("SELECT l_shipmode, count(*) AS n FROM (SELECT unnest([l_returnflag, l_linestatus]) AS l_shipmode FROM lineitem) GROUP BY 1")
def source_summary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.explode(F.array("l_returnflag", "l_linestatus")).alias("l_shipmode")).groupBy("l_shipmode").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY coalesce(o_totalprice, 0) DESC, o_orderkey LIMIT 20")
def sort_null_sentinels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").orderBy(rank.sort_nulls_as("o_totalprice", 0.0, False), "o_orderkey").limit(20).select("o_orderkey", "o_totalprice")


@query("SELECT p_brand, p_partkey, p_retailprice FROM part WHERE trim(p_name) <> '' QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY coalesce(p_retailprice, 0) DESC, p_partkey) <= 5")
def home_topk(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("p_brand").orderBy(rank.sort_nulls_as("p_retailprice", 0.0, False), "p_partkey")
    return table(spark, d, "part").where(F.trim("p_name") != "").withColumn("_n", F.row_number().over(order)).where("_n <= 5").select("p_brand", "p_partkey", "p_retailprice")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END, l_linenumber, l_partkey, l_suppkey) = 1")
def dedup_best(spark: SparkSession, d: str) -> DataFrame:
    priority = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return rank.keep_best(table(spark, d, "lineitem"), ["l_orderkey"], [priority.asc(), F.col("l_linenumber").asc(), F.col("l_partkey").asc(), F.col("l_suppkey").asc()]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT l_orderkey, count(*) AS n_episodes, max(l_linenumber) AS last_episode, max(l_linenumber) = count(DISTINCT l_linenumber) AS gap_free FROM lineitem GROUP BY 1")
def seasons_from_episodes(spark: SparkSession, d: str) -> DataFrame:
    grouped = table(spark, d, "lineitem").groupBy("l_orderkey")
    return grouped.agg(F.count("*").alias("n_episodes"), F.max("l_linenumber").alias("last_episode"), (F.max("l_linenumber") == F.countDistinct("l_linenumber")).alias("gap_free"))


@query(
    """WITH s AS (SELECT l_suppkey, year(l_shipdate) AS season, count(*) AS n FROM lineitem GROUP BY 1, 2)
    SELECT l_suppkey, season, n, CAST(sum(n) OVER (PARTITION BY l_suppkey ORDER BY season) AS BIGINT) AS last_place, CAST(sum(n) OVER (PARTITION BY l_suppkey ORDER BY season) - n + 1 AS BIGINT) AS first_place FROM s"""
)
def cumulative_boundary(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "lineitem").groupBy("l_suppkey", F.year("l_shipdate").cast("long").alias("season")).agg(F.count("*").alias("n"))
    return rank.running_bounds(parts, "l_suppkey", "season", "n")


@query("SELECT o_orderkey, o_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus IN ('O', 'F')")
def current_revision_join(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").where(F.col("o_orderstatus").isin("O", "F"))
    return orders.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_custkey", "c_name")


@query("SELECT o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS n_returned FROM orders")
def correlated_count(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return table(spark, d, "orders").join(counts, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n_returned"))


_PATH_SQL = "concat('/', trim(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/'))"


def _paths(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("/"), F.btrim(F.regexp_extract("url", r"^[a-z]+://[^/?#]+([^?#]*)", 1), F.lit("/")))
    return table(spark, d, "pages").select("page_id", path.alias("path"), F.length("html").alias("n"))


@query(f"WITH p AS (SELECT {_PATH_SQL} AS path, length(html) AS n FROM pages) SELECT path, bool_and(n > 1000) AS closed, count(*) AS n_nodes FROM (SELECT DISTINCT a.path AS path, b.path AS q, b.n, b.rowid_ FROM (SELECT DISTINCT path FROM p WHERE path <> '/') a JOIN (SELECT *, row_number() OVER () AS rowid_ FROM p) b ON b.path = a.path OR starts_with(b.path, a.path || '/')) GROUP BY path")
def subtree_closed(spark: SparkSession, d: str) -> DataFrame:
    return relate.subtree_closed(_paths(spark, d).where("path <> '/'"), "path", F.col("n") > 1000)


@query("SELECT event_type, user_id % 4 AS shard, count(*) AS n, grouping_id(event_type, user_id % 4) AS level FROM events GROUP BY GROUPING SETS ((event_type), (user_id % 4), ())")
def error_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumn("shard", F.col("user_id") % 4)
    return rows.groupingSets([["event_type"], ["shard"], []], "event_type", "shard").agg(F.count("*").alias("n"), F.grouping_id("event_type", "shard").alias("level"))


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def telemetry_daily(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN sum(quality) = 0 THEN 1.0 ELSE sum(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END)::DOUBLE / sum(quality) END AS recall, CASE WHEN sum(1 - toxic) = 0 THEN 1.0 ELSE sum(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END)::DOUBLE / sum(1 - toxic) END AS precision FROM labels")
def quality_gate(spark: SparkSession, d: str) -> DataFrame:
    both = F.sum(((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int"))
    share = lambda total: F.when(total == 0, F.lit(1.0)).otherwise(both / total)
    return table(spark, d, "labels").agg(share(F.sum("quality")).alias("recall"), share(F.sum(1 - F.col("toxic"))).alias("precision"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("SELECT text, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text IS NOT NULL").groupBy("text").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
