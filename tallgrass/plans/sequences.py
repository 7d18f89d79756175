"""Queries of runs, offsets, samples, sessions and numbering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.operators import sequence
from tallgrass.session import table

from .base import query

# Items of an order as episodes: those of a third of the orders begin at 26, those of every fifth order lack number 2.
_EPISODES = "SELECT l_suppkey, l_orderkey, l_linenumber + CASE WHEN l_orderkey % 3 = 0 THEN 25 ELSE 0 END + CASE WHEN l_orderkey % 5 = 0 AND l_linenumber >= 2 THEN 1 ELSE 0 END AS ep FROM lineitem"


def _episodes(spark: SparkSession, d: str) -> DataFrame:
    ep = F.col("l_linenumber") + F.when(F.col("l_orderkey") % 3 == 0, 25).otherwise(0) + F.when((F.col("l_orderkey") % 5 == 0) & (F.col("l_linenumber") >= 2), 1).otherwise(0)
    return table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", ep.cast("int").alias("ep"))


_FREE = f"WITH e AS ({_EPISODES}), g AS (SELECT l_orderkey, count(DISTINCT ep) AS n, min(ep) AS least, max(ep) AS most, max(ep) - min(ep) + 1 = count(DISTINCT ep) AS gap_free FROM e GROUP BY 1)"


@query(f"{_FREE} SELECT l_orderkey, n, gap_free AND least = 1 AS contiguous FROM g")
def contiguous_prefix(spark: SparkSession, d: str) -> DataFrame:
    return sequence.contiguous_prefix(_episodes(spark, d), ["l_orderkey"], "ep")


@query(f"{_FREE} SELECT l_orderkey, ep - CASE WHEN n >= 2 AND least >= 10 AND gap_free THEN least - 1 ELSE 0 END AS ep FROM e JOIN g USING (l_orderkey)")
def gap_free_runs(spark: SparkSession, d: str) -> DataFrame:
    return sequence.normalised_runs(_episodes(spark, d), ["l_orderkey"], "ep").select("l_orderkey", "ep")


@query(
    """WITH p AS (SELECT o_custkey, o_orderkey, l_linenumber + CASE WHEN o_orderkey % 8 = 0 THEN 1 ELSE 0 END AS ep FROM orders JOIN lineitem ON l_orderkey = o_orderkey), g AS (SELECT o_custkey, o_orderkey, max(ep) AS most, max(ep) = count(DISTINCT ep) AND min(ep) = 1 AS sound FROM p GROUP BY 1, 2)
    SELECT o_custkey, o_orderkey, CAST(CASE WHEN coalesce(bool_and(sound) OVER w, true) THEN coalesce(sum(most) OVER w, 0) ELSE 0 END AS BIGINT) AS "offset" FROM g WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
)
def gap_free_offset(spark: SparkSession, d: str) -> DataFrame:
    """Orders of a customer as seasons, their items as episodes; every eighth order begins at 2."""
    # Items are counted by order before they meet the customers, in one shuffle by order; an order that comes twice is one.
    ep = F.col("l_linenumber") + F.when(F.col("l_orderkey") % 8 == 0, 1).otherwise(0)
    seasons = sequence.gap_free(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), ep.alias("ep")), ["o_orderkey"], "ep")
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey").repartition("o_orderkey").distinct()
    return sequence.offsets(seasons.join(orders, "o_orderkey"), "o_custkey", "o_orderkey").withColumn("offset", F.col("offset").cast("long"))


@query(
    """WITH s AS (SELECT l_suppkey, year(l_shipdate) AS season, count(*) AS n FROM lineitem GROUP BY 1, 2), b AS (SELECT *, sum(n) OVER (PARTITION BY l_suppkey ORDER BY season) AS upto FROM s)
    SELECT l_suppkey, k, season, CAST(k - upto + n AS BIGINT) AS place FROM (SELECT DISTINCT l_suppkey FROM lineitem) a, (VALUES (1), (40), (900), (1000000)) t(k) LEFT JOIN LATERAL (SELECT season, n, upto FROM b WHERE b.l_suppkey = a.l_suppkey AND k > upto - n AND k <= upto) ON true"""
)
def located_episodes(spark: SparkSession, d: str) -> DataFrame:
    """Absolute numbers mapped to season and place."""
    parts = table(spark, d, "lineitem").groupBy("l_suppkey", F.year("l_shipdate").cast("long").alias("season")).agg(F.count("*").alias("n"))
    absolute = parts.select("l_suppkey").distinct().withColumn("k", F.explode(F.array(*map(F.lit, [1, 40, 900, 1_000_000]))))
    return sequence.located(absolute, parts, "l_suppkey", "k", "season", "n").select("l_suppkey", "k", "season", "place")


@query(
    """WITH s AS (SELECT l_orderkey, l_linenumber AS part, CAST(l_quantity AS BIGINT) % 3 AS n FROM lineitem WHERE l_orderkey % 2 = 0 OR l_linenumber <> 2), g AS (SELECT *, sum(n) OVER w AS total, row_number() OVER w AS i FROM s WHERE n > 0 WINDOW w AS (PARTITION BY l_orderkey ORDER BY part)),
    m AS (SELECT l_orderkey, bool_or(total = 1 + l_orderkey % 4) AND count(*) >= 2 AND bool_and(i = part) AS matched FROM g GROUP BY 1) SELECT o_orderkey, coalesce(matched, false) AS matched FROM orders LEFT JOIN m ON l_orderkey = o_orderkey"""
)
def season_prefix_match(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "lineitem").where("l_orderkey % 2 = 0 OR l_linenumber <> 2").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("part"), (F.col("l_quantity").cast("long") % 3).alias("n"))
    local = table(spark, d, "orders").select("o_orderkey", (1 + F.col("o_orderkey") % 4).alias("local"))
    return sequence.prefix_match(parts, "o_orderkey", "part", "n", local, "local")


@query(
    """WITH p AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents)
    SELECT doc_id, source FROM p WHERE n <= 7 OR i IN (SELECT CAST(round_even(k * (n - 1) / 6.0, 0) AS BIGINT) FROM range(7) t(k))"""
)
def even_sample(spark: SparkSession, d: str) -> DataFrame:
    return sequence.even_sample(table(spark, d, "documents"), "source", [F.col("doc_id").asc()], 7).select("doc_id", "source")


@query(
    """WITH f AS (SELECT user_id, event_type = 'signup' AS s, value > 95 AS a, event_type = 'purchase' AS e, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), n AS (SELECT *, CAST(sum(s::INT) OVER (PARTITION BY user_id ORDER BY i) AS BIGINT) AS session FROM f)
    SELECT user_id, session, count(*) AS n, CASE WHEN bool_or(a) THEN 'attention' WHEN bool_or(e) THEN 'complete' ELSE 'active' END AS state FROM n GROUP BY 1, 2"""
)
def marker_sessions(spark: SparkSession, d: str) -> DataFrame:
    of = lambda t: F.col("event_type") == t
    return sequence.sessions(table(spark, d, "events"), "user_id", [F.col("ts").asc(), F.col("event_id").asc()], of("signup"), F.col("value") > 95, of("purchase"))


@query(
    """WITH r AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN 0 WHEN l_linenumber = 5 THEN 1 ELSE l_linenumber END AS no FROM lineitem), m AS (SELECT *, no <= 0 OR row_number() OVER (PARTITION BY l_orderkey, no ORDER BY l_linenumber) > 1 AS bad FROM r)
    SELECT l_orderkey, l_linenumber, CAST(CASE WHEN bad THEN coalesce(max(no) FILTER (NOT bad) OVER (PARTITION BY l_orderkey), 0) + row_number() OVER (PARTITION BY l_orderkey, bad ORDER BY l_linenumber) ELSE no END AS BIGINT) AS no FROM m"""
)
def special_renumber(spark: SparkSession, d: str) -> DataFrame:
    no = F.when(F.col("l_linenumber") % 3 == 0, 0).when(F.col("l_linenumber") == 5, 1).otherwise(F.col("l_linenumber"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", no.alias("no"))
    return sequence.renumbered_specials(rows, ["l_orderkey"], "no", [F.col("l_linenumber").asc()]).withColumn("no", F.col("no").cast("long"))


@query(
    """SELECT l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_orderkey % 4 = 0 AND l_linenumber = 2 THEN 0 ELSE 1 END, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END, l_linenumber) = 1"""
)
def continue_episode(spark: SparkSession, d: str) -> DataFrame:
    last = (F.col("l_orderkey") % 4 == 0) & (F.col("l_linenumber") == 2)
    return sequence.continue_at(table(spark, d, "lineitem"), "l_orderkey", [F.col("l_linenumber").asc()], last, F.col("l_returnflag") == "R", "l_linenumber")


@query(
    """WITH r AS (SELECT l_orderkey, l_linenumber, l_orderkey % 200 AS card, l_suppkey AS folder, l_returnflag <> 'N' AS explicit FROM lineitem), m AS (SELECT card, l_linenumber FROM r GROUP BY 1, 2 HAVING bool_or(explicit) AND NOT bool_and(explicit)), f AS (SELECT DISTINCT folder FROM r WHERE NOT explicit AND (card, l_linenumber) IN (SELECT card, l_linenumber FROM m))
    SELECT l_orderkey, l_linenumber, folder IN (SELECT folder FROM f) AS special FROM r"""
)
def collision_specials(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") % 200).alias("card"), F.col("l_suppkey").alias("folder"), (F.col("l_returnflag") != "N").alias("explicit"))
    return sequence.collided(rows, ["card", "l_linenumber"], "folder", F.col("explicit")).select("l_orderkey", "l_linenumber", "special")
