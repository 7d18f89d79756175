"""Queries of cards. Orders stand for works, their lines for seasons and episodes, customers and parts for files and plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.operators import cards
from tallgrass.session import table

from .base import query

_SOURCES = ["pan115", "baidu", "local", "zdisk", ""]
_TYPES = ["season", "special", "op_ed"]
_FOUND = [n for names in cards.ARTWORK.values() for n in names]


def _pick(values: list[str], at) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), at.cast("int"))


def _folder(work):
    """Folders with and without inner ones: a third lie in a season's folder, some have slashes too many, some are empty."""
    base = F.concat(F.lit("/lib/W"), work.cast("string"))
    return F.when(work % 11 == 0, "").when(work % 3 == 0, F.concat(base, F.lit("/Season 1/"))).when(work % 3 == 1, F.concat(base, F.lit("//S02"))).otherwise(base)


def _works(spark: SparkSession, d: str) -> DataFrame:
    line, key = F.col("l_linenumber"), F.col("l_orderkey")
    name = lambda what: F.concat(F.lit("/lib/W"), key.cast("string"), F.lit(what), line.cast("string"), F.lit(".jpg"))
    season = F.struct(
        F.when(F.col("l_suppkey") % 4 == 0, name("/poster-")).when(F.col("l_suppkey") % 4 == 1, F.lit("HTTP://host/p")).alias("poster_path"),
        F.when(F.col("l_suppkey") % 5 == 0, name("/fanart-")).otherwise("").alias("fanart_path"),
        F.lit(None).cast("string").alias("clearlogo_path"),
    )
    episode = F.struct(
        _pick(_SOURCES, F.col("l_suppkey") % 5).alias("source"),
        F.when(F.col("l_partkey") % 13 != 0, F.concat(F.lit("e"), F.col("l_partkey").cast("string"))).alias("episode_id"),
        F.concat(F.when(line % 2 == 0, "/STRM/").otherwise("/strm/"), line.cast("string")).alias("strm_path"),
        _pick(_TYPES, line % 3).alias("group_type"),
        F.when(F.col("l_quantity") >= 10, F.col("l_quantity").cast("int")).alias("episode_number"),
    )
    lines = table(spark, d, "lineitem").groupBy(key.alias("work_id")).agg(F.sort_array(F.collect_list(F.struct(line.alias("n"), "l_suppkey", "l_partkey", "l_quantity", season.alias("s"), episode.alias("e")))).alias("_l"))
    work, status = F.col("o_orderkey"), F.col("o_custkey")
    orders = table(spark, d, "orders").select(
        work.alias("work_id"),
        _pick(_SOURCES[:4], status % 4).alias("source"),
        F.when(status % 3 == 0, F.array(F.lit("local"), F.lit("baidu"))).when(status % 3 == 1, F.array().cast("array<string>")).alias("sources"),
        _folder(work).alias("dir_path"),
        F.when(status % 7 == 0, F.concat(F.lit("/lib/W"), work.cast("string"), F.lit("/own.jpg"))).when(status % 7 == 1, "https://host/p").otherwise("").alias("poster_path"),
        F.lit(None).cast("string").alias("fanart_path"),
        F.lit("").alias("clearlogo_path"),
        F.when(status % 5 < 2, F.create_map(F.lit("openlist"), F.struct(F.concat(F.lit("e"), status.cast("string")).alias("episode_id"), F.lit("/at").alias("strm_path")), F.lit("local"), F.struct(F.lit("").alias("episode_id"), F.lit("/at").alias("strm_path")))).alias("source_locations"),
    )
    return orders.join(lines, "work_id", "left").withColumns({"seasons": F.transform("_l", lambda x: x["s"]), "episodes": F.transform("_l", lambda x: x["e"])}).drop("_l")


def _files(spark: SparkSession, d: str) -> DataFrame:
    """Some of the files that works and seasons name, and known names in folders."""
    work, cust = F.col("o_orderkey"), F.col("o_custkey")
    base = F.concat(F.lit("/lib/W"), work.cast("string"))
    known = F.concat(base, F.when(work % 2 == 0, "/").when(work % 3 == 0, "/Season 1/").otherwise("/S02/"), _pick(_FOUND, cust % len(_FOUND)))
    more = F.concat(base, F.lit("/"), _pick(_FOUND, (cust + 4) % len(_FOUND)))
    own = F.when(cust % 2 == 0, F.concat(base, F.lit("/own.jpg")))
    of_seasons = table(spark, d, "lineitem").where("l_partkey % 2 = 0").select(F.concat(F.lit("/lib/W"), F.col("l_orderkey").cast("string"), F.lit("/poster-"), F.col("l_linenumber").cast("string"), F.lit(".jpg")).alias("path"))
    return table(spark, d, "orders").select(F.explode(F.array(known, more, own)).alias("path")).unionByName(of_seasons)


_LINES = "SELECT l_orderkey AS w, l_linenumber AS n, l_suppkey AS u, l_partkey AS p, l_quantity AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_quantity) AS k FROM lineitem"
_AT = "CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN '/lib/W' || o_orderkey || '/Season 1' WHEN o_orderkey % 3 = 1 THEN '/lib/W' || o_orderkey || '/S02' ELSE '/lib/W' || o_orderkey END"
_NAMED = "[" + ", ".join(f"'{n}'" for n in _FOUND) + "]"
_FILES = f"""SELECT '/lib/W' || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN '/' WHEN o_orderkey % 3 = 0 THEN '/Season 1/' ELSE '/S02/' END || {_NAMED}[1 + o_custkey % {len(_FOUND)}] AS path FROM orders
    UNION SELECT '/lib/W' || o_orderkey || '/' || {_NAMED}[1 + (o_custkey + 4) % {len(_FOUND)}] FROM orders UNION SELECT '/lib/W' || o_orderkey || '/own.jpg' FROM orders WHERE o_custkey % 2 = 0
    UNION SELECT '/lib/W' || l_orderkey || '/poster-' || l_linenumber || '.jpg' FROM lineitem WHERE l_partkey % 2 = 0"""


def _best(kind: str) -> str:
    """SQL of the first known name of a kind in a work's folder, then in the one above."""
    names = "[" + ", ".join(f"'{n}'" for n in cards.ARTWORK[kind]) + "]"
    return f"""SELECT w, arg_min(path, rank) AS path FROM (SELECT w, level * 100 + i AS rank, folder || '/' || {names}[i] AS path FROM (SELECT o_orderkey AS w, 0 AS level, {_AT} AS folder FROM orders UNION ALL SELECT o_orderkey, 1, '/lib/W' || o_orderkey FROM orders WHERE o_orderkey % 11 > 0 AND o_orderkey % 3 < 2) r, (SELECT unnest(range(1, {len(cards.ARTWORK[kind]) + 1})) AS i) k WHERE folder IS NOT NULL) c WHERE path IN (SELECT path FROM files) GROUP BY w"""


@query(
    f"""WITH l AS ({_LINES}), files AS ({_FILES}), bp AS ({_best("poster_path")}), bf AS ({_best("fanart_path")}), bc AS ({_best("clearlogo_path")}),
    sp AS (SELECT w, arg_min(CASE WHEN u % 4 = 0 THEN '/lib/W' || w || '/poster-' || n || '.jpg' ELSE 'HTTP://host/p' END, k) AS any_, arg_min('/lib/W' || w || '/poster-' || n || '.jpg', k) FILTER (WHERE u % 4 = 0 AND held) AS held FROM (SELECT l.*, ('/lib/W' || w || '/poster-' || n || '.jpg') IN (SELECT path FROM files) AS held FROM l) WHERE u % 4 < 2 GROUP BY w),
    sf AS (SELECT w, arg_min('/lib/W' || w || '/fanart-' || n || '.jpg', k) AS any_ FROM l WHERE u % 5 = 0 GROUP BY w),
    e AS (SELECT w, count(*) AS n, count(*) FILTER (WHERE n % 3 = 0) AS main, max(q::INT) FILTER (WHERE n % 3 = 0 AND q >= 10) AS latest FROM l GROUP BY w)
    SELECT o_orderkey AS work_id, coalesce(e.n, 0) AS episode_count, coalesce(e.main, 0) AS main_episode_count, coalesce(latest, 0) AS latest_episode_number,
        CASE WHEN o_custkey % 3 = 0 THEN 'local,baidu' ELSE ['pan115', 'baidu', 'local', 'zdisk'][1 + o_custkey % 4] END AS sources, CASE WHEN o_custkey % 5 < 2 THEN 'openlist=e' || o_custkey ELSE '' END AS source_episode_ids,
        coalesce(CASE o_custkey % 7 WHEN 0 THEN '/lib/W' || o_orderkey || '/own.jpg' WHEN 1 THEN 'https://host/p' END, sp.any_, bp.path, '') AS poster_path, coalesce(sf.any_, bf.path, '') AS fanart_path, coalesce(bc.path, '') AS clearlogo_path,
        coalesce(CASE WHEN o_custkey % 14 = 0 THEN '/lib/W' || o_orderkey || '/own.jpg' END, sp.held, bp.path, '') AS local_poster_path, coalesce(bf.path, '') AS local_fanart_path, coalesce(bc.path, '') AS local_clearlogo_path
    FROM orders LEFT JOIN e ON e.w = o_orderkey LEFT JOIN sp ON sp.w = o_orderkey LEFT JOIN sf ON sf.w = o_orderkey LEFT JOIN bp ON bp.w = o_orderkey LEFT JOIN bf ON bf.w = o_orderkey LEFT JOIN bc ON bc.w = o_orderkey"""
)
def work_summaries(spark: SparkSession, d: str) -> DataFrame:
    """The cards of all works, with artwork from references, seasons and folders."""
    s = cards.summaries(_works(spark, d), _files(spark, d))
    ids = F.array_join(F.array_sort(F.transform(F.map_entries("source_episode_ids"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    counts = [F.col(c).cast("long").alias(c) for c in ("episode_count", "main_episode_count", "latest_episode_number")]
    return s.select("work_id", *counts, F.array_join("sources", ",").alias("sources"), ids.alias("source_episode_ids"), *cards.ARTWORK, *[f"local_{k}" for k in cards.ARTWORK])


@query(
    f"""WITH l AS ({_LINES}), c AS (SELECT w AS work_id, ['pan115', 'baidu', 'local', 'zdisk', ''][1 + u % 5] AS source, 'e' || p AS episode_id, CASE WHEN n % 2 = 0 THEN '/STRM/' ELSE '/strm/' END || n AS strm_path FROM l WHERE p % 13 > 0
        UNION ALL SELECT o_orderkey, 'openlist', 'e' || o_custkey, '/at' FROM orders WHERE o_custkey % 5 < 2),
    f AS (SELECT * FROM c WHERE source <> '' QUALIFY row_number() OVER (PARTITION BY work_id, source ORDER BY episode_id, lower(strm_path), strm_path) = 1)
    SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY CASE source WHEN 'pan115' THEN 0 WHEN 'baidu' THEN 1 WHEN 'local' THEN 2 WHEN 'openlist' THEN 3 ELSE 99 END, source) - 1 AS place FROM f"""
)
def source_locations(spark: SparkSession, d: str) -> DataFrame:
    """Where each source has a work."""
    found = cards.best_locations(_works(spark, d))
    return found.withColumn("place", F.col("place").cast("long"))


@query(
    """WITH b AS (SELECT c_custkey AS work_id FROM customer WHERE c_nationkey IN (1, 2) OR (c_nationkey > 20 AND c_custkey % 2 = 1)),
    shown AS (SELECT DISTINCT l_suppkey AS plan_id, l_orderkey AS target_id, o_custkey AS work_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linenumber % 2 = 1 AND o_orderpriority <> '1-URGENT'),
    t AS (SELECT DISTINCT l_suppkey AS plan_id, l_orderkey AS target_id FROM lineitem WHERE l_linenumber % 2 = 1),
    r AS (SELECT l_suppkey AS plan_id, l_orderkey AS target_id FROM lineitem WHERE l_returnflag = 'R' AND l_quantity < 3),
    f AS (SELECT l_suppkey AS plan_id, l_orderkey AS target_id, CASE WHEN l_partkey % 3 > 0 THEN 1000000 + l_partkey END AS work_id FROM lineitem WHERE l_quantity > 49)
    SELECT work_id FROM b UNION SELECT work_id FROM shown JOIN (SELECT * FROM r UNION SELECT plan_id, target_id FROM f) USING (plan_id, target_id)
    UNION SELECT work_id FROM f WHERE work_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM t WHERE t.plan_id = f.plan_id AND t.target_id = f.target_id)"""
)
def exception_works(spark: SparkSession, d: str) -> DataFrame:
    """Works that stay visible: customers as bindings, suppliers as plans, orders as targets, their odd lines as items of them."""
    line, nation = table(spark, d, "lineitem"), F.col("c_nationkey")
    states = F.when(nation == 1, "waiting_review").when(nation == 2, "source_unavailable").when(nation == 3, None).otherwise("none")
    bindings = table(spark, d, "customer").select(F.col("c_custkey").alias("work_id"), states.alias("attention_state"), F.when(nation > 20, F.col("c_custkey") % 2).alias("failed"))
    keys = [F.col("l_suppkey").alias("plan_id"), F.col("l_orderkey").alias("target_id")]
    status = F.when(F.col("l_returnflag") == "R", "pending").otherwise("done")
    reviews = line.where("l_quantity < 3").select(*keys, status.alias("status"))
    failures = line.where("l_quantity > 49").select(*keys, F.when(F.col("l_partkey") % 3 > 0, F.lit(1000000) + F.col("l_partkey")).alias("work_id"))
    item = F.concat_ws("-", "l_orderkey", "l_linenumber")
    targets = line.where("l_linenumber % 2 = 1").select(*keys, item.alias("item_id"))
    works = table(spark, d, "orders").where("o_orderpriority <> '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("work_id"))
    owned = line.join(works, "l_orderkey").select(F.col("l_suppkey").alias("plan_id"), item.alias("item_id"), "work_id")
    return cards.exception_ids(bindings, reviews, failures, targets, owned)
