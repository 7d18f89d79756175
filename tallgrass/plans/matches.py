"""Queries of tiered matches, coverage, closures and cascades."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.operators import cascade, catalog, discovery, match
from tallgrass.operators.cascade import Link
from tallgrass.operators.match import Tier
from tallgrass.session import checkpoints, table

from .base import query

_ITEMS = """i AS (SELECT l_suppkey % 20 AS revision, CASE WHEN l_linenumber < 4 THEN '/s/' || l_partkey || '/' || l_linenumber ELSE '' END AS path, l_partkey // 3 AS work, CASE WHEN l_linenumber = 7 THEN NULL WHEN l_partkey // 3 % 2 = 0 THEN 'c' || l_partkey // 3 ELSE 'c' || l_partkey END AS canonical FROM lineitem),
    a AS (SELECT o_orderkey AS artifact, o_custkey % 20 AS revision, CASE WHEN o_orderkey % 4 = 0 THEN '/s/' || o_custkey || '/1' WHEN o_orderkey % 4 = 1 THEN '/none' END AS path, o_custkey // 3 AS work, CASE WHEN o_orderkey % 11 = 0 THEN 'given' END AS given FROM orders)"""


@query(
    f"""WITH {_ITEMS},
    p AS (SELECT revision, path, min(canonical) AS c FROM i WHERE path <> '' AND canonical IS NOT NULL GROUP BY ALL HAVING count(DISTINCT canonical) = 1),
    w AS (SELECT revision, work, min(canonical) AS c FROM i WHERE canonical IS NOT NULL GROUP BY ALL HAVING count(DISTINCT canonical) = 1)
    SELECT artifact, coalesce(given, p.c, w.c, CAST(a.work AS VARCHAR)) AS partner, CASE WHEN given IS NOT NULL THEN 'given' WHEN p.c IS NOT NULL THEN 'path' WHEN w.c IS NOT NULL THEN 'work' ELSE 'self' END AS tier
    FROM a LEFT JOIN p ON p.revision = a.revision AND p.path = a.path LEFT JOIN w ON w.revision = a.revision AND w.work = a.work"""
)
def canonical_attribution(spark: SparkSession, d: str) -> DataFrame:
    """Each artifact's work: the one given, else that of its path, else the only one of its work id in the revision, else its own id."""
    line = table(spark, d, "lineitem")
    part, work = F.col("l_partkey"), F.expr("l_partkey div 3")
    canonical = F.when(F.col("l_linenumber") == 7, None).when(work % 2 == 0, F.concat(F.lit("c"), work)).otherwise(F.concat(F.lit("c"), part))
    items = line.select((F.col("l_suppkey") % 20).alias("revision"), F.when(F.col("l_linenumber") < 4, F.concat(F.lit("/s/"), part, F.lit("/"), "l_linenumber")).otherwise("").alias("item_path"), work.alias("item_work"), canonical.alias("canonical"))
    k = F.col("o_orderkey")
    path = F.when(k % 4 == 0, F.concat(F.lit("/s/"), "o_custkey", F.lit("/1"))).when(k % 4 == 1, "/none")
    artifacts = table(spark, d, "orders").select(k.alias("artifact"), (F.col("o_custkey") % 20).alias("revision"), path.alias("path"), F.expr("o_custkey div 3").alias("work"), F.when(k % 11 == 0, "given").alias("given"))
    tiers = [Tier("path", F.col("path"), F.col("item_path")), Tier("work", F.col("work"), F.col("item_work"))]
    found = match.tiered(artifacts, items, "artifact", "canonical", tiers, "revision", alone=F.col("work").cast("string"))
    rows = found.join(artifacts.select("artifact", "given"), "artifact")
    return rows.select("artifact", F.coalesce("given", "partner").alias("partner"), F.when(F.col("given").isNotNull(), "given").otherwise(F.coalesce("tier", F.lit("self"))).alias("tier"))


@query(
    """WITH m AS (SELECT o_orderkey AS map, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS target, CASE WHEN o_orderkey % 3 = 1 THEN '/n/' || o_custkey % 150 END AS path FROM orders), t AS (SELECT p_partkey AS target, lower('/N/' || p_partkey) AS path FROM part),
    a AS (SELECT target, max(map) AS map FROM m WHERE target IS NOT NULL GROUP BY 1), b AS (SELECT path, max(map) AS map FROM m WHERE path IS NOT NULL GROUP BY 1)
    SELECT t.target, coalesce(a.map, b.map) AS partner, CASE WHEN a.map IS NOT NULL THEN 'target' WHEN b.map IS NOT NULL THEN 'path' END AS tier FROM t LEFT JOIN a ON a.target = t.target LEFT JOIN b ON b.path = t.path"""
)
def target_map_join(spark: SparkSession, d: str) -> DataFrame:
    """Each target's last map row: by the target's id, else by the path of its side file, else none."""
    k = F.col("o_orderkey")
    maps = table(spark, d, "orders").select(k.alias("map"), F.when(k % 3 == 0, F.col("o_custkey")).alias("of"), F.when(k % 3 == 1, F.concat(F.lit("/n/"), F.col("o_custkey") % 150)).alias("nfo"))
    targets = table(spark, d, "part").select(F.col("p_partkey").alias("target"), F.concat(F.lit("/N/"), "p_partkey").alias("path"))
    return match.tiered(targets, maps, "target", "map", [Tier("target", F.col("target"), F.col("of"), "last"), Tier("path", F.lower("path"), F.lower("nfo"), "last")])


@query(
    """WITH e AS (SELECT l_orderkey * 10 + l_linenumber AS episode, l_orderkey AS subject, min(l_suppkey) % 6 AS number, CASE WHEN min(l_partkey) % 7 = 0 THEN min(l_partkey) END AS explicit FROM lineitem GROUP BY l_orderkey, l_linenumber),
    c AS (SELECT l_orderkey AS subject, l_partkey % 6 AS number, l_orderkey * 100 + l_linenumber AS remote FROM lineitem), n AS (SELECT subject, number, min(remote) AS remote FROM c GROUP BY 1, 2),
    x AS (SELECT o_orderkey * 10 + 1 AS episode, o_custkey AS remote FROM orders WHERE o_orderstatus = 'O')
    SELECT e.episode, coalesce(explicit, x.remote, n.remote) AS remote, CASE WHEN explicit IS NOT NULL THEN 'explicit' WHEN x.remote IS NOT NULL THEN 'map' WHEN n.remote IS NOT NULL THEN 'number' END AS tier FROM e LEFT JOIN x USING (episode) LEFT JOIN n ON n.subject = e.subject AND n.number = e.number"""
)
def remote_episode_map(spark: SparkSession, d: str) -> DataFrame:
    """Each episode's remote one: the one named, else that of the kept map, else the first of its number in the subject, else none."""
    line = table(spark, d, "lineitem")
    one = line.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("l_suppkey"), F.min("l_partkey").alias("l_partkey"))
    episodes = one.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("episode"), F.col("l_orderkey").alias("subject"), (F.col("l_suppkey") % 6).alias("number"), F.when(F.col("l_partkey") % 7 == 0, F.col("l_partkey")).alias("explicit"))
    numbered = line.select(F.col("l_orderkey").alias("subject"), (F.col("l_partkey") % 6).alias("n"), F.lit(None).cast("long").alias("e"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("remote"))
    kept = table(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("subject"), F.lit(None).cast("long").alias("n"), (F.col("o_orderkey") * 10 + 1).alias("e"), F.col("o_custkey").alias("remote"))
    found = match.tiered(episodes, numbered.unionByName(kept), "episode", "remote", [Tier("map", F.col("episode"), F.col("e"), "first"), Tier("number", F.col("number"), F.col("n"), "first")], "subject")
    rows = found.join(episodes.select("episode", "explicit"), "episode")
    return rows.select("episode", F.coalesce("explicit", "partner").alias("remote"), F.when(F.col("explicit").isNotNull(), "explicit").otherwise(F.col("tier")).alias("tier"))


@query(
    """WITH i AS (SELECT l_orderkey * 10 + l_linenumber AS item, min(l_suppkey) % 40 AS plan, min(l_partkey) AS work, l_orderkey % 50 AS dir, min(l_returnflag) AS series FROM lineitem GROUP BY l_orderkey, l_linenumber),
    t AS (SELECT o_custkey % 40 AS plan, CASE WHEN o_custkey % 40 < 10 THEN o_orderkey * 10 + 1 END AS item, CASE WHEN o_custkey % 40 BETWEEN 10 AND 19 THEN o_custkey END AS work, CASE WHEN o_custkey % 40 BETWEEN 20 AND 24 THEN o_orderkey % 50 END AS dir, 'R' AS series FROM orders),
    h AS (SELECT i.*, EXISTS (SELECT 1 FROM t WHERE t.plan = i.plan AND t.item = i.item) AS by_item, EXISTS (SELECT 1 FROM t WHERE t.plan = i.plan AND t.work = i.work) AS by_work, EXISTS (SELECT 1 FROM t WHERE t.plan = i.plan AND t.dir = i.dir) AS by_dir, EXISTS (SELECT 1 FROM t WHERE t.plan = i.plan AND t.series = i.series) AS by_series FROM i),
    n AS (SELECT *, bool_or(by_item OR by_work OR by_dir) OVER (PARTITION BY plan) AS named FROM h)
    SELECT item, CASE WHEN by_item THEN 'item' WHEN by_work THEN 'work' WHEN by_dir THEN 'dir' ELSE 'series' END AS tier FROM n WHERE by_item OR by_work OR by_dir OR (NOT named AND by_series)"""
)
def affected_cards(spark: SparkSession, d: str) -> DataFrame:
    """Items that targets of their plan name by item, work or folder; in plans where none is, those of the targets' series."""
    line, k, plan = table(spark, d, "lineitem"), F.col("o_orderkey"), F.col("o_custkey") % 40
    one = line.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("l_suppkey"), F.min("l_partkey").alias("l_partkey"), F.min("l_returnflag").alias("l_returnflag"))
    items = one.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item"), (F.col("l_suppkey") % 40).alias("plan"), F.col("l_partkey").alias("work"), (F.col("l_orderkey") % 50).alias("dir"), F.col("l_returnflag").alias("series"))
    targets = table(spark, d, "orders").select(plan.alias("plan"), F.when(plan < 10, k * 10 + 1).alias("t_item"), F.when(plan.between(10, 19), F.col("o_custkey")).alias("t_work"), F.when(plan.between(20, 24), k % 50).alias("t_dir"), F.lit("R").alias("t_series"))
    tier = lambda n: Tier(n, F.col(n), F.col(f"t_{n}"))
    return match.affected(items, targets, "item", [tier("item"), tier("work"), tier("dir")], "plan", tier("series"))


@query(
    """WITH o AS (SELECT o_custkey % 4 AS a, o_custkey % 12 AS b, o_custkey AS c, max(o_orderkey % 3) AS batch, bool_and(o_orderstatus <> 'P') AS ok FROM orders GROUP BY o_custkey),
    f AS (SELECT '/a' || a || '/b' || b || '/c' || c AS folder, batch, ok, false AS candidate FROM o UNION ALL SELECT DISTINCT '/a' || a || '/b' || b, 0, true, b % 3 = 0 FROM o UNION ALL SELECT DISTINCT '/a' || a, 0, true, a = 1 FROM o UNION ALL SELECT '/', 0, true, false),
    t AS (SELECT p.folder, p.candidate, CASE WHEN bool_and(q.ok) THEN max(q.batch) END AS closed FROM f p JOIN f q ON q.folder = p.folder OR starts_with(q.folder, p.folder || '/') WHERE p.folder <> '/' GROUP BY 1, 2)
    SELECT folder, closed, CASE WHEN candidate AND closed IS NOT NULL AND NOT EXISTS (SELECT 1 FROM f WHERE f.candidate AND starts_with(t.folder, f.folder || '/')) THEN closed END AS emitted FROM t"""
)
def discovery_closure(spark: SparkSession, d: str) -> DataFrame:
    """Folders made of all customers of orders, scanned in three batches: when each closed, and when each unit left."""
    c = F.col("o_custkey")
    a, b = F.concat(F.lit("/a"), c % 4), F.concat(F.lit("/a"), c % 4, F.lit("/b"), c % 12)
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(F.max(F.col("o_orderkey") % 3).alias("batch"), F.bool_and(F.col("o_orderstatus") != "P").alias("ok"))
    rows = rows.select(a.alias("a"), b.alias("b"), F.concat(b, F.lit("/c"), c).alias("c"), "batch", "ok")
    none = F.array().cast("array<string>")
    leaves = rows.select(F.col("c").alias("folder"), F.col("b").alias("parent"), "ok", none.alias("children"), F.lit(False).alias("candidate"), "batch")
    inner = rows.groupBy("b").agg(F.first("a").alias("parent"), F.collect_set("c").alias("children")).select(F.col("b").alias("folder"), "parent", F.lit(True).alias("ok"), "children", F.regexp_extract("b", "b([0-9]+)$", 1).cast("int").alias("n"))
    inner = inner.select("folder", "parent", "ok", "children", (F.col("n") % 3 == 0).alias("candidate"), F.lit(0).alias("batch"))
    top = rows.groupBy("a").agg(F.collect_set("b").alias("children")).select(F.col("a").alias("folder"), F.lit("/").alias("parent"), F.lit(True).alias("ok"), "children", (F.col("a") == "/a1").alias("candidate"), F.lit(0).alias("batch"))
    every, state = leaves.unionByName(inner).unionByName(top), spark.createDataFrame([], discovery.STATE)
    checkpoints(spark)
    for i in range(3):
        state, _ = discovery.advanced(state, every.where(F.col("batch") == i).drop("batch"), i)
        state = state.checkpoint()
    return state.select("folder", "closed", "emitted")


_LINKS = [
    Link("units", "root", "roots"), Link("revisions", "unit", "units"), Link("items", "revision", "revisions"), Link("batch_roots", "root", "roots"), Link("batch_roots", "batch", "batches", "last"), Link("nodes", "root", "roots"), Link("revisions", "base", "revisions"), Link("roots", "above", "roots", "null"),
]
_KEYS = {"roots": "root", "units": "unit", "revisions": "revision", "items": "item", "batch_roots": "id", "batches": "batch", "nodes": "node"}


def _owned(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Nations as roots, with customers as units, orders as their revisions (some based on the order before them), lines as items, suppliers as roots' places in batches, parts as nodes."""
    t = lambda name: table(spark, d, name)
    places = t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("root"), (F.col("s_nationkey") % 9).alias("batch"))
    return {
        "roots": t("nation").select(F.col("n_nationkey").alias("root"), F.col("n_regionkey").alias("above")), "units": t("customer").select(F.col("c_custkey").alias("unit"), F.col("c_nationkey").alias("root")),
        "revisions": t("orders").select(F.col("o_orderkey").alias("revision"), F.col("o_custkey").alias("unit"), F.when(F.col("o_orderkey") % 50 == 0, F.col("o_orderkey") - 1).alias("base")),
        "items": t("lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("item"), F.col("l_orderkey").alias("revision")),
        "batch_roots": places, "batches": places.select("batch").distinct(), "nodes": t("part").select(F.col("p_partkey").alias("node"), (F.col("p_partkey") % 25).alias("root")),
    }


_OWNED = """n AS (SELECT n_nationkey AS root FROM nation WHERE n_regionkey = 2), r0 AS (SELECT o_orderkey AS revision FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey IN (FROM n){moved}),
    r AS (SELECT revision FROM r0 UNION SELECT o_orderkey FROM orders WHERE o_orderkey % 50 = 0 AND o_orderkey - 1 IN (FROM r0)),
    i AS (SELECT DISTINCT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS item, l_orderkey FROM lineitem WHERE l_orderkey IN (FROM r)),
    b AS (SELECT s_nationkey % 9 AS batch, bool_and(s_nationkey IN (FROM n)) AS lost FROM supplier GROUP BY 1),
    c AS (SELECT 'roots' AS name, (SELECT count(*) FROM n) AS deleted, (SELECT count(*) FROM nation) AS whole UNION ALL SELECT 'units', (SELECT count(*) FROM customer WHERE c_nationkey IN (FROM n){moved}), (SELECT count(*) FROM customer) UNION ALL SELECT 'revisions', (SELECT count(*) FROM r), (SELECT count(*) FROM orders)
        UNION ALL SELECT 'batch_roots', (SELECT count(*) FROM supplier WHERE s_nationkey IN (FROM n)), (SELECT count(*) FROM supplier) UNION ALL SELECT 'batches', (SELECT count(*) FROM b WHERE lost), (SELECT count(*) FROM b) UNION ALL SELECT 'nodes', (SELECT count(*) FROM part WHERE p_partkey % 25 IN (FROM n)), (SELECT count(*) FROM part))"""


@query(f"WITH {_OWNED.format(moved='')} SELECT name, deleted, whole - deleted AS left FROM c UNION ALL SELECT 'items', (SELECT count(*) FROM i), (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (FROM r))")
def cascading_delete(spark: SparkSession, d: str) -> DataFrame:
    """Roots of one region deleted with all that belongs to them, over seven tables, one of which refers to itself."""
    checkpoints(spark)
    tables = _owned(spark, d)
    doomed = table(spark, d, "nation").where("n_regionkey = 2").select("n_nationkey")
    kept, gone = cascade.deleted(tables, _KEYS, _LINKS, {"roots": doomed})
    return cascade.tallied(kept, gone)


@query(
    f"""WITH {_OWNED.format(moved=' AND false')} SELECT 'table' AS kind, name, deleted, whole - deleted AS left FROM c UNION ALL SELECT 'table', 'items', 0, (SELECT count(*) FROM lineitem)
    UNION ALL SELECT 'root', CAST(CASE WHEN c_nationkey IN (FROM n) THEN -1 ELSE c_nationkey END AS VARCHAR), 0, count(*) FROM customer GROUP BY 2"""
)
def root_promotion(spark: SparkSession, d: str) -> DataFrame:
    """Roots of one region merged into a new one above them: their units and what belongs to these stay under it, all else of theirs goes."""
    checkpoints(spark)
    tables = _owned(spark, d)
    mapping = table(spark, d, "nation").where("n_regionkey = 2").select(F.col("n_nationkey").alias("old"), F.lit(-1).alias("new"))
    kept, gone = cascade.promoted(tables, _KEYS, _LINKS, "roots", mapping, ["units"])
    units = kept["units"].groupBy(F.col("root").cast("string").alias("name")).agg(F.lit(0).cast("long").alias("deleted"), F.count("*").alias("left"))
    return cascade.tallied(kept, gone).select(F.lit("table").alias("kind"), "*").unionByName(units.withColumn("kind", F.lit("root")))


@query(
    """WITH r AS (SELECT s_suppkey AS root, 's' || s_nationkey % 3 AS source, CASE s_suppkey % 6 WHEN 0 THEN '/a' || s_suppkey WHEN 1 THEN '/a' || s_suppkey - 1 || '/b/' WHEN 2 THEN '/c//d' || s_suppkey WHEN 3 THEN '/c' WHEN 4 THEN '/e/f/g' || s_suppkey ELSE '/' END AS path FROM supplier),
    q AS (SELECT c_custkey AS request, 's' || c_nationkey % 3 AS source, CASE c_custkey % 8 WHEN 0 THEN '/a' || c_custkey % 100 // 6 * 6 WHEN 1 THEN '/a' || c_custkey % 100 // 6 * 6 || '/b/x/y' WHEN 2 THEN '/e/f' WHEN 3 THEN '/e/f/' WHEN 4 THEN '/c/d2/z' WHEN 5 THEN '/cc' WHEN 6 THEN '/' ELSE '/e/ff' END AS path FROM customer),
    k AS (SELECT DISTINCT root, source, rtrim(regexp_replace(path, '/+', '/', 'g'), '/') AS path FROM r), p AS (SELECT request, source, rtrim(regexp_replace(path, '/+', '/', 'g'), '/') AS path FROM q),
    u AS (SELECT request, k.root, k.path = p.path AS exact, row_number() OVER (PARTITION BY request ORDER BY length(k.path) DESC, root) AS i FROM p JOIN k ON k.source = p.source AND (k.path = p.path OR (k.path <> '' AND starts_with(p.path, k.path || '/')))),
    d AS (SELECT request, count(DISTINCT root) AS n FROM p JOIN k ON k.source = p.source AND k.path <> p.path AND starts_with(k.path, p.path || '/') GROUP BY 1)
    SELECT request, CASE WHEN exact THEN 'reuse_exact' WHEN root IS NOT NULL THEN 'reuse_ancestor' WHEN n > 0 THEN 'promote_parent' ELSE 'create' END AS action, root, CASE WHEN root IS NULL AND n > 0 THEN n ELSE 0 END AS n_covered FROM p LEFT JOIN (SELECT * FROM u WHERE i = 1) u USING (request) LEFT JOIN d USING (request)"""
)
def root_coverage(spark: SparkSession, d: str) -> DataFrame:
    """All customers as import requests against all suppliers as roots of three sources, '/' among both."""
    s, c = F.col("s_suppkey"), F.col("c_custkey")
    six = F.expr("c_custkey % 100 div 6 * 6")
    own = F.when(s % 6 == 0, F.concat(F.lit("/a"), s)).when(s % 6 == 1, F.concat(F.lit("/a"), s - 1, F.lit("/b/"))).when(s % 6 == 2, F.concat(F.lit("/c//d"), s)).when(s % 6 == 3, "/c").when(s % 6 == 4, F.concat(F.lit("/e/f/g"), s)).otherwise("/")
    path = F.when(c % 8 == 0, F.concat(F.lit("/a"), six)).when(c % 8 == 1, F.concat(F.lit("/a"), six, F.lit("/b/x/y"))).when(c % 8 == 2, "/e/f").when(c % 8 == 3, "/e/f/").when(c % 8 == 4, "/c/d2/z").when(c % 8 == 5, "/cc").when(c % 8 == 6, "/").otherwise("/e/ff")
    roots = table(spark, d, "supplier").select(s.alias("root"), F.concat(F.lit("s"), F.col("s_nationkey") % 3).alias("source"), own.alias("path"))
    requests = table(spark, d, "customer").select(c.alias("request"), F.concat(F.lit("s"), F.col("c_nationkey") % 3).alias("source"), path.alias("path"))
    return catalog.resolved_roots(requests, roots)
