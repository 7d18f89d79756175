"""Queries of diffs, merges, jobs, routes, scans and source health."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.functions import score
from tallgrass.operators import catalog, diff, relate
from tallgrass.session import stored, table
from tallgrass.sources import scans
from tallgrass.streaming import breaker

from .base import query
from .media import _PATH, pages


def _compared(spark: SparkSession, old: DataFrame, new: DataFrame) -> DataFrame:
    return diff.compared(old, new, lambda df: stored(df, "diff"))


def _snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two snapshots of all orders: by key some come, go, move, are renamed, replaced or get another name under the same id."""
    o = table(spark, d, "orders")
    key = F.col("o_orderkey").cast("string")
    base = o.select("o_orderkey", F.concat(F.lit("a/"), key, F.lit("-episode.mkv")).alias("path"), F.concat(F.lit("id"), key).alias("file_id"), F.col("o_custkey").alias("size"), F.lit(1.0).alias("mtime"), F.lit("local").alias("source"), F.lit("").alias("content"), F.lit("video").alias("kind"))
    k = F.col("o_orderkey") % 20
    old = base.where(k != 1).drop("o_orderkey")
    path = F.when(k == 1, F.concat(F.lit("c/q"), key, F.lit(".mkv"))).when(k == 3, F.concat(F.lit("b/"), key, F.lit("-episode.mkv"))).when(k == 4, F.concat(F.lit("b/"), key, F.lit("-episode2.mkv"))).when(k == 5, F.concat(F.lit("b/"), key.substr(1, 1), F.lit("x.mkv"), key)).otherwise(F.col("path"))
    size = F.when(k == 6, F.col("size") + 1).when(k == 7, None).otherwise(F.col("size"))
    new = base.where(k != 2).withColumn("path", path).withColumn("size", size).withColumn("mtime", F.when(k == 8, 9.0).otherwise(F.col("mtime"))).drop("o_orderkey")
    return old, new


_CHANGE = "CASE o_orderkey % 20 WHEN 1 THEN 'added' WHEN 2 THEN 'missing' WHEN 3 THEN 'moved' WHEN 4 THEN 'renamed' WHEN 5 THEN 'uncertain' WHEN 6 THEN 'replaced' WHEN 8 THEN 'replaced' ELSE 'unchanged' END"


@query(
    f"""SELECT {_CHANGE} AS change, CASE WHEN o_orderkey % 20 <> 1 THEN 'a/' || o_orderkey || '-episode.mkv' END AS old_path,
    CASE o_orderkey % 20 WHEN 1 THEN 'c/q' || o_orderkey || '.mkv' WHEN 2 THEN NULL WHEN 3 THEN 'b/' || o_orderkey || '-episode.mkv' WHEN 4 THEN 'b/' || o_orderkey || '-episode2.mkv' WHEN 5 THEN 'b/' || left(o_orderkey::VARCHAR, 1) || 'x.mkv' || o_orderkey ELSE 'a/' || o_orderkey || '-episode.mkv' END AS new_path FROM orders"""
)
def snapshot_diff_exact(spark: SparkSession, d: str) -> DataFrame:
    """Passes 1, 2, 4 and 5 over all orders, with every verdict."""
    return _compared(spark, *_snapshots(spark, d)).select("change", "old_path", "new_path")


@query(
    """SELECT CASE doc_id % 3 WHEN 0 THEN 'moved' WHEN 1 THEN 'renamed' END AS change, 'old/' || doc_id || '-a-long-name-of-a-file.mkv' AS old_path, CASE doc_id % 3 WHEN 0 THEN 'new/' || doc_id || '-a-long-name-of-a-file.mkv' ELSE 'new/' || doc_id || '-a-long-name-of-a-file-x.mkv' END AS new_path FROM documents WHERE doc_id % 3 < 2
    UNION ALL SELECT 'missing', 'old/' || doc_id || '-a-long-name-of-a-file.mkv', NULL FROM documents WHERE doc_id % 3 = 2 UNION ALL SELECT 'added', NULL, 'new/' || doc_id || '-q.mkv' FROM documents WHERE doc_id % 3 = 2"""
)
def snapshot_diff_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    """Pass 3 over all documents as files without ids, each of its own size."""
    k, key = F.col("doc_id") % 3, F.col("doc_id").cast("string")
    name = F.when(k == 2, F.concat(key, F.lit("-q.mkv"))).when(k == 1, F.concat(key, F.lit("-a-long-name-of-a-file-x.mkv"))).otherwise(F.concat(key, F.lit("-a-long-name-of-a-file.mkv")))
    rest = [F.lit(None).cast("string").alias("file_id"), F.col("doc_id").alias("size"), F.lit(None).cast("double").alias("mtime"), F.lit("baidu").alias("source"), F.lit("").alias("content"), F.lit("video").alias("kind")]
    docs = table(spark, d, "documents")
    old = docs.select(F.concat(F.lit("old/"), key, F.lit("-a-long-name-of-a-file.mkv")).alias("path"), *rest)
    return _compared(spark, old, docs.select(F.concat(F.lit("new/"), name).alias("path"), *rest)).select("change", "old_path", "new_path")


@query(
    f"""WITH c AS (SELECT count(*) FILTER ({_CHANGE} = 'missing') AS missing, count(*) FILTER ({_CHANGE} IN ('moved', 'renamed', 'uncertain')) AS moved, count(*) FILTER (o_orderkey % 20 <> 1) AS old_videos, count(*) FILTER (o_orderkey % 20 <> 2) AS new_videos FROM orders)
    SELECT old_videos, new_videos, missing / old_videos::DOUBLE AS missing_share, moved / old_videos::DOUBLE AS moved_share, abs(new_videos - old_videos) / old_videos::DOUBLE AS changed_share, missing / old_videos::DOUBLE > 0.3 OR moved / old_videos::DOUBLE > 0.3 OR abs(new_videos - old_videos) / old_videos::DOUBLE > 0.5 AS blocked FROM c"""
)
def diff_safety(spark: SparkSession, d: str) -> DataFrame:
    return diff.safety(_compared(spark, *_snapshots(spark, d)))


@query(f"SELECT {_CHANGE} AS change, count(*) AS n FROM orders WHERE {_CHANGE} IN ('added', 'replaced') GROUP BY 1")
def incremental_plan(spark: SparkSession, d: str) -> DataFrame:
    return diff.incremental(_compared(spark, *_snapshots(spark, d))).groupBy("change").agg(F.count("*").alias("n"))


@query(
    f"""SELECT CASE o_orderkey % 20 WHEN 1 THEN 'c/q' || o_orderkey || '.mkv' WHEN 3 THEN 'b/' || o_orderkey || '-episode.mkv' WHEN 4 THEN 'b/' || o_orderkey || '-episode2.mkv' WHEN 5 THEN 'b/' || left(o_orderkey::VARCHAR, 1) || 'x.mkv' || o_orderkey ELSE 'a/' || o_orderkey || '-episode.mkv' END AS path, {_CHANGE} = 'missing' AS missing, CASE WHEN o_orderkey % 20 = 1 THEN 'new' ELSE 'base' END AS note FROM orders"""
)
def incremental_merge(spark: SparkSession, d: str) -> DataFrame:
    old, new = _snapshots(spark, d)
    return diff.merged(old.select("path", F.lit(False).alias("missing"), F.lit("base").alias("note")), _compared(spark, old, new))


@query("SELECT false AS changed, true AS equal")
def snapshot_equality(spark: SparkSession, d: str) -> DataFrame:
    old, new = _snapshots(spark, d)
    return diff.same_snapshot(old, new).withColumnRenamed("same", "changed").crossJoin(diff.same_snapshot(old, old).withColumnRenamed("same", "equal"))


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    return table(spark, d, "orders").select(F.concat(F.lit("/f"), k.cast("string"), F.lit("/"), F.col("o_orderkey").cast("string")).alias("path"), F.concat(F.lit("/f"), k.cast("string")).alias("parent"), F.lit("file").alias("kind"), F.col("o_custkey").alias("size"), F.lit(1.0).alias("mtime"), F.lit(1).alias("first_seen"), F.when(F.col("o_orderkey") % 28 == 0, 9).otherwise(2).alias("last_seen"), F.lit("").alias("tombstone"))


@query(
    """WITH v AS (SELECT '/f' || o_orderkey % 4 || '/' || o_orderkey AS path, o_orderkey AS k, o_orderkey % 28 = 0 AS later, o_orderkey % 5 <> 0 AS listed FROM orders), w AS (SELECT *, CASE WHEN k % 4 <> 0 THEN 'outside' WHEN listed AND k % 3 = 0 THEN 'updated' WHEN listed THEN 'unchanged' WHEN later THEN 'outside' ELSE 'deleted' END AS verdict FROM v)
    SELECT 'now' AS listing, path, verdict, CASE WHEN verdict = 'deleted' THEN 'deleted' ELSE '' END AS tombstone, CASE WHEN verdict IN ('updated', 'unchanged') THEN 3 WHEN later THEN 9 ELSE 2 END AS last_seen FROM w
    UNION ALL SELECT 'now', '/f0/new' || o_orderkey, 'inserted', '', 3 FROM orders WHERE o_orderkey % 4 = 1
    UNION ALL SELECT 'late', path, 'outside', '', CASE WHEN later THEN 9 ELSE 2 END FROM v"""
)
def catalog_merge(spark: SparkSession, d: str) -> DataFrame:
    """A complete listing of folder /f0 at generation 3, over all orders as nodes; and the same where the root is at generation 4 already, which changes nothing."""
    o = table(spark, d, "orders")
    size = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey"))
    page = o.where("o_orderkey % 4 = 0 AND o_orderkey % 5 <> 0").select(F.concat(F.lit("/f0/"), "o_orderkey").alias("path"), F.lit("file").alias("kind"), size.alias("size"), F.lit(1.0).alias("mtime"))
    new = o.where("o_orderkey % 4 = 1").select(F.concat(F.lit("/f0/new"), "o_orderkey").alias("path"), F.lit("file").alias("kind"), F.col("o_custkey").alias("size"), F.lit(2.0).alias("mtime"))
    rows = lambda name, active: catalog.committed(_nodes(spark, d), page.unionByName(new), "/f0", 3, active).select(F.lit(name).alias("listing"), "path", "verdict", "tombstone", "last_seen")
    return rows("now", 3).unionByName(rows("late", 4))


@query(
    """SELECT '/f' || o_orderkey % 4 || '/' || o_orderkey AS path, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey + 5 ELSE o_custkey END AS size, 1 AS first_seen, CASE WHEN o_orderkey % 3 < 2 THEN 4 WHEN o_orderkey % 28 = 0 THEN 9 ELSE 2 END AS last_seen FROM orders
    UNION ALL SELECT '/g/' || o_orderkey, o_custkey, 4, 4 FROM orders WHERE o_orderkey % 3 = 2"""
)
def catalog_ingest(spark: SparkSession, d: str) -> DataFrame:
    k, key = F.col("o_orderkey") % 3, F.col("o_orderkey").cast("string")
    path = F.when(k == 2, F.concat(F.lit("/g/"), key)).otherwise(F.concat(F.lit("/f"), (F.col("o_orderkey") % 4).cast("string"), F.lit("/"), key))
    size = F.when(k == 0, F.col("o_custkey") + 5).when(k == 2, F.col("o_custkey"))
    return catalog.ingested(_nodes(spark, d), table(spark, d, "orders").select(path.alias("path"), size.alias("size")), 4)


@query("SELECT '/f' || o_orderkey % 4 AS parent, count(*) AS n FROM orders WHERE o_orderkey % 4 <> 2 GROUP BY 1")
def subtree_delete(spark: SparkSession, d: str) -> DataFrame:
    return catalog.removed_subtree(_nodes(spark, d), "/f2").groupBy("parent").agg(F.count("*").alias("n"))


_JOBS = """SELECT event_id AS job, CASE WHEN user_id % 5 = 0 THEN '' ELSE 'r' || user_id % 50 END AS resource, CASE WHEN user_id % 50 < 25 AND event_id % 40 = 0 THEN 'running' WHEN event_id % 3 = 0 THEN 'succeeded' ELSE 'queued' END AS status, event_id % 4 AS priority,
    CASE WHEN event_id % 11 = 0 THEN event_id - 1 END AS parent, CASE WHEN event_id % 13 = 0 THEN ts + INTERVAL 10000 DAY ELSE ts END AS not_before, event_id % 17 = 0 AS cancelled, ts AS created FROM events"""


@query(
    f"""WITH j AS ({_JOBS}), free AS (SELECT * FROM j a WHERE status = 'queued' AND NOT cancelled AND not_before <= TIMESTAMP '2040-01-01' AND NOT EXISTS (SELECT 1 FROM j b WHERE b.status = 'running' AND b.resource = a.resource AND b.resource <> '')
    AND NOT EXISTS (SELECT 1 FROM j p WHERE p.job = a.parent AND p.status IN ('queued', 'running')))
    SELECT job, resource, priority FROM (SELECT * FROM free QUALIFY row_number() OVER (PARTITION BY CASE WHEN resource = '' THEN 'job:' || job ELSE resource END ORDER BY priority DESC, created, job) = 1) ORDER BY priority DESC, created, job LIMIT 200"""
)
def claimable_jobs(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "events").createOrReplaceTempView("events_of_jobs")
    jobs = spark.sql(_JOBS.replace("FROM events", "FROM events_of_jobs"))
    return catalog.claimable(jobs, F.lit("2040-01-01").cast("timestamp"), 200)


@query("SELECT event_type, count(*) FILTER (event_id % 3 = 0 AND event_id % 2 = 0) AS requeued, count(*) FILTER (event_id % 3 = 0 AND event_id % 2 = 1) AS running, count(*) FILTER (event_id % 3 <> 0) AS queued FROM events GROUP BY 1")
def lease_expiry(spark: SparkSession, d: str) -> DataFrame:
    now = F.lit("2030-01-01").cast("timestamp")
    jobs = table(spark, d, "events").select("event_type", F.when(F.col("event_id") % 3 == 0, "running").otherwise("queued").alias("status"), F.when(F.col("event_id") % 3 == 0, F.when(F.col("event_id") % 2 == 0, F.lit("2029-01-01")).otherwise("2031-01-01")).cast("timestamp").alias("lease_until"), (F.col("event_id") % 3 == 0).alias("was"))
    out = catalog.expired(jobs, now)
    return out.groupBy("event_type").agg(F.count_if(F.col("was") & (F.col("status") == "queued")).alias("requeued"), F.count_if(F.col("status") == "running").alias("running"), F.count_if(~F.col("was")).alias("queued"))


@query("SELECT event_id, user_id AS resource, status FROM (SELECT *, CASE event_id % 3 WHEN 0 THEN 'running' WHEN 1 THEN 'queued' ELSE 'failed' END AS status FROM events) WHERE status <> 'failed' QUALIFY row_number() OVER (PARTITION BY user_id, status ORDER BY ts, event_id) = 1")
def coalesced_jobs(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("event_id") % 3 == 0, "running").when(F.col("event_id") % 3 == 1, "queued").otherwise("failed")
    rows = table(spark, d, "events").select("event_id", F.col("user_id").alias("resource"), status.alias("status"), "ts")
    return catalog.coalesced(rows, [F.col("ts").asc(), F.col("event_id").asc()]).select("event_id", "resource", "status")


@query(
    f"""WITH p AS (SELECT page_id, {_PATH} AS path FROM pages), r AS (SELECT * FROM (VALUES ('/en'), ('/fr'), ('/en/a'), ('/en/a/b')) t(route)), s AS (SELECT path AS route FROM p WHERE page_id % 10 = 0 AND path <> '/' UNION SELECT route FROM r)
    SELECT page_id, path, (SELECT max_by(route, length(route)) FROM s WHERE path = route OR starts_with(path, route || '/')) AS route FROM p"""
)
def longest_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Routes of several depths, disabled ones beside them."""
    own = pages(spark, d)
    fixed = spark.createDataFrame([("/en", True), ("/fr", True), ("/en/a", True), ("/en/a/b", True), ("/de", False)], "prefix string, enabled boolean")
    routes = own.where("path <> '/'").select(F.col("path").alias("prefix"), (F.col("page_id") % 10 == 0).alias("enabled")).unionByName(fixed)
    return catalog.best_routes(own, "path", "page_id", routes)


@query(f"WITH p AS (SELECT DISTINCT {_PATH} AS path FROM pages) SELECT path FROM p a WHERE path <> '/' AND NOT EXISTS (SELECT 1 FROM p b WHERE b.path <> '/' AND starts_with(a.path, b.path || '/'))")
def shallowest_owners(spark: SparkSession, d: str) -> DataFrame:
    return catalog.shallowest(pages(spark, d).where("path <> '/'"), "path")


@query(
    f"""WITH p AS (SELECT DISTINCT {_PATH} AS path, page_id % 2 AS side FROM pages), a AS (SELECT DISTINCT path FROM p WHERE side = 0 UNION SELECT '/'), b AS (SELECT DISTINCT path AS other FROM p WHERE side = 1)
    SELECT path, other FROM a, b WHERE path = other OR path = '/' OR other = '/' OR starts_with(path, other || '/') OR starts_with(other, path || '/')"""
)
def overlapping_roots(spark: SparkSession, d: str) -> DataFrame:
    own = pages(spark, d).select("path", "page_id")
    root = spark.range(1).select(F.lit("/").alias("path"))
    return catalog.overlapping(own.where("page_id % 2 = 0").select("path").union(root), own.where("page_id % 2 = 1"), "path")


@query("SELECT l_orderkey, sha256(string_agg(l_linenumber || chr(9) || l_partkey || chr(9) || coalesce(l_returnflag, ''), chr(10) ORDER BY l_linenumber || chr(9) || l_partkey || chr(9) || coalesce(l_returnflag, ''))) AS digest, count(*) AS n FROM lineitem GROUP BY 1")
def member_hash(spark: SparkSession, d: str) -> DataFrame:
    return catalog.member_hash(table(spark, d, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_returnflag"])


@query("SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey LIMIT 50) THEN 'Q' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def oldest_k_semi(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus")
    return catalog.oldest(rows, [F.col("o_orderdate").asc(), F.col("o_orderkey").asc()], 50, F.col("o_orderstatus") == "O", {"o_orderstatus": F.lit("Q")}, "o_orderkey").select("o_orderkey", "o_orderstatus")


@query(
    """WITH f AS (SELECT o_orderkey::VARCHAR AS path, o_custkey % 6 AS depth, CASE WHEN o_orderkey % 9 = 0 THEN 'failed' WHEN o_orderkey % 9 = 1 THEN 'queued' ELSE 'complete' END AS state, CASE WHEN o_orderkey % 5 > 1 THEN o_orderdate END AS due_at, CASE WHEN o_orderkey % 7 > 0 THEN o_orderdate END AS verified_at, o_orderkey % 2 = 0 AS at_source FROM orders),
    r AS (SELECT *, CASE WHEN depth = 0 THEN 'root' WHEN state = 'failed' THEN 'failed' WHEN state = 'complete' AND due_at <= TIMESTAMP '1995-01-01' THEN 'due' END AS reason FROM f)
    SELECT path, reason FROM r WHERE reason IS NOT NULL UNION ALL SELECT * FROM (SELECT path, 'unverified' FROM r WHERE reason IS NULL AND state = 'complete' AND NOT at_source AND due_at IS NULL ORDER BY verified_at NULLS FIRST, path LIMIT 50)"""
)
def scan_frontier(spark: SparkSession, d: str) -> DataFrame:
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    state = F.when(k % 9 == 0, "failed").when(k % 9 == 1, "queued").otherwise("complete")
    f = table(spark, d, "orders").select(k.cast("string").alias("path"), (F.col("o_custkey") % 6).alias("depth"), state.alias("state"), F.when(k % 5 > 1, day).alias("due_at"), F.when(k % 7 > 0, day).alias("verified_at"), F.when(k % 2 == 0, day).alias("remote_verified_at"))
    return catalog.frontier(f, F.lit("1995-01-01").cast("timestamp"), 50)


@query("SELECT o_custkey, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS verified, round(count(*) FILTER (o_orderstatus = 'F') / count(*)::DOUBLE, 4) AS share FROM orders GROUP BY 1")
def coverage_ratio(spark: SparkSession, d: str) -> DataFrame:
    return catalog.coverage(table(spark, d, "orders"), "o_custkey", F.col("o_orderstatus") == "F")


_ROOTS = "CASE WHEN o_custkey % 5 = 0 THEN 'succeeded' WHEN o_custkey % 5 = 1 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'failed' ELSE 'succeeded' END WHEN o_custkey % 5 = 2 THEN 'failed' WHEN o_custkey % 5 = 3 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'running' ELSE 'queued' END ELSE 'cancelled' END"


@query(
    f"""WITH r AS (SELECT o_custkey, {_ROOTS} AS s FROM orders) SELECT o_custkey, CASE WHEN bool_and(s = 'succeeded') THEN 'succeeded' WHEN bool_or(s = 'running') THEN 'running' WHEN bool_or(s = 'queued') THEN 'pending' WHEN bool_or(s = 'failed') THEN CASE WHEN bool_or(s = 'succeeded') THEN 'partial_failed' ELSE 'failed' END
    WHEN bool_or(s = 'cancelled') THEN 'cancelled' ELSE 'pending' END AS batch_status FROM r GROUP BY 1"""
)
def batch_rollup(spark: SparkSession, d: str) -> DataFrame:
    return catalog.batch_status(table(spark, d, "orders").select("o_custkey", F.expr(_ROOTS).alias("s")), "o_custkey", "s")


@query(
    """WITH j AS (SELECT user_id AS revision, CASE event_id % 3 WHEN 0 THEN 'mirror' WHEN 1 THEN 'scrape' ELSE 'library' END AS type, CASE event_id % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'running' WHEN 2 THEN 'cancelled' ELSE 'succeeded' END AS status, ts, event_id FROM events),
    p AS (SELECT revision, arg_max(status, (ts, event_id)) FILTER (type = 'mirror') AS m, arg_max(status, (ts, event_id)) FILTER (type = 'scrape') AS s, arg_max(status, (ts, event_id)) FILTER (type = 'library') AS l FROM j GROUP BY 1)
    SELECT revision, CASE WHEN revision % 10 = 0 THEN 'needs_review' WHEN m IS NULL THEN 'queued' WHEN m IN ('failed', 'cancelled') THEN m WHEN m = 'running' THEN 'mirroring' WHEN s IS NULL THEN 'mirrored' WHEN s IN ('failed', 'cancelled') THEN s WHEN s = 'running' THEN 'scraping' WHEN l IN ('failed', 'cancelled') THEN l WHEN l = 'running' THEN 'updating_library' ELSE 'completed' END AS state FROM p"""
)
def pipeline_states(spark: SparkSession, d: str) -> DataFrame:
    kind = F.element_at(F.array(F.lit("mirror"), F.lit("scrape"), F.lit("library")), (F.col("event_id") % 3 + 1).cast("int"))
    status = F.element_at(F.array(*map(F.lit, ["failed", "running", "cancelled", "succeeded", "succeeded"])), (F.col("event_id") % 5 + 1).cast("int"))
    jobs = table(spark, d, "events").select(F.col("user_id").alias("revision"), kind.alias("type"), status.alias("status"), F.col("ts").alias("created"), F.col("event_id").alias("job"))
    state = score.pipeline_state(F.when(F.col("revision") % 10 == 0, "draft").otherwise("active"), "mirror", "scrape", "library")
    return catalog.jobs_by_revision(jobs).select("revision", state.alias("state"))


@query("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def batch_root_join(spark: SparkSession, d: str) -> DataFrame:
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", "r_name")


@query("SELECT o_orderkey, l_linenumber, c_name FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_suppkey % 10 = o_custkey % 10 JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus <> 'P'")
def composite_join(spark: SparkSession, d: str) -> DataFrame:
    """Units with their current revision by two keys, and its binding."""
    o, li = table(spark, d, "orders").where("o_orderstatus <> 'P'"), table(spark, d, "lineitem")
    joined = o.join(li, (o.o_orderkey == li.l_orderkey) & (o.o_custkey % 10 == li.l_suppkey % 10))
    return joined.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "l_linenumber", "c_name")


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'A') AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def existence_join(spark: SparkSession, d: str) -> DataFrame:
    returned = table(spark, d, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("o_orderkey"))
    rich = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(returned, "o_orderkey", "left_semi").join(rich, "o_custkey", "left_semi").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def not_in_cleanup(spark: SparkSession, d: str) -> DataFrame:
    """NOT IN as SQL means it: a null among the keys would keep nothing."""
    table(spark, d, "orders").createOrReplaceTempView("orders_to_clean")
    table(spark, d, "customer").createOrReplaceTempView("customers_kept")
    return spark.sql("SELECT o_orderkey FROM orders_to_clean WHERE o_custkey NOT IN (SELECT c_custkey FROM customers_kept WHERE c_acctbal > 5000)")


@query("SELECT a.event_id, b.c_custkey FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id % 25 END AS k FROM events) a JOIN (SELECT c_custkey, CASE WHEN c_custkey = 1 THEN NULL ELSE c_custkey END AS k FROM customer WHERE c_custkey < 25) b ON a.k IS NOT DISTINCT FROM b.k")
def null_safe_lookup(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("user_id") % 25).alias("k"))
    b = table(spark, d, "customer").where("c_custkey < 25").select("c_custkey", F.when(F.col("c_custkey") != 1, F.col("c_custkey")).alias("m"))
    return a.join(b, F.col("k").eqNullSafe(F.col("m"))).select("event_id", "c_custkey")


@query(
    """WITH e AS (SELECT o_orderkey + CASE WHEN o_orderkey % 3 = 0 THEN 1000000000 ELSE 0 END AS k, o_custkey % 7 AS v FROM orders), a AS (SELECT l_orderkey AS k, min(l_partkey) % 7 AS v FROM lineitem GROUP BY 1)
    SELECT k, CASE WHEN a.k IS NULL THEN 'missing' WHEN e.k IS NULL THEN 'extra' WHEN e.v IS NOT DISTINCT FROM a.v THEN 'same' ELSE 'mismatch' END AS verdict FROM e FULL JOIN a USING (k)"""
)
def full_outer_audit(spark: SparkSession, d: str) -> DataFrame:
    """Every order against every order of the items; a third of the expected keys are others."""
    expected = table(spark, d, "orders").selectExpr("o_orderkey + if(o_orderkey % 3 = 0, 1000000000, 0) AS k", "o_custkey % 7 AS v")
    actual = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg((F.min("l_partkey") % 7).alias("v"))
    return relate.audit(expected, actual, "k", "v")


@query(
    """WITH e AS (SELECT user_id, event_type, CASE event_id % 3 WHEN 0 THEN 'local' WHEN 1 THEN 'remote' ELSE 'both' END AS side, value > 90 AS barred FROM events), l AS (SELECT DISTINCT user_id, event_type FROM e WHERE side IN ('local', 'both')), r AS (SELECT DISTINCT user_id, event_type FROM e WHERE side IN ('remote', 'both')), b AS (SELECT DISTINCT user_id, event_type FROM e WHERE barred)
    SELECT user_id, event_type, 'already' AS action FROM (SELECT * FROM l INTERSECT SELECT * FROM r) UNION ALL SELECT user_id, event_type, 'push' FROM (SELECT * FROM l EXCEPT SELECT * FROM r)
    UNION ALL SELECT user_id, event_type, 'pull' FROM (SELECT * FROM r EXCEPT SELECT * FROM l EXCEPT SELECT * FROM b)"""
)
def set_sync(spark: SparkSession, d: str) -> DataFrame:
    """Every event is on one side or both; dear ones are barred."""
    k = F.col("event_id") % 3
    e = table(spark, d, "events").select("user_id", "event_type", F.when(k == 0, "local").when(k == 1, "remote").otherwise("both").alias("side"), (F.col("value") > 90).alias("barred"))
    return relate.synced(e.where("side IN ('local', 'both')"), e.where("side IN ('remote', 'both')"), e.where("barred"), ["user_id", "event_type"])


@query("SELECT c_nationkey, CASE WHEN min(s) = max(s) THEN min(s) END AS c_mktsegment FROM (SELECT c_nationkey, CASE WHEN c_nationkey % 2 = 0 THEN 'ALL' ELSE c_mktsegment END AS s FROM customer) GROUP BY 1")
def unique_or_null(spark: SparkSession, d: str) -> DataFrame:
    """Nations of even key agree on one segment, others don't."""
    rows = table(spark, d, "customer").select("c_nationkey", F.when(F.col("c_nationkey") % 2 == 0, "ALL").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))
    return relate.unique_or_null(rows, ["c_nationkey"], "c_mktsegment")


@query(
    """WITH p AS (SELECT p_brand, CAST(right(p_brand, 1) AS INTEGER) % 3 AS style, CASE WHEN CAST(right(p_brand, 1) AS INTEGER) % 3 = 0 THEN '' ELSE 'root/' END || 'Size ' || p_size || '/' || p_partkey || CASE p_partkey % 4 WHEN 0 THEN '.mkv' WHEN 1 THEN '.ass' WHEN 2 THEN '.nfo' ELSE ' extras' END AS path, p_partkey % 4 AS k, p_partkey FROM part)
    SELECT p_brand AS file, path, CASE k WHEN 0 THEN 'video' WHEN 1 THEN 'subtitle' ELSE 'nfo' END AS kind, md5(CASE style WHEN 0 THEN 'pan115:' ELSE 'baidu:' END || path) AS id FROM p WHERE style < 2 AND k < 3
    UNION ALL SELECT p_brand, path || '/inner.mp4', 'video', md5(CASE style WHEN 0 THEN 'pan115:' ELSE 'baidu:' END || path || '/inner.mp4') FROM p WHERE style < 2 AND k = 3"""
)
def tree_parse(spark: SparkSession, d: str) -> DataFrame:
    """A listing of each brand's parts, of either kind or mixed (refused), in UTF-8 or UTF-16, parsed back to files."""
    style, k, key = F.right("p_brand", F.lit(1)).cast("int") % 3, F.col("p_partkey") % 4, F.col("p_partkey").cast("string")
    name = F.concat(key, F.when(k == 0, ".mkv").when(k == 1, ".ass").when(k == 2, ".nfo").otherwise(" extras"))
    folder = F.concat(F.lit("Size "), F.col("p_size").cast("string"))
    bar = F.concat(F.lit("| |-"), folder, F.lit("\n| | |-"), name, F.when(k == 3, "\n| | | |-inner.mp4").otherwise(""))
    box = F.concat(F.lit("│   ├── "), folder, F.lit("\n│   │   └── "), name, F.when(k == 3, "\n│   │       └── inner.mp4").otherwise(""))
    parts = table(spark, d, "part").select("p_brand", style.alias("style"), F.struct("p_size", "p_partkey", F.when(style == 0, bar).when(style == 1, box).when(k == 0, bar).otherwise(box).alias("lines")).alias("p"))
    texts = parts.groupBy("p_brand", "style").agg(F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["lines"]), "\n").alias("t"))  # one listing each
    text = F.concat(F.when(F.col("style") != 1, "|——root\n").otherwise(""), F.when(F.col("style") != 0, "├── root\n").otherwise(""), "t")
    files = texts.select(F.col("p_brand").alias("file"), F.when(F.right("p_brand", F.lit(1)).cast("int") % 2 == 0, F.encode(text, "UTF-16")).otherwise(F.encode(text, "UTF-8")).alias("content"))
    rows = scans.lines(files)
    kinds = scans.style(rows)
    bars = scans.tree(rows.join(kinds.where("style = 'bar'"), "file"), scans.bar_node(F.col("line")), "pan115", above=1)
    boxes = scans.tree(rows.join(kinds.where("style = 'box'"), "file"), scans.box_node(F.col("line")), "baidu")
    return bars.unionByName(boxes).select("file", "path", "kind", "id")


@query("SELECT * FROM (VALUES ('a', 'One', 2005, 7.5::DOUBLE, 24, true, 2, 1), ('b', NULL, NULL, NULL, NULL, NULL, NULL, NULL), ('c', 'Two', NULL, NULL, NULL, NULL, 0, 0)) t(file, title, year, rating, runtime, pending, n_genres, n_cast)")
def xml_fields(spark: SparkSession, d: str) -> DataFrame:
    one = "<tvshow><title> One </title><year>2005</year><rating>7.5</rating><runtime>24.9</runtime><metadatapending>Yes</metadatapending><genre>x</genre><genre>y</genre><genre> </genre><actor><name>n</name></actor></tvshow>"
    files = spark.createDataFrame([("a", bytearray(one.encode())), ("b", bytearray(b"<broken")), ("c", bytearray(b"<movie><title>Two</title><year>soon</year></movie>"))], "file string, content binary")
    size = lambda x: F.array_size(x).alias(f"n_{x}")
    return scans.xml_files(files).select("file", "title", "year", "rating", "runtime", "pending", size("genres"), size("cast"))


@query("SELECT * FROM (VALUES ('m', 'Show/E01.mkv', 'video', 5), ('m', 'x.srt', 'subtitle', NULL)) t(manifest_id, path, kind, size)")
def manifest_scan(spark: SparkSession, d: str) -> DataFrame:
    one = '{"format":"f","manifest_id":"m","source":"openlist","source_root":"/r","entries":[{"name":"E01.mkv","is_dir":false,"size":5,"remote_path":"/r/Show/E01.mkv"},{"name":"Show","is_dir":true,"remote_path":"/r/Show"},{"name":"x.srt","remote_path":"/x.srt"},{"name":"Thumbs.db","remote_path":"/r/Thumbs.db"}]}'
    files = spark.createDataFrame([(bytearray(one.encode()),), (bytearray(b"not json"),)], "content binary")
    return scans.manifest(files).select("manifest_id", "path", "kind", F.col("size").cast("int").alias("size"))


@query()
def breaker_state(spark: SparkSession, d: str) -> DataFrame:
    """Events of users as calls to sources: the last health of each."""
    e = table(spark, d, "events")
    k = F.col("event_id") % 7
    kind = F.when(k == 0, "timeout").when(k == 1, "rate_limit").when(k == 2, "not_found").otherwise("")
    events = e.select(F.col("user_id").cast("string").alias("source"), F.col("event_id").alias("seq"), F.unix_timestamp("ts").cast("double").alias("ts"), F.when(k < 3, "failure").when(k < 5, "ask").otherwise("success").alias("event"), kind.alias("kind"))
    return breaker.final(breaker.replayed(events))
