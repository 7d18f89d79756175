"""Catalog tables: merges with generations and tombstones, the scan frontier, jobs and routes.

Nodes have path (their key), parent, kind, size, mtime, first_seen, last_seen
and tombstone ('' or null while alive). Repeated paths of a scanned page count
once, with the greatest row. Null paths are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.functions.paths import is_within

from .relate import ancestors
from .relate import ancestors as _ancestors


def committed(nodes: DataFrame, page: DataFrame, folder: str, generation: int, active: int | None = None) -> DataFrame:
    """nodes after the complete listing of one folder at a generation: `verdict` tells inserted, updated, unchanged, deleted or outside.

    A listing older than the root's `active` generation changes nothing at all:
    every node is outside. Children that the page lacks get a tombstone unless
    they were seen at its generation or later, and with a folder all that is
    below it.
    """
    if active is not None and active > generation:
        page, folder = page.limit(0), ""
    rows = page.where("path IS NOT NULL").groupBy("path").agg(F.max(F.struct("kind", "size", "mtime")).alias("p"))
    alive = nodes.where("path IS NOT NULL").withColumn("own", F.col("parent") == folder)
    gone = alive.where((F.coalesce("tombstone", F.lit("")) == "") & F.col("own") & (F.col("last_seen") < generation)).join(rows, "path", "left_anti").select(F.col("path").alias("a"))
    below = alive.select("path", F.explode(ancestors(F.col("path"))).alias("a")).join(gone, "a").select("path").distinct().withColumn("lost", F.lit(True))
    both = alive.join(rows, "path", "full").join(below, "path", "left")
    same = F.col("kind").eqNullSafe(F.col("p.kind")) & F.col("size").eqNullSafe(F.col("p.size")) & F.col("mtime").eqNullSafe(F.col("p.mtime"))
    verdict = F.when(F.col("own").isNull() & F.col("p").isNotNull(), "inserted")
    verdict = verdict.when(F.col("p").isNotNull(), F.when(same, "unchanged").otherwise("updated")).when(F.col("lost"), "deleted").otherwise("outside")
    out = both.withColumn("verdict", verdict)
    seen = F.col("verdict").isin("inserted", "updated", "unchanged")
    take = lambda x: F.when(seen, F.coalesce(f"p.{x}", x)).otherwise(F.col(x)).alias(x)
    return out.select("path", F.coalesce("parent", F.lit(folder)).alias("parent"), take("kind"), take("size"), take("mtime"), F.coalesce("first_seen", F.lit(generation)).alias("first_seen"), F.when(seen, generation).otherwise(F.col("last_seen")).alias("last_seen"), F.when(seen, "").when(F.col("verdict") == "deleted", "deleted").otherwise(F.coalesce("tombstone", F.lit(""))).alias("tombstone"), "verdict")


def ingested(nodes: DataFrame, snapshot: DataFrame, generation: int) -> DataFrame:
    """path, size, first_seen, last_seen after the ingest of a whole snapshot: new paths come in, known ones are seen again with a known size kept where the snapshot has none."""
    rows = snapshot.where("path IS NOT NULL").groupBy("path").agg(F.max("size").alias("new_size"), F.lit(True).alias("seen"))
    both = nodes.join(rows, "path", "full")
    return both.select("path", F.coalesce("new_size", "size").alias("size"), F.coalesce("first_seen", F.lit(generation)).alias("first_seen"), F.when(F.col("seen"), generation).otherwise(F.col("last_seen")).alias("last_seen"))


def removed_subtree(nodes: DataFrame, folder: str) -> DataFrame:
    """nodes without a folder and all below it."""
    return nodes.where(~F.coalesce(is_within("path", F.lit(folder)), F.lit(False)))


def frontier(folders: DataFrame, now: Column, most_unverified: int = 50) -> DataFrame:
    """Folders to scan and why: the root, failed ones, complete ones that are due, and of the complete ones that were never verified at the source and have no time set, the `most_unverified` whose last verification of any kind is oldest (null first), then by path.

    Columns: path, depth, state, due_at, verified_at, remote_verified_at. A
    folder with a later due time waits for it, verified or not.
    """
    complete = F.coalesce(F.col("state") == "complete", F.lit(False))
    reason = F.when(F.col("depth") == 0, "root").when(F.col("state") == "failed", "failed").when(complete & (F.col("due_at") <= now), "due")
    named = folders.withColumn("reason", reason)
    old = named.where(F.col("reason").isNull() & complete & F.col("remote_verified_at").isNull() & F.col("due_at").isNull())
    old = old.orderBy(F.col("verified_at").asc_nulls_first(), "path").limit(most_unverified).withColumn("reason", F.lit("unverified"))
    return named.where("reason IS NOT NULL").unionByName(old).select("path", "reason")


def coverage(folders: DataFrame, key: str, verified: Column) -> DataFrame:
    """Per key: folders, verified ones, and their share, 4 places (1.0 where there are none: see `coverage_of`)."""
    return folders.groupBy(key).agg(F.count("*").alias("total"), F.count_if(verified).alias("verified")).withColumn("share", coverage_of(F.col("verified"), F.col("total")))


def coverage_of(part: Column, whole: Column) -> Column:
    return F.coalesce(F.round(F.try_divide(part, whole), 4), F.lit(1.0))


def claimable(jobs: DataFrame, now: Column, most: int) -> DataFrame:
    """The `most` first jobs that can start, by priority (high first), created, job.

    Columns: job, resource, status, priority, parent, not_before, cancelled,
    created. A job waits while another of its resource runs, its parent is
    queued or running, or its time has not come; one job of each resource is
    given. Jobs without a resource (null or '') exclude none.
    """
    busy = jobs.where("status = 'running' AND resource != ''").select("resource").distinct()
    open_parents = jobs.where("status IN ('queued', 'running')").select(F.col("job").alias("parent"))
    ready = (F.col("status") == "queued") & ~F.coalesce("cancelled", F.lit(False)) & (F.col("not_before").isNull() | (F.col("not_before") <= now))
    free = jobs.where(ready).join(busy, "resource", "left_anti").join(open_parents.distinct(), "parent", "left_anti")
    order = [F.col("priority").desc(), F.col("created").asc(), F.col("job").asc()]
    own = F.when(F.coalesce("resource", F.lit("")) == "", F.concat(F.lit("job:"), F.col("job").cast("string"))).otherwise(F.concat(F.lit("resource:"), F.col("resource").cast("string")))
    one = free.withColumn("_own", own).withColumn("_n", F.row_number().over(Window.partitionBy("_own").orderBy(*order))).where("_n = 1")
    return one.orderBy(*order).limit(most).select("job", "resource", "priority")


def expired(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs with a running one whose lease is over queued again."""
    over = (F.col("status") == "running") & (F.col("lease_until") < now)
    return jobs.withColumn("status", F.when(over, "queued").otherwise(F.col("status"))).withColumn("lease_until", F.when(over, None).otherwise(F.col("lease_until")))


def coalesced(requests: DataFrame, order: list[Column]) -> DataFrame:
    """Of each resource's requests the running one and one queued, the first in order: what waits already isn't queued again."""
    return requests.where("status IN ('queued', 'running')").withColumn("_n", F.row_number().over(Window.partitionBy("resource", "status").orderBy(*order))).where("_n = 1").drop("_n")


def best_routes(rows: DataFrame, path: str, key: str, routes: DataFrame) -> DataFrame:
    """key, path and the enabled route (prefix, enabled) that is the path or its nearest ancestor; null if none."""
    open_routes = routes.where("enabled").select(F.col("prefix").alias("_a")).distinct()
    found = rows.select(key, F.explode(ancestors(F.col(path))).alias("_a")).join(open_routes, "_a").groupBy(key).agg(F.max_by("_a", F.length("_a")).alias("route"))
    return rows.select(key, path).join(found, key, "left")


def resolved_roots(requests: DataFrame, roots: DataFrame) -> DataFrame:
    """request, action, root and n_covered: how an import request (request, source, path) stands to the source's roots (root, source, path).

    'reuse_exact': a root is the path itself (of several the smallest id).
    'reuse_ancestor': one is above it, the nearest counts; the root '/' doesn't.
    'promote_parent': roots are below it, n_covered of them. 'create' else.
    Roots are counted for each of their ancestors, and places (source, path)
    judged once, before requests meet them, so that no request meets all roots
    below it; a request for '/' is above all, a null source or path stands
    alone. Repeated roots count once.
    """
    # '/' and '//a/' are written alike on both sides: '' and '/a'.
    plain = lambda p: F.regexp_replace(F.regexp_replace(p, "/+", "/"), "/$", "")
    place = ["source", "path"]
    asked = requests.select("request", "source", plain(F.col("path")).alias("path"))
    known = roots.select("root", "source", plain(F.col("path")).alias("path"))
    above = F.when(F.col("path") == "", F.array(F.lit(""))).otherwise(_ancestors(F.col("path")))
    up = asked.select(*place).where("source IS NOT NULL AND path IS NOT NULL").distinct().select("source", F.col("path").alias("_p"), F.explode(above).alias("path"))
    up = up.join(known.groupBy(*place).agg(F.min("root").alias("root")), place)
    best = up.groupBy("source", "_p").agg(F.max_by("root", F.length("path")).alias("root"), F.bool_or(F.col("path") == F.col("_p")).alias("exact")).withColumnRenamed("_p", "path")
    below = known.select("root", "source", F.col("path").alias("_r"), F.explode(F.array_prepend(_ancestors(F.col("path")), "")).alias("path")).where("path != _r")
    covered = below.groupBy(*place).agg(F.count_distinct("root").alias("n"))
    rows = asked.join(best, place, "left").join(covered, place, "left")
    action = F.when(F.col("exact"), "reuse_exact").when(F.col("root").isNotNull(), "reuse_ancestor").when(F.col("n") > 0, "promote_parent").otherwise("create")
    return rows.select("request", action.alias("action"), "root", F.when(action == "promote_parent", F.col("n")).otherwise(F.lit(0)).cast("long").alias("n_covered"))


def shallowest(paths: DataFrame, path: str) -> DataFrame:
    """Distinct paths that have no ancestor among the paths."""
    own = paths.select(path).where(F.col(path).isNotNull()).distinct()
    above = own.select(path, F.explode(ancestors(F.col(path))).alias("_a")).where(F.col("_a") != F.col(path))
    covered = above.join(own.select(F.col(path).alias("_a")), "_a").select(path).distinct()
    return own.join(covered, path, "left_anti")


def overlapping(a: DataFrame, b: DataFrame, path: str) -> DataFrame:
    """Distinct pairs (path, other) of which one is the other or its ancestor; '/' is above all."""
    ancestors = lambda p: F.array_append(_ancestors(p), "/")
    one = a.select(path).distinct().select(path, F.explode(ancestors(F.col(path))).alias("_a"))
    two = b.select(F.col(path).alias("other")).distinct().select("other", F.explode(ancestors(F.col("other"))).alias("_b"))
    down = one.join(b.select(F.col(path).alias("other")).distinct(), F.col("_a") == F.col("other")).select(path, "other")
    up = two.join(a.select(path).distinct(), F.col("_b") == F.col(path)).select(path, "other")
    return down.union(up).distinct()


def member_hash(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Per key the SHA-256 of its rows as sorted lines of tab-separated columns; null counts as empty. A group is one folder's or revision's list and is gathered as such."""
    line = F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    return rows.groupBy(key).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("digest"), F.count("*").alias("n"))


def oldest(rows: DataFrame, order: list[Column], most: int, eligible: Column, change: dict[str, Column], key: str) -> DataFrame:
    """rows with `change` applied to the `most` first eligible ones."""
    first = rows.where(eligible).orderBy(*order).limit(most).select(key).withColumn("_hit", F.lit(True))
    out = rows.join(first, key, "left")
    return out.select(*(F.when(F.col("_hit"), change[c]).otherwise(F.col(c)).alias(c) if c in change else F.col(c) for c in rows.columns))


def batch_status(roots: DataFrame, batch: str, status: str) -> DataFrame:
    """Per batch the status that its roots' add up to: all succeeded, any running, any queued, failed (in part), cancelled, else pending."""
    has = lambda s: F.bool_or(F.col(status) == s)
    failed = F.when(has("succeeded"), "partial_failed").otherwise("failed")
    state = F.when(F.bool_and(F.coalesce(F.col(status) == "succeeded", F.lit(False))), "succeeded").when(has("running"), "running").when(has("queued"), "pending").when(has("failed"), failed).when(has("cancelled"), "cancelled").otherwise("pending")
    return roots.groupBy(batch).agg(state.alias("batch_status"))


def jobs_by_revision(jobs: DataFrame) -> DataFrame:
    """Per revision the last status of each type of job, one column a type."""
    last = F.max_by("status", F.struct("created", "job"))
    return jobs.groupBy("revision").pivot("type", ["mirror", "scrape", "library"]).agg(last)
