"""Commits of folder listings that arrive page by page.

A page's rows have run, root, folder, generation, page, total (the folder's
members as the source tells them, or null), last (whether it is the run's last
page), path, name, kind, size and mtime; an empty folder's page is one row with
a null path. Nodes have root, path (together the key), parent, name, kind,
size, mtime, first_seen, last_seen and tombstone ('' while alive); folders have
root, path, parent, depth, state, accepted, n_entries, member_hash,
verified_at, due_at. Each result is one plan over whole tables: many folders
are committed at once, by joins on (root, path).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.functions.score import due_at

from .catalog import member_hash
from .relate import ancestors

PAGES = "run string, root string, folder string, generation int, page int, total long, last boolean, path string, name string, kind string, size long, mtime double"
NODES = "root string, path string, parent string, name string, kind string, size long, mtime double, first_seen int, last_seen int, tombstone string"
FOLDERS = "root string, path string, parent string, depth int, state string, accepted int, n_entries long, member_hash string, verified_at timestamp, due_at timestamp"


def verdicts(pages: DataFrame) -> DataFrame:
    """Per run: root, folder, generation, n (entries) and verdict.

    'repeated': a path came twice, on one page or on two. 'drift': pages tell
    different totals. 'over': more entries than the total. 'open': not all pages
    up to the last one yet, and fewer entries than the total. 'short': all pages
    are there and have fewer entries than the total. Else 'complete'.
    """
    runs = pages.groupBy("run").agg(
        F.min("root").alias("root"), F.min("folder").alias("folder"), F.max("generation").alias("generation"), F.count("path").alias("n"), F.max("total").alias("total"),
        (F.min("total") != F.max("total")).alias("differ"), (F.count("total") > 0).alias("told"), F.bool_or(F.col("total").isNull()).alias("untold"), (F.count_distinct("page") >= F.max(F.when(F.col("last"), F.col("page")))).alias("last"),
    )
    repeated = pages.where("path IS NOT NULL").groupBy("run", "path").count().where("count > 1").select("run").distinct().withColumn("repeated", F.lit(True))
    verdict = F.when(F.col("repeated"), "repeated").when(F.col("differ") | (F.col("told") & F.col("untold")), "drift").when(F.col("n") > F.col("total"), "over")
    verdict = verdict.when((F.col("n") == F.col("total")) | (F.col("total").isNull() & F.col("last")), "complete").when(F.col("last"), "short").otherwise("open")
    # Pages can come in any order: `last` is null or false until all are there.
    return runs.join(repeated, "run", "left").select("run", "root", "folder", "generation", "n", verdict.alias("verdict"))


def fenced(runs: DataFrame, roots: DataFrame) -> DataFrame:
    """Verdicts of runs with those of complete ones against the roots' (root, active) generations: 'stale' below the active one, 'superseded' where a later run of the same folder is complete, 'accepted'. A root that isn't known fences nothing."""
    done = (F.col("verdict") == "complete") & ~F.coalesce(F.col("active") > F.col("generation"), F.lit(False))
    first = F.row_number().over(Window.partitionBy("root", "folder", done).orderBy(F.col("generation").desc(), F.col("run").desc())) == 1
    verdict = F.when(F.col("verdict") != "complete", F.col("verdict")).when(~done, "stale").when(first, "accepted").otherwise("superseded")
    return runs.join(roots.groupBy("root").agg(F.max("active").alias("active")), "root", "left").select("run", "root", "folder", "generation", "n", verdict.alias("verdict"))


def merged(nodes: DataFrame, pages: DataFrame, runs: DataFrame, stamp: str) -> DataFrame:
    """nodes after the accepted runs, with `change`: added, updated, unchanged, missing or null (not touched).

    A child that a complete listing lacks gets the tombstone `stamp`, unless it
    was seen at the run's generation or later; a folder that goes takes all
    below it along. A listed child loses its tombstone.
    """
    accepted = runs.where("verdict = 'accepted'").select("run", "root", F.col("folder").alias("parent"), "generation")
    listed = pages.where("path IS NOT NULL").join(accepted.select("run", "generation").withColumnRenamed("generation", "_at"), "run")
    listed = listed.groupBy("root", "path").agg(F.max(F.struct("folder", "name", "kind", "size", "mtime", "_at")).alias("p"))
    known = nodes.join(accepted.select("root", "parent", F.col("generation").alias("at")), ["root", "parent"], "left").select(*nodes.columns, "at")
    both = known.join(listed, ["root", "path"], "full")
    same = F.col("kind").eqNullSafe(F.col("p.kind")) & F.col("size").eqNullSafe(F.col("p.size")) & F.col("mtime").eqNullSafe(F.col("p.mtime"))
    alive = F.coalesce("tombstone", F.lit("")) == ""
    gone = F.col("at").isNotNull() & alive & (F.col("last_seen") < F.col("at"))
    change = F.when(F.col("p").isNotNull(), F.when(F.col("last_seen").isNull(), "added").when(same, "unchanged").otherwise("updated")).when(gone, "missing")
    marked = both.withColumn("change", change)
    lost = marked.where("change = 'missing' AND kind = 'dir'").select("root", F.col("path").alias("_a"))
    below = nodes.select("root", "path", F.explode(ancestors(F.col("path"))).alias("_a")).where("_a != path").join(lost, ["root", "_a"]).select("root", "path").distinct().withColumn("_lost", F.lit(True))
    out = marked.join(below, ["root", "path"], "left")
    change = F.when(F.col("_lost"), F.when(alive, "missing")).otherwise(F.col("change"))
    out = out.withColumn("change", change)
    seen = F.col("change").isin("added", "updated", "unchanged")
    take = lambda c: F.when(seen, F.col(f"p.{c}")).otherwise(F.col(c)).alias(c)
    tombstone = F.when(seen, "").when(F.col("change") == "missing", stamp).otherwise(F.coalesce("tombstone", F.lit("")))
    first, last = F.coalesce("first_seen", "p._at").alias("first_seen"), F.when(seen, F.col("p._at")).otherwise(F.col("last_seen")).alias("last_seen")
    return out.select("root", "path", F.coalesce("parent", "p.folder").alias("parent"), F.coalesce("name", "p.name").alias("name"), take("kind"), take("size"), take("mtime"), first, last, tombstone.alias("tombstone"), "change", F.col("mtime").alias("old_mtime"), F.col("kind").alias("old_kind"))


def queued(folders: DataFrame, changed: DataFrame, pages: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """folders after the accepted runs (changed: what `merged` gives).

    A committed folder is complete, with its members' hash and when it is due
    again. A listed folder is queued if it is new, or if its time of change is
    known and another than before (one that is being scanned stays so); with no
    known time before, it waits for its verification. A folder that went, and
    all below it, are dropped.
    """
    accepted = runs.where("verdict = 'accepted'")
    listed = pages.where("path IS NOT NULL").join(accepted.select("run"), "run")
    digest = member_hash(listed.withColumn("_t", F.floor("mtime")), "run", ["path", "kind", "size", "_t"]).drop("n")
    done = accepted.join(digest, "run", "left").select("root", F.col("folder").alias("path"), F.struct(F.col("generation").alias("accepted"), F.col("n").alias("n_entries"), F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("member_hash")).alias("d"))
    inner = changed.where("kind = 'dir' AND change IN ('added', 'updated', 'unchanged')")
    differ = F.col("old_mtime").isNotNull() & F.col("mtime").isNotNull() & (F.col("old_mtime") != F.col("mtime"))
    unknown = F.col("old_mtime").isNull() & F.col("mtime").isNotNull() & F.coalesce(F.col("old_kind") == "dir", F.lit(False))
    inner = inner.select("root", "path", F.struct(F.col("parent").alias("parent"), differ.alias("differ"), unknown.alias("unknown")).alias("c"))
    lost = changed.where("change = 'missing' AND kind = 'dir'").select("root", F.col("path").alias("_a"))
    gone = folders.select("root", "path", F.explode(ancestors(F.col("path"))).alias("_a")).join(lost, ["root", "_a"]).select("root", "path").distinct()
    old = folders.join(gone, ["root", "path"], "left_anti").withColumn("_old", F.lit(True))
    rows = old.join(inner, ["root", "path"], "full").join(done, ["root", "path"], "left")
    rows = rows.where("_old OR NOT c.unknown")
    state = F.when(F.col("d").isNotNull(), "complete").when(F.col("_old").isNull() | (F.col("c.differ") & (F.col("state") != "scanning")), "queued").otherwise(F.col("state"))
    fresh = lambda c: F.coalesce(f"d.{c}", c).alias(c)
    when = lambda c, v: F.when(F.col("d").isNotNull(), v).otherwise(F.col(c)).alias(c)
    depth = F.coalesce("depth", F.size(F.filter(F.split("path", "/"), lambda x: x != "")).cast("int"))
    return rows.select("root", "path", F.coalesce("parent", "c.parent").alias("parent"), depth.alias("depth"), state.alias("state"), fresh("accepted"), fresh("n_entries"), fresh("member_hash"), when("verified_at", now), when("due_at", due_at(now, F.col("path"))))


def baseline_completed(roots: DataFrame, finished: DataFrame) -> DataFrame:
    """roots (root, target, completed) with `completed` set by finished (root, generation) only where that is the root's target still: an earlier job that ends late changes nothing."""
    done = finished.select("root", F.col("generation").alias("target")).distinct().withColumn("_done", F.lit(True))
    return roots.join(done, ["root", "target"], "left").select("root", "target", F.when(F.col("_done"), F.col("target")).otherwise(F.col("completed")).alias("completed"))
