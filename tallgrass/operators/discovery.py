"""Discovery of units in a tree of folders that is scanned bit by bit.

A folder is closed when it is scanned and all its child folders are closed. The
state keeps, for each folder, how many of its children are open; a batch of
scans changes some folders' counters, a folder whose counter reaches zero
closes and counts down its parent's, and so on upwards. Only the batch's folders
and those above them take part: a batch costs what it touches times the depth,
not the size of the tree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .relate import ancestors

STATE = "folder string, parent string, done boolean, open int, closed int, candidate boolean, emitted int"
SCANS = "folder string, parent string, ok boolean, children array<string>, candidate boolean"


def advanced(state: DataFrame, scans: DataFrame, batch: int, cut: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """The state after a batch of scans (SCANS), and the units that left in it (folder, closed).

    A scan that failed (not ok) opens its folder until a later one succeeds; a
    scan again replaces the folder's children, and new ones open it and all
    above it. A folder's rows in one batch count as one, a good scan before a
    failed one. A unit is a candidate without a candidate above it, and leaves
    once, in the batch in which it closes. Null folders are left out. cut: how
    lineage is cut between levels; DataFrame.checkpoint by default, which needs
    spark.checkpoint.dir.
    """
    cut = cut or (lambda df: df.checkpoint())
    new = scans.where("folder IS NOT NULL").groupBy("folder").agg(F.max(F.struct("ok", "parent", "children", "candidate")).alias("s"))
    new = cut(new)
    children = new.where("s.ok").select(F.col("folder").alias("parent"), F.explode(F.array_distinct("s.children")).alias("folder")).where("folder IS NOT NULL")
    met = new.select("folder").union(children.select("folder"))
    touched = met.select(F.explode(ancestors(F.col("folder"))).alias("folder")).distinct()
    known = state.join(touched, "folder", "left_semi")
    own = children.groupBy("folder").agg(F.max("parent").alias("p"))
    work = known.join(new, "folder", "full").join(own, "folder", "full")
    work = work.select(
        "folder", F.coalesce("s.parent", "p", "parent").alias("parent"), F.coalesce("s.ok", "done", F.lit(False)).alias("done"), F.coalesce("open", F.lit(0)).alias("open"), "closed",
        F.coalesce("s.candidate", "candidate", F.lit(False)).alias("candidate"), "emitted", F.col("s").isNotNull().alias("scanned"),
    )
    # A scanned folder's counter starts anew from its children as they stand.
    standing = children.join(work.select("folder", F.col("closed").alias("c")), "folder", "left").groupBy(F.col("parent").alias("folder")).agg(F.count_if(F.col("c").isNull()).cast("int").alias("n"))
    work = work.join(standing, "folder", "left").withColumn("open", F.when(F.col("scanned"), F.coalesce("n", F.lit(0))).otherwise(F.col("open"))).drop("n", "scanned")
    work = work.withColumn("was", F.col("closed").isNotNull())
    shut = F.col("done") & (F.col("open") == 0)
    while True:
        work = cut(work.withColumn("closed", F.when(shut, F.coalesce("closed", F.lit(batch)))))
        flips = work.where(F.col("closed").isNotNull() != F.col("was"))
        if flips.isEmpty():
            break
        step = flips.groupBy(F.col("parent").alias("folder")).agg(F.sum(F.when(F.col("was"), 1).otherwise(-1)).cast("int").alias("d"))
        work = work.withColumn("was", F.col("closed").isNotNull()).join(step, "folder", "left").withColumn("open", F.greatest(F.col("open") + F.coalesce("d", F.lit(0)), F.lit(0))).drop("d")
    work = work.drop("was")
    after = state.join(touched, "folder", "left_anti").unionByName(work)
    ready = work.where("candidate AND emitted IS NULL AND closed IS NOT NULL")
    above = ready.select(F.col("folder").alias("unit"), F.explode(ancestors(F.col("folder"))).alias("folder")).where("folder != unit")
    owned = above.join(after.where("candidate").select("folder"), "folder").select(F.col("unit").alias("folder")).distinct()
    units = cut(ready.join(owned, "folder", "left_anti").select("folder", "closed"))
    left = units.select("folder", F.lit(batch).alias("now"))
    after = after.join(left, "folder", "left").withColumn("emitted", F.coalesce("emitted", "now")).drop("now")
    return after.select("folder", "parent", "done", "open", "closed", "candidate", "emitted"), units
