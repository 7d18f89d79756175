"""Mixing sources to target weights by weighted fair queueing, on the JVM only.

Documents of a source are shuffled by a hash and pass up to `repeats` times.
A pass of a document ends at the virtual time (words of its source up to and
with it) / (target of its source). All passes are ranked by that time over all
sources and taken until the total budget is used: at time 1 each source has
given its target.

Running sums never put a source into one task: a source's documents are dealt
into slots of bounded size, the slots' totals are summed up, and a window runs
within each slot. The cut in the global ranking is found by sums over a grid
of virtual times, refined once, then by ranking the passes of one grid cell.

Defined results: a null text has size 0; null sources form a source of their
own, last in order; a source of size 0 has target 0; rows that are equal in
doc_id, source and text are decided together; documents of no words pass at
their time but take no words. Equal times go by hash, then doc_id.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import floor

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, stored

#: Units in a slot, about.
SLOT = 4096
GRID = 1 << 10


@dataclass
class Cut:
    """The last pass that is taken: passes rank by (virtual time, hash, doc_id). all: every pass is."""

    time: float = 0.0
    key: int = 0
    doc_id: int | None = None
    all: bool = False


def targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, repeats: int = 2) -> DataFrame:
    """Adds target: weighted shares of `share` times all sizes, none above `repeats` times its source's size.

    sources (source, source_size) has a row for each source. What a capped
    source leaves is shared by weight among the others: sources are capped in
    order of cap / weight up to the level that uses the budget.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    rows = sources.withColumn("weight", F.get(F.array(*map(F.lit, weights)), (F.row_number().over(every) - 1) % len(weights)).cast("double"))
    rows = rows.withColumn("cap", F.lit(float(repeats)) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    rows = rows.withColumn("budget", F.lit(share) * F.sum("source_size").over(whole))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("left", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    rows = rows.withColumn("open", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    # The level at which the sources from this one on use what is left; the first that stays under its cap holds.
    level = F.min(F.when(F.col("left") / F.col("open") <= F.col("ratio"), F.struct("ratio", (F.col("left") / F.col("open")).alias("level")))).over(whole)["level"]
    return rows.withColumn("target", F.coalesce(F.least("cap", F.col("weight") * level), "cap")).select("source", "source_size", "target")


def _units(docs: DataFrame, seed: int) -> DataFrame:
    """Rows that are decided together: source, doc_id, fp, copies, size of each, key."""
    fp = F.xxhash64("text")
    rows = docs.select("doc_id", "source", fp.alias("fp"), n_words(F.col("text")).alias("size"))
    units = rows.groupBy("source", "doc_id", "fp").agg(F.count("*").alias("copies"), F.first("size").alias("size"))
    return units.withColumn("key", F.xxhash64(F.lit(seed), "doc_id", "fp"))


def _timed(units: DataFrame, n_units: int, weights: tuple[int, ...], share: float, repeats: int) -> DataFrame:
    """Adds source_size, target and done: the words of the source up to and with the unit, in shuffled order."""
    slots = max(1, -(-n_units // SLOT))
    units = units.withColumn("slot", F.pmod(F.xxhash64(F.lit(1), "key"), F.lit(slots))).withColumn("words", F.col("copies") * F.col("size"))
    sums = units.groupBy("source", "slot").agg(F.sum("words").alias("words"))
    before = Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("offset", F.coalesce(F.sum("words").over(before), F.lit(0))).drop("words")
    sources = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, repeats)
    offsets = offsets.join(sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    offsets = offsets.withColumnsRenamed({"source": "s", "slot": "k"})
    rows = units.join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("slot") == F.col("k"))).drop("s", "k")
    within = Window.partitionBy("source", "slot").orderBy("key", "doc_id", "fp").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("done", F.col("offset") + F.sum("words").over(within)).drop("slot", "offset")


def _time(n: int) -> F.Column:
    return F.when(F.col("target") > 0, (F.col("done") + n * F.col("source_size")) / F.col("target"))


def _cell(column: F.Column, last: int) -> F.Column:
    return F.least(F.floor(column), F.lit(last)).cast("long")


def _crossing(sums: DataFrame, budget: float) -> tuple[int | None, float]:
    """The cell in which the running sum passes the budget, and the sum before it. At most 2 * GRID + 1 rows come to the driver."""
    total = 0.0
    for cell, words in sorted((r[0], r[1]) for r in sums.collect()):
        if total + words > budget:
            return cell, total
        total += words
    return None, total


def _cut(timed: DataFrame, budget: float, repeats: int) -> Cut:
    passes = timed.where("words > 0").select("key", "doc_id", "words", F.explode(F.array(*(_time(n) for n in range(repeats)))).alias("time"))
    passes = passes.withColumn("cell", _cell(F.col("time") * GRID, 2 * GRID))
    cell, before = _crossing(passes.groupBy("cell").agg(F.sum("words")), budget)
    if cell is None:
        return Cut(all=True)
    near = passes.where(F.col("cell") == cell).withColumn("sub", _cell((F.col("time") * GRID - cell) * GRID, 2 * GRID))
    sub, inner = _crossing(near.groupBy("sub").agg(F.sum("words")), budget - before)
    order = ["time", "key", F.col("doc_id").asc_nulls_first()]
    running = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    last = near.where(F.col("sub") == sub).withColumn("sum", F.sum("words").over(running)).where(F.col("sum") <= budget - before - inner)
    found = last.orderBy(F.desc("time"), F.desc("key"), F.col("doc_id").desc_nulls_last()).select("time", "key", "doc_id").first()
    if found:
        return Cut(found[0], found[1], found[2])
    return Cut((cell + sub / GRID) / GRID, -(1 << 63), None)


def mixed(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, repeats: int = 2, seed: int = 42) -> DataFrame:
    """Per unit: source, doc_id, fp, copies, size, source_size, target, passes (how often each of its rows is taken)."""
    units = stored(_units(docs, seed), "units")
    timed = stored(_timed(units, units.count(), weights, share, repeats), "timed")
    total = timed.agg(F.sum("words")).first()[0] or 0
    cut = _cut(timed, floor(share * total), repeats)
    if cut.all:
        passes = F.lit(repeats)
    else:
        last = F.struct(F.lit(cut.time).alias("t"), F.lit(cut.key).cast("long").alias("k"), F.lit(cut.doc_id).cast(timed.schema["doc_id"].dataType).alias("d"))
        taken = lambda n: F.coalesce(F.struct(_time(n).alias("t"), F.col("key").alias("k"), F.col("doc_id").alias("d")) <= last, F.lit(False))
        passes = sum((taken(n).cast("int") for n in range(repeats)), F.lit(0))
    return timed.withColumn("passes", passes).drop("words", "done", "key")


def taken(docs: DataFrame, **how) -> DataFrame:
    """Per row of docs: doc_id, size, source_size, target, taken (words the mix takes, repeats counted)."""
    rows = mixed(docs, **how).withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("passes") * F.col("size")).cast("long").alias("taken"))


def apply_mix(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: docs' rows, each as often as it is taken, with docs' own columns, whatever their names."""
    plan = mixed(docs, **how).select(F.col("doc_id").alias("d"), F.col("source").alias("s"), F.col("fp").alias("f"), "passes").where("passes > 0")
    same = F.col("row.doc_id").eqNullSafe(F.col("d")) & F.col("row.source").eqNullSafe(F.col("s")) & (F.col("fp") == F.col("f"))
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64("text").alias("fp")).join(plan, same)
    return rows.withColumn("pass", F.explode(F.array_repeat(F.lit(0), F.col("passes")))).select("row.*")
