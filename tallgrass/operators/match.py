"""Matches by keys of descending trust: the first tier that settles a row, in one shuffle of postings.

Each row of either side brings a posting (tier, value) for each tier it has a
value for. The right side's are summed up by (tier, value) first, partly before
the shuffle, so that a value which many rows share is one row in the join; then
each left row takes its smallest tier that gives a partner.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tier:
    """One way to meet: `left` and `right` are compared as text, a null or '' meets nothing. pick: 'only' takes a partner where exactly one distinct one has the value, 'first' and 'last' that of the smallest and greatest order."""

    name: str
    left: Column
    right: Column
    pick: str = "only"


def _postings(rows: DataFrame, columns: list[Column], keep: list[Column]) -> DataFrame:
    each = [F.struct(F.lit(i).alias("tier"), c.cast("string").alias("value")) for i, c in enumerate(columns)]
    return rows.select(*keep, F.explode(F.filter(F.array(*each), lambda p: F.coalesce(p["value"], F.lit("")) != "")).alias("_p")).select("*", "_p.*").drop("_p")


def tiered(left: DataFrame, right: DataFrame, key: str, partner: str, tiers: list[Tier], scope: str | None = None, order: str | None = None, alone: Column | None = None) -> DataFrame:
    """key, partner and tier (its name) for each row of left, with `alone` (default null) and a null tier where no tier settles it.

    key: unique in left. partner: right's column; rows of right without one are
    left out. scope: a column of both sides within which rows meet; a null
    scope meets nothing. order: right's column for 'first' and 'last', ties to
    the smaller and the greater partner. A tier whose value several partners
    share falls through to the next one.
    """
    order_by, own = F.col(order or partner), [F.col(scope).alias("_s")] if scope else [F.lit(0).alias("_s")]
    first, last = F.min(F.struct(F.col("_o"), F.col("_b"))), F.max(F.struct(F.col("_o"), F.col("_b")))
    rows = _postings(right.where(F.col(partner).isNotNull()), [t.right for t in tiers], [F.col(partner).alias("_b"), order_by.alias("_o"), *own])
    found = rows.groupBy("_s", "tier", "value").agg(F.min("_b").alias("_least"), F.max("_b").alias("_most"), first.alias("_first"), last.alias("_last"))
    pick = F.lit(None)
    for i, t in enumerate(tiers):
        one = {"only": F.when(F.col("_least") == F.col("_most"), F.col("_least")), "first": F.col("_first._b"), "last": F.col("_last._b")}[t.pick]
        pick = F.when(F.col("tier") == i, one).otherwise(pick)
    found = found.withColumn("_b", pick).where("_b IS NOT NULL").select("_s", "tier", "value", "_b")
    asked = _postings(left, [t.left for t in tiers], [F.col(key).alias("_k"), *own])
    best = asked.join(found, ["_s", "tier", "value"]).groupBy("_k").agg(F.min(F.struct("tier", "_b")).alias("_m"))
    names = F.array(*(F.lit(t.name) for t in tiers))
    rows = left.join(best, left[key] == best["_k"], "left")
    return rows.select(F.col(key), F.coalesce("_m._b", alone if alone is not None else F.lit(None)).alias("partner"), F.get(names, F.col("_m.tier")).alias("tier"))


def affected(items: DataFrame, targets: DataFrame, key: str, tiers: list[Tier], scope: str, fallback: Tier) -> DataFrame:
    """key and tier of the items that any target of their scope names by any tier; in scopes where no item is named so, those that `fallback` finds."""
    seen = [Tier(t.name, t.left, t.right, "first") for t in [*tiers, fallback]]
    found = tiered(items, targets.withColumn("_one", F.lit(1)), key, "_one", seen, scope).where("tier IS NOT NULL")
    found = found.join(items.select(key, scope), key)
    named = found.where(F.col("tier") != fallback.name).select(scope).distinct().withColumn("_named", F.lit(True))
    return found.join(named, scope, "left").where(F.col("_named").isNull() | (F.col("tier") != fallback.name)).select(key, "tier")
