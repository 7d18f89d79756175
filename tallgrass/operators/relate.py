"""Joins by path, key sets and state, and set synchronisation. Prefix joins explode ancestors and stay equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ancestors(path: Column) -> Column:
    """A path and all its ancestors, '/' excluded."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), n), "/")))).otherwise(F.array().cast("array<string>"))


def subtree_closed(nodes: DataFrame, path: str, complete: Column) -> DataFrame:
    """Per distinct path: whether it and all its descendants among nodes are complete, and how many rows these are. Null paths and '/' are left out."""
    each = nodes.select(F.explode(ancestors(F.col(path))).alias(path), complete.alias("_c"))
    return nodes.select(path).distinct().join(each.groupBy(path).agg(F.bool_and("_c").alias("closed"), F.count("*").alias("n_nodes")), path)


def related(works: DataFrame, key: str, token: str) -> DataFrame:
    """Pairs of works (key < other) that share a token, with the number of shared tokens. One row of works for each token; repeats count once, nulls match nothing."""
    a = works.select(key, token).distinct()
    b = a.withColumnRenamed(key, "other")
    return a.join(b, token).where(F.col(key) < F.col("other")).groupBy(key, "other").agg(F.count("*").alias("shared"))


def audit(expected: DataFrame, actual: DataFrame, key: str, value: str) -> DataFrame:
    """key, verdict: missing, extra, mismatch or same. Keys are unique on both sides; a null key is missing or extra, null values are the same."""
    e, a = expected.select(key, F.col(value).alias("_e"), F.lit(1).alias("_in_e")), actual.select(key, F.col(value).alias("_a"), F.lit(1).alias("_in_a"))
    verdict = F.when(F.col("_in_a").isNull(), "missing").when(F.col("_in_e").isNull(), "extra").when(F.col("_e").eqNullSafe(F.col("_a")), "same").otherwise("mismatch")
    return e.join(a, key, "full").select(key, verdict.alias("verdict"))


def synced(local: DataFrame, remote: DataFrame, barred: DataFrame, keys: list[str]) -> DataFrame:
    """keys, action: pull what only remote has and isn't barred, push what only local has, already for the rest. Repeats count once; keys with a null match nothing; empty sides are fine."""
    one = lambda df, name: df.select(*keys).distinct().withColumn(name, F.lit(True))
    rows = one(local, "_l").join(one(remote, "_r"), keys, "full").join(one(barred, "_b"), keys, "left")
    action = F.when(F.col("_l") & F.col("_r"), "already").when(F.col("_l"), "push").when(F.col("_b").isNull(), "pull")
    return rows.withColumn("action", action).where("action IS NOT NULL").select(*keys, "action")


def unique_or_null(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per keys the value that all their rows agree on, else null. Null values don't count."""
    return rows.groupBy(*keys).agg(F.when(F.min(value) == F.max(value), F.min(value)).alias(value))
