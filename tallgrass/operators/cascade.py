"""Deletes and moves over tables that refer to one another.

Tables are DataFrames by name, each with a key; links are their foreign keys. A
delete follows the links by semi-joins to a fixed point, each round from the
rows that the last one found, so that links may form cycles. Key sets stay
DataFrames throughout. Null keys and references meet nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Link:
    """child.column refers to parent's key. rule: 'delete' takes the child rows along; 'null' empties the column; 'last' deletes a parent row that no child row refers to any more."""

    child: str
    column: str
    parent: str
    rule: str = "delete"


def deleted(tables: dict[str, DataFrame], keys: dict[str, str], links: list[Link], doomed: dict[str, DataFrame], cut: Callable[[DataFrame], DataFrame] | None = None) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """The tables without the doomed rows and all that goes with them, and the keys (column 'key') that went from each.

    doomed: DataFrames of one column of keys by table; keys that a table lacks
    are ignored. Rows of 'last' parents that never had a child go, too. cut:
    how lineage is cut between rounds; DataFrame.checkpoint by default.
    """
    cut = cut or (lambda df: df.checkpoint())
    key = lambda t: tables[t].select(F.col(keys[t]).alias("key")).where("key IS NOT NULL")
    gone = {t: key(t).limit(0) for t in tables}
    fresh = {t: key(t).join(d.toDF("key"), "key", "left_semi").distinct() for t, d in doomed.items()}
    while True:
        while fresh:
            found: dict[str, list[DataFrame]] = {}
            for t, rows in list(fresh.items()):
                rows = cut(rows.join(gone[t], "key", "left_anti"))
                if rows.isEmpty():
                    continue
                gone[t] = gone[t].union(rows)
                for link in (x for x in links if x.parent == t and x.rule == "delete"):
                    hit = tables[link.child].join(rows.select(F.col("key").alias(link.column)), link.column, "left_semi")
                    found.setdefault(link.child, []).append(hit.select(F.col(keys[link.child]).alias("key")).where("key IS NOT NULL"))
            fresh = {t: reduce(DataFrame.union, some).distinct() for t, some in found.items()}
        for link in (x for x in links if x.rule == "last"):
            left = _without(tables[link.child], keys[link.child], gone[link.child]).select(F.col(link.column).alias("key"))
            alone = cut(key(link.parent).join(left, "key", "left_anti").join(gone[link.parent], "key", "left_anti").distinct())
            if not alone.isEmpty():
                fresh[link.parent] = alone
        if not fresh:
            break
    kept = {t: _without(rows, keys[t], gone[t]) for t, rows in tables.items()}
    for link in (x for x in links if x.rule == "null"):
        lost = gone[link.parent].select(F.col("key").alias("_k")).withColumn("_lost", F.lit(True))
        rows = kept[link.child].join(lost, F.col(link.column) == F.col("_k"), "left")
        kept[link.child] = rows.withColumn(link.column, F.when(F.col("_lost").isNull(), F.col(link.column))).drop("_k", "_lost")
    return kept, gone


def _without(rows: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    return rows.join(gone.select(F.col("key").alias(key)), key, "left_anti").select(*rows.columns)


def moved(rows: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """rows with `column` changed from mapping's old to its new values; of several new ones the smallest."""
    to = mapping.groupBy(F.col("old").alias("_old")).agg(F.min("new").alias("_new"))
    return rows.join(to, F.col(column) == F.col("_old"), "left").withColumn(column, F.coalesce("_new", column)).drop("_old", "_new").select(*rows.columns)


def promoted(tables: dict[str, DataFrame], keys: dict[str, str], links: list[Link], root: str, mapping: DataFrame, stay: list[str], busy: DataFrame | None = None) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Roots that a new root above covers, merged into it (mapping: old, new keys of table `root`).

    Rows of the tables in `stay` are moved to the new root and live on; the old
    roots go, with everything else that refers to them. busy: keys of old roots
    with open jobs; one of them in the mapping is an error, before anything is
    changed.
    """
    if busy is not None and not mapping.join(busy.toDF("old"), "old", "left_semi").isEmpty():
        raise ValueError("a covered root has open jobs")
    tables = dict(tables)
    for link in links:
        if link.parent == root and link.child in stay:
            tables[link.child] = moved(tables[link.child], link.column, mapping)
    return deleted(tables, keys, links, {root: mapping.where("old != new").select("old")})


def tallied(kept: dict[str, DataFrame], gone: dict[str, DataFrame]) -> DataFrame:
    """name, deleted (keys that went) and left (rows that stay) of every table."""
    return reduce(DataFrame.union, (gone[t].agg(F.lit(t).alias("name"), F.count("*").alias("deleted")).crossJoin(kept[t].agg(F.count("*").alias("left"))) for t in kept))


def converged(projected: DataFrame, current: DataFrame, desired: DataFrame) -> DataFrame:
    """Rows of a projection (revision, library) of current revisions (revision) that these still want (desired: revision, library)."""
    return projected.join(current.select("revision").distinct(), "revision", "left_semi").join(desired.select("revision", "library").distinct(), ["revision", "library"], "left_semi").select(*projected.columns)
