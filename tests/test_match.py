"""Tiered matches on rows worked out by hand."""

from pyspark.sql import functions as F

from tallgrass.operators.match import Tier, affected, tiered


def test_tiers(spark):
    left = spark.createDataFrame([(1, "x", "a"), (2, "y", "a"), (3, None, "b"), (4, "", "c"), (5, "two", "b"), (6, "two", "c"), (7, "z", None), (8, "no", "b")], "k int, p string, s string")
    right = spark.createDataFrame([("m", "x", "a", 1), ("m", "x", "a", 2), ("n", "y", "q", 3), ("o", "two", "b", 4), ("q", "two", "b", 5), (None, "z", "z", 6), ("r", "", "c", 7), ("r", None, "c", 8)], "b string, rp string, rs string, o int")
    only = [Tier("path", F.col("p"), F.col("rp")), Tier("side", F.col("s"), F.col("rs"))]
    got = {r.k: (r.partner, r.tier) for r in tiered(left, right, "k", "b", only, alone=F.concat(F.lit("own"), F.col("k"))).collect()}
    assert got == {1: ("m", "path"), 2: ("n", "path"), 3: ("own3", None), 4: ("r", "side"), 5: ("own5", None), 6: ("r", "side"), 7: ("own7", None), 8: ("own8", None)}
    for pick, want in (("first", "o"), ("last", "q")):
        tiers = [Tier("path", F.col("p"), F.col("rp"), pick), only[1]]
        assert {r.k: r.partner for r in tiered(left, right, "k", "b", tiers, order="o").collect()}[5] == want
    assert {r.partner for r in tiered(left, right.limit(0), "k", "b", only).collect()} == {None} and tiered(left.limit(0), right, "k", "b", only).count() == 0


def test_scopes(spark):
    left = spark.createDataFrame([(1, "r", "x"), (2, "q", "x"), (3, None, "x")], "k int, g string, p string")
    right = spark.createDataFrame([("a", "r", "x"), ("b", "q", "x"), ("c", None, "x")], "b string, g string, rp string")
    got = {r.k: r.partner for r in tiered(left, right, "k", "b", [Tier("p", F.col("p"), F.col("rp"))], "g").collect()}
    assert got == {1: "a", 2: "b", 3: None}


def test_affected(spark):
    items = spark.createDataFrame([(1, "p", "w", "s"), (2, "p", "v", "s"), (3, "q", "w", "s"), (4, "q", "v", "t")], "i int, plan string, work string, series string")
    targets = spark.createDataFrame([("p", "w", "s"), ("p", "w", "s"), ("q", "none", "s")], "plan string, tw string, ts string")
    got = {r.i: r.tier for r in affected(items, targets, "i", [Tier("work", F.col("work"), F.col("tw"))], "plan", Tier("series", F.col("series"), F.col("ts"))).collect()}
    assert got == {1: "work", 3: "series"}
