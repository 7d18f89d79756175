"""Connected components of a graph in a DataFrame, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Nodes that have an edge, with the smallest node of their component: (node, component).

    Large-star and small-star steps (Kiveris et al., 2014) alternate until only
    stars are left. Each step is two shuffles of the edges; a node's neighbours
    are never gathered, as only their minimum is taken and joined back, so a
    hub is a skewed join key that Spark can split, not a list. Edges with a
    null end are ignored; self-edges keep a node as its own component.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull()).distinct()
    edges = stars = stored(pairs, "edges")
    nodes = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    while not _only_stars(stars.where("u > v")):
        done, stars = stars, stored(_small_star(_large_star(stars.where("u > v"))), "stars")
        if done is not edges:
            release(done)
    roots = stars.groupBy("u").agg(F.min("v").alias("v"))
    classes = stored(nodes.join(roots, nodes.node == roots.u, "left").select("node", F.coalesce("v", "node").alias("component")), "components")
    release(edges, *([stars] if stars is not edges else []))
    return classes


def _only_stars(pairs: DataFrame) -> bool:
    """Whether every node is either the larger end of one pair and of no other, or never the larger end."""
    ends = pairs.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("e")).select("e.*")
    return ends.groupBy("node").agg(F.sum("up").alias("ups"), F.count("*").alias("n")).where("ups > 0 AND n > 1").isEmpty()


def _large_star(pairs: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked with the node's smallest neighbour or itself."""
    both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked with the smallest of them."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    near = pairs.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.union(least.select("u", F.col("m").alias("v"))).where("u > v").distinct()
