"""Approximate nearest neighbours by cosine over low-dimensional stable projections.

Vectors of length one are projected by Gaussian (2-stable) random directions
to M dimensions: projected over true squared distance follows a chi-square law
with M degrees of freedom. A kd-tree over the projections gives a query's
neighbours in growing projected distance r; they are verified on the original
vectors until r**2 >= quantile * d**2, d being the k-th best distance found.
A true neighbour is then missed with a probability of at most 1 - CHANCE.

The tree's upper part splits all vectors into cells and is fitted on a bounded
sample; every vector is dealt into a cell. Cells are cut by salt into blocks of
bounded size, so that copies of one vector don't fill a task, and each block
has a kd-tree of its own. A query first searches its own cell; with the bound
from there it visits the cells that pass the same test. Visits carry ids only
until they are dealt; a block that many queries visit is dealt to several tasks.

Defined results: vectors that are null, zero, of another length than most, or
that hold null or non-finite components take no part, nor do rows without
vec_id; a row's own id is no candidate; rows of one vec_id are one candidate,
at its best score, and one query, by the smallest of their vectors.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import smallest, stored

M = 8
CHANCE = 0.98
#: Vectors that the upper tree is fitted on, rows in a block, and sampled vectors to a cell: beyond SAMPLE / FIT cells it is their blocks that grow in number.
SAMPLE, BLOCK, FIT = 16_384, 4096, 4
LEAF = 64
#: Visits in one Arrow batch, and about so many queries that meet one block in a task.
SLICE, ASKED = 10_000, 4096
_VISIT = "vec_id long, cell int, salt int, bound double"
_FOUND = "query_id long, vec_id long, score double"


def chi_square_quantile(p: float, m: int = M) -> float:
    """x with P(chi-square of m degrees <= x) = p, for even m, by bisection on the closed form."""
    below = lambda x: 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < p else (low, middle)
    return high


def directions(dim: int, m: int = M, seed: int = 42) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, m))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows in double precision times powers of two that bring their largest components near 1: no square overflows, no digit changes."""
    x = x.astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True, initial=0))[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


class Cells:
    """The upper kd-tree: median splits of a sample, all cells at one depth, as boxes that cover the whole space."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.splits: list[tuple[int, float]] = []
        boxes = [(np.full(sample.shape[1], -np.inf), np.full(sample.shape[1], np.inf), sample)]
        for _ in range(depth):
            lower = []
            for low, high, points in boxes:
                axis = int(np.ptp(points, axis=0).argmax()) if len(points) else 0
                at = float(np.median(points[:, axis])) if len(points) else 0.0
                self.splits.append((axis, at))
                left_high, right_low = high.copy(), low.copy()
                left_high[axis], right_low[axis] = min(at, high[axis]), max(at, low[axis])
                side = points[:, axis] < at
                lower += [(low, left_high, points[side]), (right_low, high, points[~side])]
            boxes = lower
        self.low, self.high = np.array([b[0] for b in boxes]), np.array([b[1] for b in boxes])

    def of(self, points: np.ndarray) -> np.ndarray:
        cell, first = np.zeros(len(points), dtype=np.int64), 0
        axes, at = np.array([s[0] for s in self.splits], dtype=np.int64), np.array([s[1] for s in self.splits])
        for level in range(self.depth):
            node = first + cell
            cell = 2 * cell + (points[np.arange(len(points)), axes[node]] >= at[node])
            first += 1 << level
        return cell

    def distances(self, point: np.ndarray) -> np.ndarray:
        """Squared distance from a point to every cell's box."""
        gap = np.maximum(0, np.maximum(self.low - point, point - self.high))
        return (gap * gap).sum(axis=1)


class Block:
    """A block's vectors with a kd-tree over their projections; of exact copies, only the `copies` smallest ids can be results."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, project: np.ndarray, copies: int):
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], np.ascontiguousarray(vectors[order])
        raw = vectors.view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel()
        _, same = np.unique(raw, return_inverse=True)
        by = np.argsort(same, kind="stable")
        run = same[by]
        place = np.arange(len(run)) - np.searchsorted(run, run)
        keep = by[place < copies]
        ids, vectors = ids[keep], scaled(vectors[keep])
        points = unit(vectors) @ project
        leaves, stack = [], [np.arange(len(ids))]
        while stack:
            part = stack.pop()
            if len(part) <= LEAF:
                leaves.append(part)
                continue
            axis = int(np.ptp(points[part], axis=0).argmax())
            part = part[np.argpartition(points[part, axis], len(part) // 2)]
            stack += [part[: len(part) // 2], part[len(part) // 2 :]]
        order = np.concatenate(leaves)
        self.ids, self.vectors, self.points = ids[order], vectors[order], points[order]
        self.norms = np.sqrt((self.vectors * self.vectors).sum(axis=1))
        self.ends = np.cumsum([len(x) for x in leaves])
        self.starts = self.ends - [len(x) for x in leaves]
        self.low = np.minimum.reduceat(self.points, self.starts)
        self.high = np.maximum.reduceat(self.points, self.starts)

    def search(self, query_id: int, vector: np.ndarray, point: np.ndarray, k: int, bound: float, quantile: float) -> tuple[np.ndarray, np.ndarray]:
        """ids and scores of the k best found. bound: a squared distance within which k others are known."""
        gap = np.maximum(0, np.maximum(self.low - point, point - self.high))
        near = (gap * gap).sum(axis=1)
        order = np.argsort(near, kind="stable")
        norm = np.sqrt((vector * vector).sum())
        ids, scores = np.empty(0, np.int64), np.empty(0)
        at, step = 0, 1
        while at < len(order) and near[order[at]] <= quantile * bound + 1e-9:
            leaves = order[at : at + step]
            rows = np.concatenate([np.arange(self.starts[x], self.ends[x]) for x in leaves])
            apart = self.points[rows] - point
            rows = rows[((apart * apart).sum(axis=1) <= quantile * bound + 1e-9) & (self.ids[rows] != query_id)]
            # Row by row sums: equal vectors get equal scores wherever they stand.
            score = (self.vectors[rows] * vector).sum(axis=1) / (self.norms[rows] * norm)
            ids, scores = np.append(ids, self.ids[rows]), np.append(scores, score)
            best = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[best], scores[best]
            if len(ids) == k:
                bound = min(bound, max(0.0, 2 - 2 * float(scores[-1])))
            at, step = at + step, step * 2
        return ids, scores


def _matrix(column) -> np.ndarray:
    """A column of equally long float lists as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 1), np.float32)


def _placed(cells: Cells, project: np.ndarray, salts: list[int] | None):
    """Vectors to their cells and, by vec_id, to one of the cell's salts."""

    def run(batches):
        for batch in batches:
            ids = batch.column("vec_id").to_numpy()
            cell = cells.of(unit(_matrix(batch.column("embedding"))) @ project) if len(ids) else np.empty(0, np.int64)
            out = [pa.array(cell.astype(np.int32))]
            if salts:
                hashed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                out.append(pa.array((hashed % np.array(salts, dtype=np.uint64)[cell]).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*out, *batch.columns], names=["cell", "salt"][: len(out)] + batch.schema.names)

    return run


def _visits(cells: Cells, project: np.ndarray, salts: list[int], quantile: float, home: bool):
    """Queries (vec_id, embedding, bound) to the blocks that they search: those of the home cell, or of the others that pass the test."""
    blocks = np.array(salts, dtype=np.int64)

    def run(batches):
        for batch in batches:
            points = unit(_matrix(batch.column("embedding"))) @ project if len(batch) else np.empty((0, 1))
            own = cells.of(points) if len(batch) else np.empty(0, np.int64)
            ids, bounds = batch.column("vec_id").to_numpy(), batch.column("bound").to_numpy()
            held: list[tuple] = []
            size = 0

            def taken(held):
                row, cell, salt = (np.concatenate(x) for x in zip(*held, strict=True))
                return pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(cell.astype(np.int32)), pa.array(salt.astype(np.int32)), pa.array(bounds[row])], names=["vec_id", "cell", "salt", "bound"])

            for n in range(len(batch)):
                near = own[n : n + 1] if home else np.flatnonzero(cells.distances(points[n]) <= quantile * bounds[n] + 1e-9)
                near = near if home else near[near != own[n]]
                cell = np.repeat(near, blocks[near])
                salt = np.arange(len(cell)) - np.repeat(np.cumsum(blocks[near]) - blocks[near], blocks[near])
                for at in range(0, len(cell), SLICE):
                    part = slice(at, at + SLICE)
                    if size + len(cell[part]) > SLICE:
                        yield taken(held)
                        held, size = [], 0
                    held.append((np.full(len(cell[part]), n), cell[part], salt[part]))
                    size += len(cell[part])
            if held:
                yield taken(held)

    return run


def _search(project: np.ndarray, k: int, quantile: float):
    def run(key, table):
        kind = table.column("kind").to_numpy()
        ids, vectors, bounds = table.column("vec_id").to_numpy(), _matrix(table.column("embedding")), table.column("bound").to_numpy()
        data, asked = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
        out: tuple[list, list, list] = ([], [], [])
        if len(data) and len(asked):
            block = Block(ids[data], vectors[data], project, k + 1)
            wide = scaled(vectors[asked])
            for n, vector, point in zip(asked.tolist(), wide, unit(wide) @ project, strict=True):
                found, scores = block.search(int(ids[n]), vector, point, k, float(bounds[n]), quantile)
                out[0].append(np.full(len(found), ids[n])), out[1].append(found), out[2].append(scores)
        a, b, c = (np.concatenate(x) if x else np.empty(0) for x in out)
        return pa.table([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), pa.array(c.astype(np.float64))], names=["query_id", "vec_id", "score"])

    return run


def usable(embedding: Column, dim: int | None = None) -> Column:
    """Whether a vector is finite, not zero and of length dim."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    found = embedding.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(embedding, lambda x: x != 0)
    return found if dim is None else found & (F.size(embedding) == dim)


def _best(found: DataFrame, k: int) -> DataFrame:
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, m: int = M, chance: float = CHANCE, seed: int = 42) -> DataFrame:
    """Per query of `queries` its k nearest in `vectors`: query_id, rank, vec_id, score. Both have vec_id and embedding."""
    kind = "array<float>" if isinstance(vectors.schema["embedding"].dataType.elementType, FloatType) else "array<double>"
    kept = lambda df, dim=None: df.select("vec_id", F.col("embedding").cast(kind).alias("embedding")).where(F.col("vec_id").isNotNull() & usable(F.col("embedding"), dim))
    none = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = smallest(kept(vectors), F.xxhash64("vec_id"), SAMPLE, "vec_id").toArrow().column("embedding")
    if not len(sample):
        return none
    sizes = pc.list_value_length(sample).to_pylist()
    dim = max(sorted(set(sizes)), key=sizes.count)
    project = directions(dim, m, seed)
    rows = kept(vectors, dim)
    fitted = unit(_matrix(sample.filter(pc.equal(pc.list_value_length(sample), dim)))) @ project
    wanted = min(SAMPLE // FIT, -(-rows.count() // BLOCK))
    cells = Cells(fitted, max(0, math.ceil(math.log2(max(1, wanted)))))
    counts = dict(rows.mapInArrow(_placed(cells, project, None), f"cell int, vec_id long, embedding {kind}").groupBy("cell").count().collect())
    salts = [max(1, -(-counts.get(n, 0) // BLOCK)) for n in range(1 << cells.depth)]
    quantile = chi_square_quantile(chance, m)
    blocks = rows.mapInArrow(_placed(cells, project, salts), f"cell int, salt int, vec_id long, embedding {kind}")
    blocks = blocks.select("cell", "salt", F.lit(0).alias("kind"), "vec_id", "embedding", F.lit(0.0).alias("bound"))
    asked = kept(queries, dim).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))

    def searched(bounded: DataFrame, home: bool) -> DataFrame:
        visits = stored(bounded.select("vec_id", "embedding", "bound").mapInArrow(_visits(cells, project, salts, quantile, home), _VISIT), "visits")
        asks = F.broadcast(visits.groupBy("cell", "salt").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("asks")))
        met = visits.join(asks, ["cell", "salt"]).withColumn("ask", F.pmod(F.xxhash64("vec_id"), F.col("asks")).cast("int"))
        met = met.join(asked, "vec_id").select("cell", "salt", "ask", F.lit(1).alias("kind"), "vec_id", "embedding", "bound")
        data = blocks.join(asks, ["cell", "salt"]).withColumn("ask", F.explode(F.sequence(F.lit(0), F.col("asks") - 1)))
        data = data.select("cell", "salt", "ask", "kind", "vec_id", "embedding", "bound")
        return data.unionByName(met).groupBy("cell", "salt", "ask").applyInArrow(_search(project, k, quantile), _FOUND)

    first = stored(_best(searched(asked.withColumn("bound", F.lit(float("inf"))), True), k), "near")
    # The k-th best of the home cell bounds what other cells have to beat; without k candidates nothing does.
    bounds = first.where(F.col("rank") == k).select(F.col("query_id").alias("q"), F.greatest(F.lit(0.0), 2 - 2 * F.col("score")).alias("b"))
    bounded = asked.join(bounds, asked.vec_id == bounds.q, "left").withColumn("bound", F.coalesce("b", F.lit(float("inf"))))
    more = searched(bounded, False)
    return _best(first.select("query_id", "vec_id", "score").unionByName(more), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
