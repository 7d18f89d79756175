"""Merkle manifest of a dataset: leaves, nodes, roots and proofs.

Leaves of one tree are numbered in order; every ARITY consecutive nodes become
one parent, level by level, until one is left. Numbers come from a range
partitioned sort and counts by partition, so no task sees a whole tree.

Building is an event-driven combine by parent. A task keeps indexed child
digests under their parent's key until the parent's arity, which follows from
its tree's size, is met; the parent is then emitted at once and is a child
itself. What a task can't complete is its frontier. Frontiers are dealt again
by blocks of ARITY ** (LEVELS * round) leaves: whatever lies below a block's
root was completed in the round before, so a block holds at most ARITY **
LEVELS nodes, and a tree of n leaves takes log(n) / LEVELS rounds.

Proofs follow the reverse links, from a node's number to its parent's (number
div ARITY), downwards: a block gets the siblings on the way from its own root
to the tree's root, adds its nodes' families, and hands them to the blocks
below; the lowest blocks give the documents' proofs. A document meets at most
ARITY ** LEVELS others in a group.

Defined results: trees are told apart by `lang`, null and '' being two; rows
ascend by doc_id, null first, and rows of one doc_id by leaf digest (equal
rows are interchangeable). A leaf hashes '-' for null and else byte count, ':'
and value. Columns named otherwise are not read. A very long text is one value
like others. An empty table has no rows and no root.
"""

from __future__ import annotations

import hashlib
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import release, stored

#: Children of a node, and levels that a block spans.
ARITY, LEVELS = 8, 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_NODE = "tree long, n long, level int, idx long, digest string, top boolean"
_HIGH, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest_of(*values: Column) -> Column:
    """A leaf: SHA-256 of all values in turn, each '-' if null, else UTF-8 byte count, ':' and value."""
    one = lambda v: F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*map(one, values)), 256)


def counts(n: int, level: int) -> int:
    """Nodes at a level of a tree of n leaves."""
    for _ in range(level):
        n = -(-n // ARITY)
    return n


def height(n: int) -> int:
    """Levels above the leaves."""
    level = 0
    while n > 1:
        n, level = -(-n // ARITY), level + 1
    return level


def combined(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def _climb(batches):
    """Nodes of a task, in any order, to all nodes that they complete (done) and the frontier that they leave."""
    partial: dict[tuple, dict[int, str]] = {}
    size: dict[tuple, int] = {}  # nodes at (n, level)

    def out(rows: list):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()))], names=["tree", "n", "level", "idx", "digest", "top", "done"])

    for batch in batches:
        made = []
        for tree, n, level, idx, digest in zip(*(batch.column(c).to_pylist() for c in ("tree", "n", "level", "idx", "digest")), strict=True):
            while True:
                here = size.get((n, level))
                if here is None:
                    here = size[n, level] = counts(n, level)
                if here == 1:
                    made.append((tree, n, level, 0, digest, True, True))
                    break
                parent = idx // ARITY
                children = partial.setdefault((tree, n, level, parent), {})
                children[idx] = digest
                if len(children) < min(ARITY, here - ARITY * parent):
                    break
                del partial[tree, n, level, parent]
                made.extend((tree, n, level, i, d, False, True) for i, d in children.items())
                digest, idx, level = combined([children[i] for i in sorted(children)]), parent, level + 1
        yield out(made)
    yield out([(tree, n, level, i, d, False, False) for (tree, n, level, _), children in partial.items() for i, d in children.items()])


def _block(level: int) -> Column:
    """The number, at `level`, of the node above (tree, level, idx): of the block that holds it."""
    return F.floor(F.col("idx") / F.pow(F.lit(float(ARITY)), F.lit(level) - F.col("level"))).cast("long")


def build(leaves: DataFrame, most: int) -> DataFrame:
    """All nodes of all trees, leaves among them: tree, n, level, idx, digest and top (whether it is the tree's root); stored.

    leaves: tree, n (leaves of the tree), idx and digest, best as they lie in
    order. most: leaves of the largest tree.
    """
    frontier, found = leaves.select("tree", "n", F.lit(0).alias("level"), "idx", "digest"), []
    rounds = max(1, math.ceil(height(most) / LEVELS))
    for k in range(rounds + 1):
        if k:
            frontier = frontier.repartition("tree", _block(LEVELS * k))
        step = stored(frontier.mapInArrow(_climb, f"{_NODE}, done boolean"), "nodes")
        found.append(step)
        frontier = step.where("NOT done").select("tree", "n", "level", "idx", "digest")
    nodes = found[0].where("done")
    for step in found[1:]:
        nodes = nodes.unionByName(step.where("done"))
    whole = stored(nodes.drop("done"), "tree")
    release(*found)
    return whole


def numbered(rows: DataFrame, tree: str | None, *order: str) -> DataFrame:
    """rows with idx (place in its tree in the given order, from 0), n (rows of the tree) and, as tree, the tree's number by first row; stored, in order.

    One range-partitioned sort; the rest are counts by partition. tree: a column, of which null is a value of its own; None: one tree.
    """
    keys = ([tree] if tree else []) + list(order)
    lie = stored(rows.repartitionByRange(*(F.col(c).asc_nulls_first() for c in keys)).sortWithinPartitions(*(F.col(c).asc_nulls_first() for c in keys)).withColumn("__at", F.monotonically_increasing_id()), "sorted")
    by = (F.col(tree) if tree else F.lit(0)).alias("__tree")
    part = F.shiftright("__at", 33).alias("__part")
    runs = lie.groupBy(by, part).agg(F.min("__at").alias("__first"), F.count("*").alias("__rows"))
    own = Window.partitionBy("__tree")
    before = F.coalesce(F.sum("__rows").over(own.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = stored(runs.select("__tree", "__part", "__first", before.alias("__before"), F.sum("__rows").over(own).alias("n"), F.min("__first").over(own).alias("tree")), "runs")
    rows = lie.withColumn("__part", part).withColumn("__own", by)
    rows = rows.join(runs, (rows["__part"] == runs["__part"]) & rows["__own"].eqNullSafe(runs["__tree"]))
    out = stored(rows.select(*(lie[c] for c in lie.columns if c != "__at"), "tree", "n", (F.col("__at") - F.col("__first") + F.col("__before")).alias("idx")), "numbered")
    release(lie, runs)
    return out


def _largest(leaves: DataFrame) -> int:
    return leaves.agg(F.max("n")).first()[0] or 0


_TAIL = "lefts array<string>, rights array<string>"


def _families(rows: dict[tuple[int, int], str], idx: int, level: int, top: int, n: int) -> tuple[list[str], list[str]]:
    """Siblings of a node on each level up to `top`: those on its left and those on its right, each as one string."""
    lefts, rights = [], []
    while level < top:
        first, here = idx // ARITY * ARITY, counts(n, level)
        end = min(first + ARITY, here)
        lefts.append("".join(rows[level, i] for i in range(first, idx)))
        rights.append("".join(rows[level, i] for i in range(idx + 1, end)))
        idx, level = idx // ARITY, level + 1
    return lefts, rights


def _descend(low: int, finish=None):
    """A block's nodes from level `low` on, and its own tail, to the tails of its nodes at `low`; finish: these to the columns of a result."""

    def run(key, table):
        tree, n, level, idx, digest, lefts, rights = (table.column(c).to_pylist() for c in ("tree", "n", "level", "idx", "digest", "lefts", "rights"))
        tail = next(i for i, x in enumerate(lefts) if x is not None)
        rows = {(level[i], idx[i]): digest[i] for i in range(len(idx)) if i != tail}
        at = [i for i in range(len(idx)) if i != tail and level[i] == low]
        if not at:  # a tree that ends below this block's levels: its root's tail goes down as it is
            return table.slice(tail, 1).select(["tree", "n", "idx", "lefts", "rights"])
        top = min(low + LEVELS, height(n[tail]))
        found = [_families(rows, idx[i], low, top, n[tail]) for i in at]
        take = pa.array(at)
        columns = {"tree": pa.array([tree[tail]] * len(at), pa.int64()), "n": pa.array([n[tail]] * len(at), pa.int64()), "idx": table.column("idx").take(take)}
        columns |= {"lefts": pa.array([f[0] + lefts[tail] for f in found], pa.list_(pa.string())), "rights": pa.array([f[1] + rights[tail] for f in found], pa.list_(pa.string()))}
        return pa.table(columns) if finish is None else finish(table.take(take), columns)

    return run


def tails(nodes: DataFrame, most: int, roots: DataFrame, low: int = 0) -> DataFrame:
    """tree, n, idx, lefts, rights of blocks of LEVELS * `low` levels: the siblings of the block's root on the way to the top; stored.

    roots: tree, n, lefts, rights, what follows above each tree's root.
    """
    found = stored(roots.withColumn("idx", F.lit(0).cast("long")), "tails")
    for k in reversed(range(low, max(1, math.ceil(height(most) / LEVELS)))):
        above = found
        found = stored(_level(nodes, above, k).groupBy("tree", "block").applyInArrow(_descend(LEVELS * k), f"tree long, n long, idx long, {_TAIL}"), "tails")
        release(above)
    return found


def _level(nodes: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Nodes of the levels of the blocks of round k, and these blocks' tails, with the block's number; other columns of nodes stay."""
    low = LEVELS * k
    own = nodes.where(F.col("level").between(low, low + LEVELS - 1)).withColumn("block", _block(low + LEVELS))
    above = found.select("tree", "n", "idx", F.col("idx").alias("block"), "lefts", "rights")
    return own.unionByName(above, allowMissingColumns=True)


def fold(digest: str, lefts: list[str], rights: list[str]) -> str:
    """The root that a leaf and its siblings give."""
    for a, b in zip(lefts, rights, strict=True):
        digest = combined([a, digest, b])
    return digest


def _proved(with_proofs: bool):
    def run(table: pa.Table, columns: dict) -> pa.Table:
        rows = _folded(table, columns)
        return rows if with_proofs else rows.drop_columns(["lefts", "rights"])

    return run


def _folded(table: pa.Table, columns: dict) -> pa.Table:
    lefts, rights = columns["lefts"].to_pylist(), columns["rights"].to_pylist()
    digest, changed = table.column("digest").to_pylist(), table.column("changed").to_pylist()
    proof = [hashlib.sha256("".join(x + y for x, y in zip(a, b, strict=True)).encode()).hexdigest() for a, b in zip(lefts, rights, strict=True)]
    folded = [fold(c if c is not None else d, a, b) for d, c, a, b in zip(digest, changed, lefts, rights, strict=True)]
    kept = ["doc_id", "tree", "idx", "digest"]
    return pa.table([*(table.column(c) for c in kept), columns["lefts"], columns["rights"], pa.array(proof, pa.string()), pa.array(folded, pa.string())], names=[*kept, "lefts", "rights", "proof_sha256", "folded_root"])


def manifest(docs: DataFrame, changed: Column | None = None, with_proofs: bool = True) -> DataFrame:
    """Per document: doc_id, tree, idx (its leaf's place), leaf, subroot, root, lefts and rights (the siblings on each level up to the root; with_proofs), proof_sha256, folded_root (from `changed`, the digest of the document as found, where that is not null, else from its leaf) and verified."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = [F.col(c) for c in FIELDS]
    rows = docs.select("doc_id", "lang", digest_of(*fields).alias("digest"), (changed if changed is not None else F.lit(None).cast("string")).alias("changed"))
    # Stored before it is sorted, as a range partitioned sort reads its input twice; equal rows are told apart, so that they needn't meet in one task.
    rows = stored(rows.withColumn("__tie", F.monotonically_increasing_id()), "leaves")
    leaves = numbered(rows, "lang", "doc_id", "digest", "__tie")
    release(rows)
    most = _largest(leaves)
    nodes = build(leaves, most)
    subroots = numbered(nodes.where("top").select(F.col("tree").alias("of"), F.col("n").alias("own"), "digest"), None, "of")  # trees are numbered in lang's order
    above = _largest(subroots)
    peak = build(subroots, above)
    nothing = F.array().cast("array<string>")
    upper = tails(peak, above, peak.where("top").select("tree", "n", nothing.alias("lefts"), nothing.alias("rights")))
    root = peak.where("top").select("digest").scalar()
    roots = stored(upper.drop("tree", "n").join(subroots, "idx").select(F.col("of").alias("tree"), F.col("own").alias("n"), "lefts", "rights", F.col("digest").alias("subroot"), root.alias("root")), "roots")
    release(upper, peak, subroots)
    found = tails(nodes, most, roots.drop("subroot", "root"), low=1)
    low = leaves.select("tree", "n", F.lit(0).alias("level"), "idx", "digest", "doc_id", "changed")
    low = low.unionByName(nodes.where("level > 0").drop("top"), allowMissingColumns=True)
    proofs = _level(low, found, 0).groupBy("tree", "block").applyInArrow(_descend(0, _proved(with_proofs)), f"doc_id {kind}, tree long, idx long, digest string, {_TAIL + ', ' if with_proofs else ''}proof_sha256 string, folded_root string")
    rows = proofs.join(roots.select("tree", "subroot", "root"), "tree")
    kept = ["doc_id", "tree", "idx", F.col("digest").alias("leaf"), "subroot", "root", *(["lefts", "rights"] if with_proofs else []), "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")]
    return rows.select(*kept)


def summary(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified, where of every document whose crc32 is divisible by 3 the text is found with A-Z lower-cased."""
    lower = F.translate("text", _HIGH, _LOW)
    hit = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    changed = F.when(hit, digest_of(*(lower if c == "text" else F.col(c) for c in FIELDS)))
    return manifest(docs, changed, with_proofs=False).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


#: DuckDB SQL for summary(documents). crc holds CRC-32 of the decimal id, bit by bit; n and t are the levels of the trees and of the tree over their roots.
ORACLE_SQL = r"""
WITH RECURSIVE f AS (
  SELECT row_number() OVER () AS row, doc_id, lang,
         list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
                     lambda a, c: list_reduce(list_prepend(xor(a, c), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda y, z: xor(y >> 1, (y & 1) * 3988292384::BIGINT))) AS crc,
         concat(coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'),
                coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-')) AS head,
         text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
h AS (SELECT row, doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
             CASE WHEN xor(crc, 4294967295::BIGINT) % 3 = 0 THEN sha256(head || coalesce(strlen(low) || ':' || low, '-')) END AS changed FROM f),
l AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, row) - 1 AS idx FROM h),
n AS (
  SELECT tree, 0 AS level, idx, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM l
  UNION ALL
  SELECT tree, level + 1, idx // 8, sha256(string_agg(h, '' ORDER BY idx)), any_value((n + 7) // 8) FROM n WHERE n > 1 GROUP BY tree, level, idx // 8),
s AS (SELECT tree AS idx, level AS high, h FROM n WHERE n = 1),
t AS (
  SELECT 0 AS level, idx, h, count(*) OVER () AS n FROM s
  UNION ALL
  SELECT level + 1, idx // 8, sha256(string_agg(h, '' ORDER BY idx)), any_value((n + 7) // 8) FROM t WHERE n > 1 GROUP BY level, idx // 8),
r AS (SELECT h AS root FROM t WHERE n = 1),
x AS (
  SELECT l.row, 0 AS phase, a.level, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS lefts, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS rights
  FROM l JOIN n a ON a.tree = l.tree AND a.n > 1 AND a.idx = l.idx // CAST(8 ** a.level AS BIGINT) JOIN n b ON b.tree = a.tree AND b.level = a.level AND b.idx // 8 = a.idx // 8 GROUP BY l.row, a.level
  UNION ALL
  SELECT l.row, 1, a.level, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx < a.idx), ''), coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '')
  FROM l JOIN t a ON a.n > 1 AND a.idx = l.tree // CAST(8 ** a.level AS BIGINT) JOIN t b ON b.level = a.level AND b.idx // 8 = a.idx // 8 GROUP BY l.row, a.level),
p AS (SELECT row, sha256(string_agg(lefts || rights, '' ORDER BY phase, level)) AS proof, list([lefts, rights] ORDER BY phase, level) AS steps FROM x GROUP BY row),
o AS (SELECT l.*, p.proof, list_reduce(list_prepend([coalesce(changed, leaf), ''], coalesce(steps, [])), lambda a, s: [sha256(s[1] || a[1] || s[2]), ''])[1] AS folded FROM l LEFT JOIN p USING (row))
SELECT doc_id, leaf, s.h AS subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM o JOIN s ON s.idx = o.tree, r
"""
