"""Exact Jaccard self-join of documents on word n-grams, as classes of linked documents.

A document's set holds the 64-bit hashes of its distinct n-grams. Two sets
link when 100 * |A and B| >= percent * |A or B|. The join runs in four steps:

1. Rarity. Tokens are counted over all documents (`rarity`).
2. Prefixes. In the order (count, token) a set's first n - ceil(n * percent /
   100) + 1 tokens hold one that any linked set has among its own first. Tokens
   that no other set has come first and are not posted, so that most sets have
   no posting at all.
3. Tiles. The sets of a token are sorted by size and only sizes that can link
   are compared; a token of many sets is cut into pairs of salts of about `tile`
   sets. Hashed bitmaps bound the overlap from above by bit counts, pairs that
   pass are decided by intersecting the sorted arrays. Before tiles form, the
   sets of a token meet the most typical of them, that of the most frequent
   tokens: of near copies this is the one with the fewest changes, to which the
   others link. A tile pairs only sets of different classes.
4. Classes are the components of the links.

docs must come from a scan, whose rows have a fixed order (see `rarity`).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rarity
from .common import chunks, mix, release, stored, texts_of
from .components import components
from .rarity import sets_of, shingle_sets

TILE = 2000
#: Times that the sets of a token meet a typical one before they are compared in tiles.
MEETINGS = 2
#: Bytes of hashes that one task of the exact check holds, on average.
SLOT_BYTES = 24 << 20
#: 64-bit words of the bitmaps.
SKETCH = 32


def bitmaps(hashes: np.ndarray, offsets: np.ndarray, words: int) -> np.ndarray:
    """A row of `words` 64-bit words for each set; each element sets one bit."""
    n = len(offsets) - 1
    bit = mix(hashes + np.uint64(3)) % np.uint64(64 * words)
    out = np.zeros(n * words, dtype=np.uint64)
    at = np.repeat(np.arange(n), np.diff(offsets)) * words + (bit >> np.uint64(6)).astype(np.int64)
    np.bitwise_or.at(out, at, np.uint64(1) << (bit & np.uint64(63)))
    return out.reshape(n, words)


def _sketched(k: int):
    """(doc_id, text) to (doc_id, n, sketch): the size of the set and its bitmap."""

    def run(batches):
        for batch in batches:
            ids, texts = batch.column("doc_id").to_numpy(), texts_of(batch.column("text"))
            for s, t in chunks(texts):
                hashes, offsets = shingle_sets(texts[s:t], k)
                rows = [x.tobytes() for x in bitmaps(hashes, offsets, SKETCH)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[s:t]), pa.array(np.diff(offsets).astype(np.int32)), pa.array(rows, pa.binary())], names=["doc_id", "n", "sketch"])

    return run


def _bits(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, SKETCH)


def _may_link(percent: int, n: np.ndarray, m: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether sets of n and m elements with the bitmaps x and y can link: elements in which they differ are at least the bits that do."""
    differ = np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)
    return (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & ((100 + percent) * differ <= (100 - percent) * (n + m))


def _near(percent: int):
    """Of rows (a, b, ca, cb, n, sketch, m, other) the pairs that can link."""

    def run(batches):
        for batch in batches:
            n, m = (batch.column(x).to_numpy().astype(np.int64) for x in ("n", "m"))
            keep = pa.array(_may_link(percent, n, m, _bits(batch.column("sketch")), _bits(batch.column("other"))))
            columns = [*(batch.column(x) for x in ("a", "b", "ca", "cb")), pa.array(n + m)]
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in columns], names=["a", "b", "ca", "cb", "elements"])

    return run


def _pairs_of_tokens(percent: int):
    """Of the sets of the tokens in one slot, the pairs of a token and of different classes that can link; between two salts, only those across."""

    def run(slot, table):
        token, doc, c, salt, n = (table.column(x).to_numpy() for x in ("token", "doc_id", "c", "salt", "n"))
        order = np.lexsort((n, token))
        token, doc, c, salt, n = token[order], doc[order], c[order], salt[order], n[order].astype(np.int64)
        bits = _bits(table.column("sketch"))[order]
        across = slot[1].as_py() != slot[2].as_py()
        edge = np.append(np.flatnonzero(np.append(True, token[1:] != token[:-1])), len(token)).tolist()
        one, two = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for s, t in zip(edge[:-1], edge[1:], strict=True):
            for x in range(s + 1, t):
                low = s + int(np.searchsorted(n[s:x], -(-percent * n[x] // 100)))
                near = low + np.flatnonzero((c[low:x] != c[x]) & ((salt[low:x] != salt[x]) | (not across)))
                if len(near):
                    near = near[_may_link(percent, n[near], n[x], bits[near], bits[x])]
                    one.append(np.full(len(near), x)), two.append(near)
        one, two = np.unique(np.stack([np.concatenate(one), np.concatenate(two)]), axis=1)
        return pa.table([pa.array(x) for x in (doc[one], doc[two], c[one], c[two], n[one] + n[two])], names=["a", "b", "ca", "cb", "elements"])

    return run


def _decided(k: int, percent: int):
    """Pairs (a, b, ca, cb) and texts (doc_id, text) of one slot to the links (a, b) that join classes ca and cb; pairs of classes already joined are skipped."""

    def run(key, table):
        pairs = table.filter(table.column("b").is_valid())
        rows = table.filter(table.column("b").is_null())
        ids = rows.column("a").to_numpy()
        hashes, offsets = sets_of(texts_of(rows.column("text")), k)
        order = np.argsort(ids, kind="stable")
        a, b = pairs.column("a").to_numpy(), pairs.column("b").to_numpy()
        classes, place = np.unique(np.append(pairs.column("ca").to_numpy(), pairs.column("cb").to_numpy()), return_inverse=True)
        ca, cb = place[: len(a)], place[len(a) :]
        root = list(range(len(classes)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        of = lambda i: [hashes[offsets[j] : offsets[j + 1]] for j in order[np.searchsorted(ids, i, "left", order) : np.searchsorted(ids, i, "right", order)]]
        found = []
        for i in np.lexsort((b, a)).tolist():
            x, y = find(int(ca[i])), find(int(cb[i]))
            if x != y and any(_links(s, t, percent) for s in of(a[i]) for t in of(b[i])):
                found.append(i)
                root[max(x, y)] = min(x, y)
        return pa.table([pa.array(a[found]), pa.array(b[found])], names=["a", "b"])

    return run


def _links(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(s, t, assume_unique=True))
    return common > 0 and 100 * common >= percent * (len(s) + len(t) - common)


def _units(batch):
    return (((i,), t) for i, t in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True))


def near_classes(docs: DataFrame, k: int = 5, percent: int = 80, tile: int = TILE, bucket_bytes: int = rarity.BUCKET_BYTES) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable by links, the row's own included).

    Needs doc_id and text. A null or wordless text has an empty set and links
    with nothing; rows of one doc_id are one node; a row with a null doc_id
    keeps its size and has a null component_id.
    """
    rows = docs.select("doc_id", "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    packed = rarity.counted(rows, size, _units, ["doc_id"], k, bucket_bytes=bucket_bytes)
    sets, prefixes = rarity.sets(packed, ["doc_id"]), rarity.prefixes(packed, ["doc_id"], percent)
    release(packed)
    same = ["k1", "k2", "n"]
    leaders = sets.where("n > 0").groupBy(same).agg(F.min("doc_id").alias("leader"))
    copies = stored(sets.join(leaders, same).where("doc_id != leader").select("doc_id", "leader", "k1").distinct(), "copies")
    own = prefixes.join(copies, ["doc_id", "k1"], "left_anti").select("doc_id", "typical", F.explode(F.slice("tokens", F.lit(1), F.col("prefix"))).alias("token")).groupBy("token", "doc_id").agg(F.max("typical").alias("typical"))
    own = stored(own, "own")
    many = own.groupBy("token").count().where("count > 1").select("token")
    postings = stored(own.join(many, "token", "left_semi"), "postings")
    release(prefixes, own)
    links = _links_of(rows, postings, copies, k, percent, tile)
    release(copies, postings)
    classes = components(links)
    release(links)
    found = sets.join(classes, sets.doc_id == classes.node, "left")
    return found.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def representatives(docs: DataFrame, k: int = 5, percent: int = 80, tile: int = TILE) -> DataFrame:
    """docs with one document of each class, that of the smallest doc_id; its rows, if repeated, and rows with a null doc_id stay."""
    classes = near_classes(docs, k, percent, tile)
    later = classes.where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(later, "doc_id", "left_anti").select(*docs.columns)


def _links_of(rows: DataFrame, postings: DataFrame, copies: DataFrame, k: int, percent: int, tile: int) -> DataFrame:
    """Links (a, b) that join the sets of each token into their classes, and those of copies, stored.

    A meeting pairs the sets of a token with the most typical of them, the
    second one with the most typical of a quarter of them, another one by each
    seed. What is then still of different classes is paired in tiles.
    """
    members = stored(rows.join(postings.select("doc_id").distinct(), "doc_id"), "members")
    sketches = stored(members.mapInArrow(_sketched(k), "doc_id long, n int, sketch binary"), "sketches")
    links, parts = copies.select(F.col("doc_id").alias("a"), F.col("leader").alias("b")).where("false"), []
    for seed in [*range(MEETINGS), None]:
        classes = components(links)
        at = postings.join(classes, postings.doc_id == classes.node, "left").select("token", "doc_id", "typical", F.coalesce("component", "doc_id").alias("c"))
        at = stored(at, "classed")
        mixed = at.groupBy("token").agg(F.count("*").alias("size"), F.min("c").alias("low"), F.max("c").alias("high"), F.max(F.struct(F.pmod(F.xxhash64("doc_id", F.lit(seed or 0)), F.lit(4)) == 0 if seed else F.lit(True), "typical", -F.col("doc_id"), "doc_id", "c")).alias("met"))
        mixed = stored(mixed.where("low < high").select("token", "size", "met.doc_id", "met.c"), "mixed")
        if mixed.isEmpty():
            release(at, mixed, classes)
            break
        pairs = _met(at, mixed, sketches, percent) if seed is not None else _tiled(at, mixed, sketches, percent, tile)
        pairs = stored(pairs.select("a", "b", "ca", "cb", "elements").distinct(), "pairs")
        release(at, mixed, classes)
        found = _decide(pairs, members, k, percent)
        release(pairs)
        links, parts = links.union(found), [*parts, found]
    links = stored(links.union(copies.select("doc_id", "leader")), "links")
    release(members, sketches, *parts)
    return links


def _met(at: DataFrame, mixed: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs of the sets of mixed tokens with the one that all of its token meet."""
    met = mixed.select("token", F.col("doc_id").alias("b"), F.col("c").alias("cb"))
    met = at.join(met, "token").where("c != cb").select(F.col("doc_id").alias("a"), "b", F.col("c").alias("ca"), "cb").distinct()
    other = sketches.select(F.col("doc_id").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("other"))
    met = met.join(sketches.withColumnRenamed("doc_id", "a"), "a").join(other, "b")
    return met.mapInArrow(_near(percent), _PAIR)


_PAIR = "a long, b long, ca long, cb long, elements long"


def _tiled(at: DataFrame, mixed: DataFrame, sketches: DataFrame, percent: int, tile: int) -> DataFrame:
    """Pairs of sets of different classes that share a mixed token; the sets of a token above `tile` meet in pairs of salts."""
    dealt = mixed.select("token", "size", F.ceil(F.col("size") / tile).cast("int").alias("salts"))
    slots = 1 + (dealt.where("salts = 1").agg(F.sum("size")).first()[0] or 0) // tile
    dealt = at.join(dealt, "token").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    slot = F.when(F.col("salts") > 1, F.col("token")).otherwise(-1 - F.pmod(F.xxhash64("token"), F.lit(slots)))
    dealt = dealt.select(slot.alias("slot"), F.least("salt", "with").alias("i"), F.greatest("salt", "with").alias("j"), "token", "doc_id", "c", "salt")
    return dealt.join(sketches, "doc_id").groupBy("slot", "i", "j").applyInArrow(_pairs_of_tokens(percent), _PAIR)


def _decide(pairs: DataFrame, members: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of the pairs whose sets link, stored, but for such as join classes that others have joined. A set's text goes to a slot once, however many pairs it has there."""
    pairs = pairs.select(*(F.when(F.col("ca") > F.col("cb"), F.col(x)).otherwise(F.col(y)).alias(x) for x, y in (("a", "b"), ("b", "a"))), F.greatest("ca", "cb").alias("ca"), F.least("ca", "cb").alias("cb"), "elements")
    slots = 1 + (pairs.agg(F.sum("elements")).first()[0] or 0) * 8 // SLOT_BYTES
    salts = pairs.groupBy("a").agg(F.ceil(F.sum("elements") * 8 / SLOT_BYTES).alias("salts"))
    slot = F.pmod(F.xxhash64("a", F.pmod(F.xxhash64("b"), F.col("salts"))), F.lit(slots))
    dealt = stored(pairs.join(salts, "a").select(slot.alias("slot"), "a", "b", "ca", "cb"), "dealt")
    needed = dealt.select("slot", F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = needed.join(members, "doc_id").select("slot", F.col("doc_id").alias("a"), *(F.lit(None).cast("long").alias(x) for x in ("b", "ca", "cb")), "text")
    every = dealt.withColumn("text", F.lit(None).cast("string")).unionByName(texts)
    found = stored(every.groupBy("slot").applyInArrow(_decided(k, percent), "a long, b long"), "found")
    release(dealt)
    return found
