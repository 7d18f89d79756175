"""Benchmark decontamination: suffix arrays of the training text, searched for every suffix of the test items.

A shard is some MB of whole documents in one task. Its words are reduced to the
runs of words that some item has: no other word is in a match, and a run
shorter than the shortest window can't hold one. The suffix array of what is
left is sorted by tripling (ranks of one word, of three, nine and so on), up
to the length of the longest item. Every item suffix is binary-searched in it:
its place among the shard's suffixes gives its longest verbatim match, and the
suffixes that share its window all occurrences of that. Documents don't leave
their task and nothing is shuffled.

Test items reach the tasks as broadcasts of at most PART bytes each, of which a
task holds one at a time: the driver reads the items in turn and never has more
than one part, so a larger set of items costs passes over a shard, not memory.
Words are compared by 64-bit hashes.

Defined results: a null text has no words; an item without words has no window
and one of fewer words than a window is one window as a whole. Items with equal
item_id are one item, and one with a null item_id marks words without being
named. Rows are judged one by one, so repeated rows get equal results. A
document column named like the result is replaced; others pass untouched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import CHUNK, Words, chunks, texts_of
from .rarity import ranges

#: Bytes of item text that one broadcast holds.
PART = 8 << 20
#: Lower-cases A-Z and turns every other ASCII character that is no letter or digit into a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(texts: list[bytes | None]) -> Words:
    return Words(b"".join(b" ".join(t.translate(_FOLD).split()) + b"\n" if t else b"\n" for t in texts))


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes of ids in the order of their first `depth` ids at least; ids are not negative, and a suffix that ends comes first."""
    n = len(ids)
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64) + 1
    order, width = np.argsort(rank, kind="stable"), 1
    while width < depth and n:
        high = int(rank.max()) + 1
        if high >= 1 << 21:  # three ranks don't fit in 63 bits: two do
            step, key = 2, rank << 31
            key[: n - width] += rank[width:] if width < n else 0
        else:
            step, key = 3, rank * high * high
            for k in (1, 2):
                if k * width < n:
                    key[: n - k * width] += rank[k * width :] * high ** (2 - k)
        order = np.argsort(key, kind="stable")
        new = np.ones(n, dtype=np.int64)
        new[1:] = key[order][1:] != key[order][:-1]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(new)
        width *= step
        if rank[order[-1]] == n:
            break
    return order


class Items:
    """Some test items: their words as numbers, their suffixes, and the distinct windows among these."""

    def __init__(self, names: list[str | None], texts: list[bytes | None], window: int):
        w = words_of(texts)
        self.names, self.window = names, window
        self.vocabulary, ids = np.unique(w.hash, return_inverse=True)
        self.ids = np.append(ids.astype(np.int64) + 1, 0)
        size = w.counts()
        first = np.cumsum(size) - size
        left = (first + size)[w.text] - np.arange(len(ids))
        whole = (size[w.text] < window) & (np.arange(len(ids)) == first[w.text])
        self.start = np.flatnonzero((left >= window) | whole)
        self.item, self.left = w.text[self.start], left[self.start]
        self.within = self.start - first[self.item]
        self.length = np.minimum(self.left, window)
        self.least = int(self.length.min()) if len(self.start) else 0
        self.longest = int(size.max()) if len(size) else 0
        # Equal windows are searched once: padded with zeros, which no word has, they are equal rows.
        grid = self.ids[np.minimum(self.start[:, None] + np.arange(window), len(self.ids) - 1)]
        grid[np.arange(window) >= self.length[:, None]] = 0
        self.windows, self.window_of = np.unique(grid, axis=0, return_inverse=True) if len(grid) else (grid, self.start)
        self.window_of = self.window_of.ravel()
        self.size = (self.windows > 0).sum(axis=1)
        # Which named items have a window, by window.
        pairs = np.unique(np.stack([self.window_of, self.item]), axis=1) if len(self.start) else np.empty((2, 0), np.int64)
        self.pair_item, self.pair_at = pairs[1], np.searchsorted(pairs[0], np.arange(len(self.windows) + 1))
        self.hashes = np.zeros(1 << 22, dtype=bool)
        self.hashes[(self.vocabulary & np.uint64((1 << 22) - 1)).astype(np.int64)] = True


class Shard:
    """Whole documents' words, of which those in runs of an item's words have a suffix array."""

    def __init__(self, words: Words, items: Items):
        self.items = items
        known = items.hashes[(words.hash & np.uint64((1 << 22) - 1)).astype(np.int64)]
        at = np.flatnonzero(known)
        place = np.searchsorted(items.vocabulary, words.hash[at])
        real = items.vocabulary[np.minimum(place, len(items.vocabulary) - 1)] == words.hash[at] if len(items.vocabulary) else np.zeros(len(at), bool)
        at, place = at[real], place[real]
        first = np.ones(len(at), dtype=bool)
        first[1:] = (at[1:] != at[:-1] + 1) | (words.text[at[1:]] != words.text[at[:-1]])
        run = np.cumsum(first) - 1
        long = np.bincount(run, minlength=1)[run] >= max(1, items.least) if len(at) else np.zeros(0, bool)
        at, place, run = at[long], place[long], run[long]
        # Runs are kept apart by a 0, which no word is.
        shift = np.arange(len(at)) + np.searchsorted(np.unique(run), run)
        self.ids = np.zeros(int(shift[-1]) + 2 if len(at) else 1, dtype=np.int64)
        self.position = np.full(len(self.ids), -1, dtype=np.int64)
        self.ids[shift], self.position[shift] = place + 1, at
        order = suffix_array(self.ids, items.longest)
        self.order = order[self.ids[order] > 0]

    def _compare(self, at: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """How many of the `size` words from `start` of the items equal those from `at` of the shard; negative (-1 - number) where the shard's next word is the smaller."""
        same, live = np.zeros(len(at), dtype=np.int64), np.flatnonzero(size > 0)
        below = np.zeros(len(at), dtype=bool)
        while len(live):
            mine = self.ids[np.minimum(at[live] + same[live], len(self.ids) - 1)]
            other = self.items.ids[start[live] + same[live]]
            below[live] = mine < other
            live = live[mine == other]
            same[live] += 1
            live = live[same[live] < size[live]]
        return np.where(below, -1 - same, same)

    def _bound(self, start: np.ndarray, size: np.ndarray, upper: bool) -> np.ndarray:
        """First place in the suffix array that does not sort below the words (upper: that sorts above and does not start with them)."""
        low, high = np.zeros(len(start), dtype=np.int64), np.full(len(start), len(self.order), dtype=np.int64)
        while True:
            live = np.flatnonzero(low < high)
            if not len(live):
                return low
            mid = (low[live] + high[live]) // 2
            found = self._compare(self.order[mid], start[live], size[live])
            right = (found < 0) | (upper & (found == size[live]))
            low[live[right]], high[live[~right]] = mid[right] + 1, mid[~right]

    def occurrences(self) -> tuple[np.ndarray, np.ndarray]:
        """Window and word position of every occurrence of a window."""
        items = self.items
        start = items.start[np.unique(items.window_of, return_index=True)[1]] if len(items.start) else np.empty(0, np.int64)
        low, high = self._bound(start, items.size, False), self._bound(start, items.size, True)
        n = np.maximum(high - low, 0)
        return np.repeat(np.arange(len(start)), n), self.position[self.order[np.repeat(low, n) + ranges(n)]]

    def longest(self) -> tuple[np.ndarray, np.ndarray]:
        """For every item suffix, the number of words of its longest verbatim match and the word position of one such match (-1: none)."""
        items = self.items
        best, where = np.zeros(len(items.start), np.int64), np.full(len(items.start), -1, np.int64)
        if len(self.order) and len(items.start):
            place = self._bound(items.start, items.left, False)
            for near in (place - 1, place):
                ok = np.flatnonzero((near >= 0) & (near < len(self.order)))
                found = self._compare(self.order[near[ok]], items.start[ok], items.left[ok])
                found = np.where(found < 0, -1 - found, found)
                more = found > best[ok]
                best[ok[more]], where[ok[more]] = found[more], self.position[self.order[near[ok[more]]]]
        return best, where


def _parts(tests: DataFrame, part: int) -> list:
    """Broadcasts of (names, texts), each of about `part` bytes; at least one."""
    context, out, names, texts, size = tests.sparkSession.sparkContext, [], [], [], 0
    for row in tests.select(F.col("item_id").cast("string"), F.col("text").cast("binary")).toLocalIterator():
        names.append(row[0]), texts.append(bytes(row[1]) if row[1] is not None else None)
        size += len(texts[-1] or b"")
        if size >= part:
            out.append(context.broadcast((names, texts)))
            names, texts, size = [], [], 0
    if names or not out:
        out.append(context.broadcast((names, texts)))
    return out


def _each(parts: list, window: int) -> Callable[[], Iterator[Items]]:
    """A function that gives one part after another; a single part is prepared once a task."""
    only = Items(*parts[0].value, window) if len(parts) == 1 else None

    def each() -> Iterator[Items]:
        if only is not None:
            yield only
            return
        for shared in parts:
            yield Items(*shared.value, window)
            vars(shared).pop("_value", None)  # else a worker keeps all parts it has read

    return each


def _shards(batches, size: int):
    for batch in batches:
        texts = texts_of(batch.column("text"))
        for s, t in chunks(texts, size):
            yield batch.slice(s, t - s), words_of(texts[s:t])


def _of(values: list, kind) -> pa.Array:
    return pa.array(values, pa.list_(kind))


def marked(docs: DataFrame, tests: DataFrame, window: int = 10, name: str = "leak", part: int = PART, shard: int = CHUNK) -> DataFrame:
    """docs with the column `name`: a struct of n_words, n_hit, items (names of those with occurring windows, in order) and spans (start and length in words of each stretch of hit words).

    tests: item_id and text. A word is hit that is in any occurrence of a
    window of `window` consecutive words of an item.
    """
    parts, keep = _parts(tests, part), [c for c in docs.columns if c != name]
    kind = pa.struct([("start", pa.int64()), ("n_words", pa.int64())])

    def run(batches):
        each = _each(parts, window)
        for batch, words in _shards(batches, shard):
            n = words.n_texts
            size = words.counts().astype(np.int64)
            change = np.zeros(len(words.hash) + 1, dtype=np.int64)
            named: list[set] = [set() for _ in range(n)]
            for items in each():
                which, at = Shard(words, items).occurrences()
                np.add.at(change, at, 1)
                np.add.at(change, at + items.size[which], -1)
                met = np.unique(words.text[at] * max(1, len(items.windows)) + which)
                doc, which = np.divmod(met, max(1, len(items.windows)))
                many = np.diff(items.pair_at)[which]
                own = np.unique(np.repeat(doc, many) * max(1, len(items.names)) + items.pair_item[items.pair_at[which].repeat(many) + ranges(many)])
                for d, i in zip(*(x.tolist() for x in np.divmod(own, max(1, len(items.names)))), strict=True):
                    if items.names[i] is not None:
                        named[d].add(items.names[i])
            hit = np.flatnonzero(np.cumsum(change[:-1]) > 0)
            n_hit = np.bincount(words.text[hit], minlength=n).astype(np.int64)
            new = np.ones(len(hit), dtype=bool)
            new[1:] = (hit[1:] != hit[:-1] + 1) | (words.text[hit[1:]] != words.text[hit[:-1]])
            begin = hit[new]
            length = np.diff(np.append(np.flatnonzero(new), len(hit)))
            first = np.cumsum(size) - size
            edge = np.searchsorted(words.text[begin], np.arange(n + 1))
            spans = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.StructArray.from_arrays([pa.array(begin - first[words.text[begin]]), pa.array(length.astype(np.int64))], fields=list(kind)))
            leak = pa.StructArray.from_arrays([pa.array(size), pa.array(n_hit), _of([sorted(x) for x in named], pa.string()), spans], names=["n_words", "n_hit", "items", "spans"])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), leak], names=[*keep, name])
        pa.default_memory_pool().release_unused()

    schema = docs.drop(name).schema.add(name, StructType.fromDDL("n_words long, n_hit long, items array<string>, spans array<struct<start: long, n_words: long>>"))
    return docs.mapInArrow(run, schema)


def clean(docs: DataFrame, tests: DataFrame, window: int = 10) -> DataFrame:
    """The documents without a hit word, with docs' own columns."""
    packed = docs.select("text", F.struct("*").alias("row"))
    return marked(packed, tests, window).where("leak.n_hit = 0").select("row.*")


def longest_matches(docs: DataFrame, tests: DataFrame, window: int = 10, part: int = PART, shard: int = CHUNK) -> DataFrame:
    """For each item with an occurring window: item_id (as string), n_words of its longest verbatim match over all documents, item_word where it starts in the item, doc_id and doc_word of one such match (the smallest doc_id, then the first place in the item).

    A task sends an item's best match of each shard; they meet in one maximum.
    """
    parts = _parts(tests, part)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        each = _each(parts, window)
        for batch, words in _shards(batches, shard):
            size = words.counts()
            first = np.cumsum(size) - size
            for items in each():
                best, where = Shard(words, items).longest()
                some = np.flatnonzero(best >= items.length)
                if not len(some):
                    continue
                order = some[np.lexsort((items.start[some], -best[some], items.item[some]))]
                order = order[np.append(True, items.item[order][1:] != items.item[order][:-1])]
                item, doc = items.item[order], words.text[where[order]]
                columns = [pa.array([items.names[i] for i in item.tolist()], pa.string()), pa.array(best[order]), pa.array(items.within[order]), batch.column("doc_id").take(pa.array(doc)), pa.array(where[order] - first[doc])]
                yield pa.RecordBatch.from_arrays(columns, names=["item_id", "n_words", "item_word", "doc_id", "doc_word"])

    found = docs.select("doc_id", "text").mapInArrow(run, f"item_id string, n_words long, item_word long, doc_id {kind}, doc_word long").where("item_id IS NOT NULL")
    by = F.struct((-F.col("n_words")).alias("less"), "doc_id", "item_word", "doc_word")
    return found.groupBy("item_id").agg(F.min(by).alias("m")).select("item_id", (-F.col("m.less")).alias("n_words"), "m.item_word", "m.doc_id", "m.doc_word")


def summary(docs: DataFrame, tests: DataFrame, window: int = 10) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256 (of the named items, comma-joined), contaminated."""
    rows = marked(docs.select("doc_id", "text"), tests, window)
    return rows.select("doc_id", "leak.n_words", "leak.n_hit", F.size("leak.items").cast("long").alias("n_items"), F.sha2(F.array_join("leak.items", ","), 256).alias("items_sha256"), (F.col("leak.n_hit") > 0).alias("contaminated"))


#: DuckDB SQL for summary(documents, benchmark).
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, array_to_string(w[p : p + 9], ' ') AS x, least(len(w), 10) AS n FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM b WHERE len(w) > 0)),
s AS (SELECT DISTINCT n FROM i),
o AS (SELECT row, n, unnest(list_transform(range(1, len(w) - n + 2), lambda p: {'p': p, 'x': array_to_string(w[p : p + n - 1], ' ')})) AS o FROM d, s WHERE len(w) >= n),
h AS (SELECT o.row, o.o.p AS p, o.n, i.item_id FROM o JOIN i ON i.n = o.n AND i.x = o.o.x),
m AS (SELECT row, count(DISTINCT q) AS n_hit FROM (SELECT row, unnest(range(p, p + n)) AS q FROM h) GROUP BY row),
t AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, CAST(item_id AS VARCHAR) AS item FROM h WHERE item_id IS NOT NULL) GROUP BY row)
SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN m USING (row) LEFT JOIN t USING (row)
"""
