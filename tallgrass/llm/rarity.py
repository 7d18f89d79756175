"""Exact token counts of many sets, and the rare tokens that each set shares with others.

Sets come in batches, those of equal content in a batch folded into one. A
batch's tokens go, packed in 32 bits each, to buckets of the hash space, which
count them over all sets and send those that another set has, too, back to
their batch with their count. A token that many sets of one batch share is sent
once, with its number, so that a very common token costs its bucket about
SHARED entries a batch. Tokens that no other set has come first in the order
(count, token): a set whose prefix holds only such tokens links with nothing.

A set's id is one or more integers. Batches are told apart by their content, so
rows must come from a scan, whose order is fixed, and not from a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK, Words, mix, normalised, stored, window_hashes

#: Bytes of text whose tokens one bucket counts, on average.
BUCKET_BYTES = 24 << 20
#: Sets of one batch above which a token goes to its bucket once, with its number.
SHARED = 8
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
NODES, TOKENS = 0, 1
_NODE_ARRAYS = [np.int64, np.bool_, np.int32, np.uint64, np.uint64, np.int32, np.int32, np.int32]
_TOKEN_ARRAYS = [np.uint32, np.int32, np.int32]
_COUNTED_ARRAYS = [np.uint32, np.int32, np.int32]


def shingle_sets(texts: list[bytes | None], k: int, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of all texts, one text after another, and the offsets of each text's part.

    fold: A-Z are lower-cased. A text of fewer than k words has its whole word sequence as its only n-gram.
    """
    w = Words(normalised([t.translate(_LOWER) if t else t for t in texts] if fold else texts))
    first, hashes = w.windows(k)
    text = w.text[first]
    counts = w.counts()
    for n in range(1, k):
        short = np.flatnonzero(counts == n)
        if len(short):
            at = np.searchsorted(w.text, short)
            hashes, text = np.append(hashes, window_hashes(w.hash, n)[at]), np.append(text, short)
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    hashes, text = hashes[new], text[new]
    return hashes, np.searchsorted(text, np.arange(len(texts) + 1))


def ranges(sizes: np.ndarray) -> np.ndarray:
    """0 .. size - 1 for each size, in one array."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def _blob(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *(len(x) for x in arrays)], dtype=np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(x.tobytes() for x in arrays))


def _arrays(blob: bytes, kinds: list) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes, at, out = np.frombuffer(raw, np.int64, n, 8), 8 + 8 * n, []
    for size, kind in zip(sizes.tolist(), kinds, strict=True):
        out.append(np.frombuffer(raw, kind, size, at))
        at += size * np.dtype(kind).itemsize
    return out


def sets_of(texts: list, k: int, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """shingle_sets of many texts, in chunks."""
    hashes, offsets, at, size = [], [np.zeros(1, np.int64)], 0, 0
    held: list = []
    for n, text in enumerate(texts):
        held.append(text)
        size += len(text) if text else 0
        if size >= CHUNK or n + 1 == len(texts):
            h, o = shingle_sets(held, k, fold)
            hashes.append(h), offsets.append(o[1:] + at)
            at, held, size = at + len(h), [], 0
    return np.concatenate(hashes or [np.empty(0, np.uint64)]), np.concatenate(offsets)


def _distinct_copies(ids: np.ndarray, live: np.ndarray, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    """Of the rows `live`, that of the smallest id of each set."""
    order = live[np.lexsort((*ids[live].T[::-1], k2[live], k1[live]))]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (k1[order][1:] != k1[order][:-1]) | (k2[order][1:] != k2[order][:-1])
    return np.sort(order[new])


def _packed(units: Callable, n_ids: int, k: int, fold: bool, buckets: int):
    """Batches of rows to (part, batch, blob): the batch's sets under a negative part, its tokens under their buckets. units: a batch to (id tuple, text) pairs; an id with a None has no node."""

    def emit(some: list, texts: list):
        hashes, offsets = sets_of(texts, k, fold)
        size = np.diff(offsets)
        known = np.array([None not in i for i in some], dtype=bool)
        ids = np.array([[x or 0 for x in i] for i in some], dtype=np.int64).reshape(-1, n_ids)
        owner = np.repeat(np.arange(len(ids)), size)
        k1, k2 = (np.zeros(len(ids), dtype=np.uint64) for _ in range(2))
        for seed, total in ((0xA5A5, k1), (0xA5A6, k2)):
            np.add.at(total, owner, mix(hashes ^ np.uint64(seed)))
        only = _distinct_copies(ids, np.flatnonzero(known & (size > 0)), k1, k2)
        whole = k1.copy()
        for column in ids.T:
            whole = mix(whole + column.view(np.uint64) if column.flags.c_contiguous else whole + np.ascontiguousarray(column).view(np.uint64))
        batch = int((whole + k2 + np.uint64(1)).sum(keepdims=True).view(np.int64)[0])
        token = hashes[np.repeat(offsets[only], size[only]) + ranges(size[only])]
        node = np.repeat(np.arange(len(only), dtype=np.int32), size[only])
        order = np.argsort(token, kind="stable")
        token, node = token[order], node[order]
        edge = np.append(np.flatnonzero(np.append(True, token[1:] != token[:-1])), len(token)) if len(token) else np.zeros(1, np.int64)
        times = np.diff(edge)
        often = np.repeat(times > SHARED, times)
        many = np.flatnonzero(times > SHARED)
        side = _blob(ids.ravel(), known, size.astype(np.int32), k1, k2, only.astype(np.int32), times[many].astype(np.int32), node[often])
        token = np.append(token[~often], token[edge[many]])
        node = np.append(node[~often], len(only) + np.arange(len(many), dtype=np.int32))
        times = np.append(np.ones(len(node) - len(many), np.int32), times[many].astype(np.int32))
        bucket = ((token >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        order = np.lexsort((node, bucket))
        token, node, times, bucket = (token[order] & np.uint64(0xFFFFFFFF)).astype(np.uint32), node[order], times[order], bucket[order]
        out = [(-1 - abs(batch // 2), batch, side)]
        edge = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket)).tolist() if len(bucket) else [0]
        for s, t in zip(edge[:-1], edge[1:], strict=True):
            out.append((int(bucket[s]), batch, _blob(token[s:t], np.diff(node[s:t], prepend=0).astype(np.int32), times[s:t])))
        return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.binary())], names=["part", "batch", "blob"])

    def run(batches):
        ids, texts, size = [], [], 0
        for batch in batches:
            for i, text in units(batch):
                ids.append(i), texts.append(text)
                size += len(text) if text else 0
                if size >= 2 * CHUNK:
                    yield emit(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield emit(ids, texts)
        pa.default_memory_pool().release_unused()

    return run


_PACKED = "kind int, batch long, bucket int, blob binary"


def _counted(key, table):
    """Of a bucket's tokens those that two or more sets have, with their count, for each batch; a batch's sets pass."""
    batch, blobs = table.column("batch"), table.column("blob").to_pylist()
    if key[0].as_py() < 0:
        n = len(blobs)
        return pa.table([pa.array([NODES] * n, pa.int32()), batch, pa.array([-1] * n, pa.int32()), table.column("blob")], names=["kind", "batch", "bucket", "blob"])
    parts = [_arrays(x, _TOKEN_ARRAYS) for x in blobs]
    token, times = (np.concatenate([p[i] for p in parts]) for i in (0, 2))
    order = np.argsort(token, kind="stable")
    first = np.flatnonzero(np.append(True, token[order][1:] != token[order][:-1]))
    total = np.add.reduceat(times[order].astype(np.int64), first)
    count = np.empty(len(token), dtype=np.int32)
    count[order] = np.repeat(np.minimum(total, 0x7FFFFFFF), np.diff(np.append(first, len(token))))
    out, at = [], 0
    for low, step, _ in parts:
        here = count[at : at + len(low)]
        keep = here > 1
        out.append(_blob(low[keep], np.cumsum(step, dtype=np.int32)[keep], here[keep]) if keep.any() else None)
        at += len(low)
    n = len(out)
    found = pa.table([pa.array([TOKENS] * n, pa.int32()), batch, pa.array([key[0].as_py()] * n, pa.int32()), pa.array(out, pa.binary())], names=["kind", "batch", "bucket", "blob"])
    return found.filter(found.column("blob").is_valid())


def _prefixes(names: list[str], percent: int):
    """A batch's sets and shared tokens to a row for each set with a shared token in its prefix."""

    def run(key, table):
        kinds = table.column("kind").to_numpy()
        blobs, bucket = table.column("blob").to_pylist(), table.column("bucket").to_numpy()
        sides = [b for b, kind in zip(blobs, kinds, strict=True) if kind == NODES]
        ids, _, size, k1, _, only, times, members = _arrays(sides[0], _NODE_ARRAYS)
        ids = ids.reshape(-1, len(names))
        tokens, nodes, counts = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        starts = np.cumsum(times) - times
        for at in np.flatnonzero(kinds == TOKENS).tolist():
            low, node, count = _arrays(blobs[at], _COUNTED_ARRAYS)
            token = low.astype(np.int64) | np.int64(int(bucket[at]) << 32)
            one = node < len(only)
            group = node[~one] - len(only)
            each = times[group]
            tokens += [token[one], np.repeat(token[~one], each)]
            counts += [count[one], np.repeat(count[~one], each)]
            nodes += [node[one], members[np.repeat(starts[group], each) + ranges(each)]]
        token, node, count = (np.concatenate(x) for x in (tokens, nodes, counts))
        order = np.lexsort((token, count, node))[:: len(sides)]  # equal batches are one, of which every entry came as often
        token, node, count = token[order], node[order], count[order]
        n = size[only].astype(np.int64)
        own = np.bincount(node, minlength=len(only))
        typical = np.bincount(node, np.log2(count), len(only)) / np.maximum(n, 1)
        alone = n - own
        prefix = n - -(-percent * n // 100) + 1 - alone
        some = np.flatnonzero((prefix > 0) & (own > 0))
        keep = np.zeros(len(only), dtype=bool)
        keep[some] = True
        at = only[some]
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(own[some])).astype(np.int32)), pa.array(token[keep[node]]))
        columns = [pa.array(np.ascontiguousarray(ids[at, i])) for i in range(len(names))]
        columns += [pa.array(k1[at].view(np.int64)), pa.array(size[at]), pa.array((1000 * typical[some]).astype(np.int32)), pa.array(np.minimum(prefix, own)[some].astype(np.int32)), lists]
        return pa.table(columns, names=[*names, "k1", "n", "typical", "prefix", "tokens"])

    return run


def _rows(names: list[str]):
    """Blobs of sets to ids, n, k1, k2 of every row."""

    def run(batches):
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                ids, known, size, k1, k2, *_ = _arrays(blob, _NODE_ARRAYS)
                ids = ids.reshape(-1, len(names))
                columns = [pa.array(np.ascontiguousarray(ids[:, i]), mask=~known) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(size), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64))], names=[*names, "n", "k1", "k2"])

    return run


def counted(rows: DataFrame, text_bytes: int, units: Callable, names: list[str], k: int, fold: bool = True, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Packed counts of the sets of all units of rows, stored. text_bytes: of all texts."""
    moved = rows.mapInArrow(_packed(units, len(names), k, fold, 1 + text_bytes // bucket_bytes), "part long, batch long, blob binary").groupBy("part")
    return stored(moved.applyInArrow(_counted, _PACKED), "packed")


def sets(packed: DataFrame, names: list[str]) -> DataFrame:
    """names, n (size), k1 and k2 (128 bits of the set's content) of every unit, stored; null ids where an id has a null."""
    ids = ", ".join(f"{x} long" for x in names)
    return stored(packed.where(F.col("kind") == NODES).mapInArrow(_rows(names), f"{ids}, n int, k1 long, k2 long"), "sets")


def prefixes(packed: DataFrame, names: list[str], percent: int) -> DataFrame:
    """Of one unit of each batch's sets that can have a partner: names, k1, n, typical (mean logarithm of its tokens' counts), tokens (those that other sets have, rarest first) and prefix (how many of them any partner at `percent` shares one of); stored."""
    ids = ", ".join(f"{x} long" for x in names)
    return stored(packed.groupBy("batch").applyInArrow(_prefixes(names, percent), f"{ids}, k1 long, n int, typical int, prefix int, tokens array<long>"), "prefixes")
