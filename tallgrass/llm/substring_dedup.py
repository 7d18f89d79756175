"""Removal of word passages that an earlier document also has.

A window is `window` consecutive words of one text. Windows whose smallest
`gram`-word hash (minimiser) is the same and which follow one another travel
as one packed string (a super-k-mer) to the bucket of that minimiser, where
sorting brings equal windows together. A window whose words also start in a
row with a smaller doc_id is a repeat; all words that repeats cover go.

Each batch first settles its own repeats, so of a passage that a third of all
documents share only the first copy in each batch is shuffled. Hashes only
propose equal windows; their bytes are compared before anything is removed.

Defined results: a null text has no words; a row with a null doc_id is kept
whole and removes nothing; rows that share a doc_id don't remove one another;
other columns pass through untouched or are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK, Words, normalised, paired, partitions, texts_of, window_hashes

#: Buckets for each shuffle partition: small ones bound a task's memory.
BUCKETS_EACH = 4
_MOVED = "bucket int, blob binary"
_SPANS = "doc_id long, text_hash long, starts array<int>, ends array<int>"


def _sliding_min(h: np.ndarray, k: int) -> np.ndarray:
    """min(h[i : i + k]) for each i, by doubling."""
    width = 1
    while width * 2 <= k:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    return h if width == k else np.minimum(h[: len(h) - (k - width)], h[k - width :])


def _repeats(w: Words, first: np.ndarray, hashes: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """Indices into `first` of the windows whose words also start in a smaller document.

    doc: the document of each window. Windows of equal hash are proposed by
    sorting; stretches of proposals that run in step are compared as bytes.
    """
    if not len(first):
        return np.empty(0, np.int64)
    order = np.lexsort((first, doc, hashes))
    sorted_hashes = hashes[order]
    head = np.empty(len(order), dtype=bool)
    head[0], head[1:] = True, sorted_hashes[1:] != sorted_hashes[:-1]
    source = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
    later = doc[order] > doc[source]
    mine, source = order[later], source[later]
    by = np.argsort(mine, kind="stable")
    mine, source = mine[by], source[by]
    if not len(mine):
        return mine
    a, b = first[mine], first[source]
    step = np.empty(len(a), dtype=bool)
    step[0], step[1:] = True, (a[1:] != a[:-1] + 1) | (b[1:] != b[:-1] + 1)
    at = np.flatnonzero(step)
    to = np.append(at[1:], len(a)) - 1
    buf, start, end = w.buf, w.start, w.end
    odd = [
        n
        for n, (i, j, p, q) in enumerate(zip(start[a[at]].tolist(), end[a[to] + k - 1].tolist(), start[b[at]].tolist(), end[b[to] + k - 1].tolist(), strict=True))
        if buf[i:j] != buf[p:q]
    ]
    if not odd:
        return mine
    # Different windows share a hash: settle all of theirs by their own bytes.
    doubtful = np.isin(hashes, np.unique(np.concatenate([hashes[mine[at[n] : to[n] + 1]] for n in odd])))
    least: dict[bytes, int] = {}
    rest = np.flatnonzero(doubtful).tolist()
    words = {n: buf[start[first[n]] : end[first[n] + k - 1]] for n in rest}
    for n in rest:
        least[words[n]] = min(least.get(words[n], doc[n]), doc[n])
    sure = mine[~doubtful[mine]]
    return np.sort(np.append(sure, [n for n in rest if doc[n] > least[words[n]]]).astype(np.int64))


def _spans(at: np.ndarray, owner: np.ndarray, k: int):
    """Consecutive window starts of one owner as (owner index, first word, end word)."""
    cut = np.empty(len(at), dtype=bool)
    if len(at):
        cut[0], cut[1:] = True, (at[1:] != at[:-1] + 1) | (owner[1:] != owner[:-1])
    i = np.flatnonzero(cut)
    j = np.append(i[1:], len(at)) - 1 if len(i) else i
    return owner[i], at[i], at[j] + k


def _pack(parts: list[bytes], *arrays: np.ndarray) -> bytes:
    text = b"\n".join(parts) + b"\n"
    head = np.array([len(arrays[0]), len(text)], dtype=np.int64).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(a.tobytes() for a in arrays) + text)


def _send(k: int, gram: int, buckets: int):
    """Batches of (doc_id, text_hash, text) to packed strings by bucket, and the spans that a batch settles itself under bucket -1 - n."""

    def run(batches):
        held: list = []
        size = 0
        for batch in batches:
            ids, tags, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch.column(2))
            for row in zip(ids, tags, texts, strict=True):
                if row[0] is None or not row[2]:
                    continue
                held.append(row)
                size += len(row[2])
                if size >= 4 * CHUNK:
                    yield emit(held)
                    held, size = [], 0
        if held:
            yield emit(held)

    def emit(rows):
        ids = np.array([r[0] for r in rows], dtype=np.int64)
        tags = np.array([r[1] for r in rows], dtype=np.int64)
        w = Words(normalised([r[2] for r in rows]))
        first, hashes = w.windows(k)
        text = w.text[first]
        base = np.searchsorted(w.text, np.arange(len(rows)))
        out: list[tuple[int, bytes]] = []
        settled = _repeats(w, first, hashes, ids[text], k)
        if len(settled):
            owner, start, end = _spans(first[settled], text[settled], k)
            start, end = start - base[owner], end - base[owner]
            out.append((-1 - int(ids[0] % buckets), _pack([], ids[owner], tags[owner], start.astype(np.int32), end.astype(np.int32))))
        open_ = np.ones(len(first), dtype=bool)
        open_[settled] = False
        first, text = first[open_], text[open_]
        if len(first):
            least = _sliding_min(window_hashes(w.hash, gram), k - gram + 1)[first]
            cut = np.empty(len(first), dtype=bool)
            cut[0], cut[1:] = True, (first[1:] != first[:-1] + 1) | (least[1:] != least[:-1]) | (text[1:] != text[:-1])
            i = np.flatnonzero(cut)
            j = np.append(i[1:], len(first)) - 1
            bucket = (least[i] % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            i, j, bucket = i[by], j[by], bucket[by]
            a, b = w.start[first[i]].tolist(), w.end[first[j] + k - 1].tolist()
            row = text[i]
            pos = (first[i] - base[row]).astype(np.int32)
            edge = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket)).tolist()
            for s, t in zip(edge[:-1], edge[1:], strict=True):
                parts = [w.buf[x:y] for x, y in zip(a[s:t], b[s:t], strict=True)]
                out.append((int(bucket[s]), _pack(parts, ids[row[s:t]], tags[row[s:t]], pos[s:t])))
        return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.binary())], names=["bucket", "blob"])

    return run


def _settle(k: int):
    """The spans of one bucket's repeats; what the batches settled passes."""

    def run(key, table):
        undo = zstandard.ZstdDecompressor()
        ids, tags, starts, ends = [], [], [], []
        texts, doc, tag, pos = [], [], [], []
        for blob in table.column("blob").to_pylist():
            raw = undo.decompress(blob)
            n, size = np.frombuffer(raw, dtype=np.int64, count=2).tolist()
            a, b = np.frombuffer(raw, np.int64, n, 16), np.frombuffer(raw, np.int64, n, 16 + 8 * n)
            c = np.frombuffer(raw, np.int32, n, 16 + 16 * n)
            if key[0].as_py() < 0:
                ids.append(a), tags.append(b), starts.append(c), ends.append(np.frombuffer(raw, np.int32, n, 16 + 20 * n))
            else:
                texts.append(raw[len(raw) - size :])
                doc.append(a), tag.append(b), pos.append(c)
        if texts:
            w = Words(b"".join(texts))
            doc, tag, pos = np.concatenate(doc), np.concatenate(tag), np.concatenate(pos)
            first, hashes = w.windows(k)
            text = w.text[first]
            found = _repeats(w, first, hashes, doc[text], k)
            base = np.searchsorted(w.text, np.arange(len(doc)))
            owner, start, end = _spans(first[found], text[found], k)
            shift = pos[owner] - base[owner]
            ids.append(doc[owner]), tags.append(tag[owner]), starts.append(start + shift), ends.append(end + shift)
        none = [np.empty(0, np.int64)]
        ids, tags, starts, ends = (np.concatenate(x or none) for x in (ids, tags, starts, ends))
        order = np.lexsort((starts, tags, ids))
        ids, tags, starts, ends = ids[order], tags[order], starts[order], ends[order]
        edge = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1]))) if len(ids) else np.empty(0, np.int64)
        offsets = pa.array(np.append(edge, len(ids)), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (starts, ends)]
        return pa.Table.from_arrays([pa.array(ids[edge]), pa.array(tags[edge]), *lists], names=["doc_id", "text_hash", "starts", "ends"])

    return run


def repeated_spans(docs: DataFrame, window: int = 13, gram: int = 3) -> DataFrame:
    """(doc_id, text_hash, starts, ends): word ranges that repeats cover, several rows a document; ranges may touch or overlap.

    text_hash is xxhash64(text): with doc_id it names a row's content.
    """
    buckets = BUCKETS_EACH * partitions(docs.sparkSession)
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    moved = rows.mapInArrow(_send(window, gram, buckets), _MOVED)
    return moved.groupBy("bucket").applyInArrow(_settle(window), _SPANS)


def _apply(kept_text: bool):
    def run(batches):
        for batch in batches:
            out = {"n_words": [], "n_removed": [], "kept_sha256": [], "kept": []}
            texts = texts_of(batch.column("text"))
            for text, starts, ends in zip(texts, batch.column("starts").to_pylist(), batch.column("ends").to_pylist(), strict=True):
                words = text.split() if text else []
                n = len(words)
                if starts:
                    kept, at = [], 0
                    for s, e in sorted((s, e) for ss, ee in zip(starts, ends, strict=True) for s, e in zip(ss, ee, strict=True)):
                        if s > at:
                            kept += words[at:s]
                        at = max(at, e)
                    words = kept + words[at:]
                joined = b" ".join(words)
                out["n_words"].append(n)
                out["n_removed"].append(n - len(words))
                out["kept_sha256"].append(hashlib.sha256(joined).hexdigest())
                out["kept"].append(joined.decode("utf-8", "replace") if kept_text else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["kept_sha256"], pa.string()), pa.array(out["kept"], pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
            )

    return run


def dedup_substrings(docs: DataFrame, window: int = 13, gram: int = 3, kept_text: bool = True) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 and kept_text (the words left, joined by one space)."""
    spans = repeated_spans(docs, window, gram).groupBy("doc_id", "text_hash").agg(F.collect_list("starts").alias("starts"), F.collect_list("ends").alias("ends"))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    joined = rows.join(spans, ["doc_id", "text_hash"], "left").select("doc_id", "text", "starts", "ends")
    return joined.mapInArrow(_apply(kept_text), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
