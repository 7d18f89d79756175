"""Alignment of two tokenizers: which tokens of one cover the bytes of which tokens of the other.

A slice of documents is laid out as one run of bytes with the documents' byte
offsets. The ends of all tokens of A and of B are counted by position once; the
run is cut where both have an end, and prefix sums of these counts, taken at
the documents' offsets, give every document's tokens, groups and links. A link
is a stretch between two neighbouring ends: it belongs to one token of each.

Corpus-wide counts of linked id pairs need two passes. The first stores, for
each slice, its documents' figures, its distinct pairs with their counts, and
which of these pairs each document has how often. Pairs are summed over slices
(combined map-side first), a B id's highest count is taken, and each slice gets
the counts of its own pairs back. A pair has at most one row a slice, so no key
is hot.

Tokens are found part by part: a text is cut before each single space between
two characters other than white space. A's pattern begins a new piece there,
and no piece of B has a space mark after another character (checked when the
model is read; without it texts stay whole), so both encode the parts as they
encode the text. Equal parts are encoded once.

Defined results: a text that is null, empty, not valid UTF-8 or that A's or B's
tokens don't spell byte for byte (with one space before it) has no tokens. Rows
are aligned one by one, repeated rows and null ids too; other columns are not
read. Very long texts fill a slice of their own.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, release, stored, texts_of
from .rarity import _arrays as arrays_of
from .rarity import _blob as blob_of
from .rarity import ranges

#: Distinct parts that a task remembers between slices.
CACHE = 200_000
#: Parts that one call of A's tokenizer gets: its intermediate results take about 100 bytes a token.
CALL = 20_000
_CUT = re.compile(r"(?<=\S) (?=\S)")
_MARK = "▁"
FIGURES = ("n_a", "n_b", "n_groups", "n_links")


def byte_level() -> dict[str, int]:
    """The characters that byte-level vocabularies write bytes as: printable Latin-1 stands for itself, the other bytes follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Pair:
    """Both tokenizers in one worker, with the bytes and lengths of their tokens and the parts met so far."""

    def __init__(self, a: bytes, b: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        of = byte_level()
        self.a_bytes = [b""] * self.a.get_vocab_size(with_added_tokens=True)
        for piece, i in self.a.get_vocab(with_added_tokens=True).items():
            self.a_bytes[i] = bytes(of[c] for c in piece) if all(c in of for c in piece) else piece.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        plain = lambda i: not (self.b.is_control(i) or self.b.is_unknown(i))
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_MARK, " ").encode() if plain(i) else b"" for i, p in enumerate(pieces)]
        self.cuts = not any(_MARK in p.lstrip(_MARK) for i, p in enumerate(pieces) if plain(i))
        self.sizes = tuple(np.array([len(x) for x in t], dtype=np.int64) for t in (self.a_bytes, self.b_bytes))
        self.forget()
        # Every token as it stands in a document's text of groups, followed by a separator: A's with , or |, then B's with , or ;
        self.written = [f"{i}{s}".encode() for i in range(len(self.a_bytes)) for s in ",|"] + [f"{i}{s}".encode() for i in range(len(self.b_bytes)) for s in ",;"]

    def parts(self, text: str) -> list[str]:
        return _CUT.split(text) if self.cuts else [text]

    def forget(self) -> None:
        """Drop the parts met so far: their numbers, and by number their ids of A and B (in one array each, with counts), bytes, and whether both spell them."""
        self.number: dict[str, int] = {}
        self.ids = [np.empty(0, np.int32)] * 2
        self.counts = [np.empty(0, np.int64)] * 2
        self.bytes, self.spelt = np.empty(0, np.int64), np.empty(0, bool)

    def learn(self, split: list[list[str]]) -> None:
        """Give every part of some texts a number."""
        if len(self.number) > CACHE or len(self.ids[0]) > 8 * CACHE:
            self.forget()
        known = self.number
        new = list(dict.fromkeys(p for parts in split for p in parts if p not in known))
        for at in range(0, len(new), CALL):
            some = new[at : at + CALL]
            known.update(zip(some, range(len(known), len(known) + len(some)), strict=True))
            raw = [b" " + p.encode() for p in some]
            found = [[x.ids for x in self.a.encode_batch_fast([" " + p for p in some], add_special_tokens=False)], self.b.encode(some, num_threads=1)]
            size, spelt = np.array(list(map(len, raw)), np.int64), np.ones(len(some), dtype=bool)
            for i, (ids, names) in enumerate(zip(found, (self.a_bytes, self.b_bytes), strict=True)):
                flat, count = np.array(list(chain.from_iterable(ids)), np.int32), np.array(list(map(len, ids)), np.int64)
                upto = np.append(0, np.cumsum(self.sizes[i][flat]))[np.append(0, np.cumsum(count))]
                if (np.diff(upto) != size).any() or b"".join(map(names.__getitem__, flat.tolist())) != b"".join(raw):
                    spelt &= np.array([b"".join(map(names.__getitem__, x)) == want for x, want in zip(ids, raw, strict=True)], dtype=bool)
                self.ids[i], self.counts[i] = np.concatenate([self.ids[i], flat]), np.concatenate([self.counts[i], count])
            self.bytes, self.spelt = np.concatenate([self.bytes, size]), np.concatenate([self.spelt, spelt])


_pairs: dict[int, Pair] = {}


def _pair(a: bytes, b: bytes) -> Pair:
    """One pair for each worker process and two vocabularies. A task's threads are Spark's business, so A's tokenizer starts none."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    key = hash((a, b))
    if key not in _pairs:
        _pairs[key] = Pair(a, b)
    return _pairs[key]


class Slice:
    """Tokens, groups and links of some documents, from one layout of their bytes."""

    def __init__(self, pair: Pair, raw: list[bytes | None]):
        texts, here = [], []
        for t in raw:
            try:
                texts.append(t.decode() if t else None)
            except UnicodeDecodeError:
                texts.append(None)
        split = [pair.parts(t) if t else [] for t in texts]
        pair.learn(split)
        for parts in split:
            at = np.array(list(map(pair.number.__getitem__, parts)), np.int64)
            here.append(at if pair.spelt[at].all() else at[:0])
        n, at = np.array([len(x) for x in here], np.int64), np.concatenate([*here, np.empty(0, np.int64)])
        self.ids = [self._gather(flat, size, at) for flat, size in zip(pair.ids, pair.counts, strict=True)]
        self.offsets = np.append(0, np.cumsum(pair.bytes[at]))[np.append(0, np.cumsum(n))]
        ends = [np.cumsum(size[ids]) for size, ids in zip(pair.sizes, self.ids, strict=True)]
        total = int(self.offsets[-1])
        a, b = (np.bincount(e, minlength=total + 1) > 0 for e in ends)
        upto = [np.cumsum(x, dtype=np.int32) for x in (a, b, a & b)]
        self.figures = [np.diff(x[self.offsets]).astype(np.int64) for x in upto]  # n_a, n_b, n_groups
        at = np.flatnonzero(a | b)
        self.link_ids = [ids[upto[i][at] - mark[at]] for i, (ids, mark) in enumerate(zip(self.ids, (a, b), strict=True))]
        self.link_doc = np.searchsorted(self.offsets, at) - 1
        self.figures.append(np.bincount(self.link_doc, minlength=len(raw)).astype(np.int64))
        self.group = [upto[2][e] - (a & b)[e] for e in ends]
        self.group_ends = np.flatnonzero(a & b)

    @staticmethod
    def _gather(flat: np.ndarray, size: np.ndarray, at: np.ndarray) -> np.ndarray:
        first, own = np.cumsum(size) - size, size[at]
        return flat[np.repeat(first[at], own) + ranges(own)]

    def spans(self, d: int) -> tuple:
        """One document's A ids, B ids, and for each group its end in bytes and how many tokens of A and of B it has."""
        (a0, a1), (b0, b1), (g0, g1) = (tuple(np.append(0, np.cumsum(f))[d : d + 2]) for f in self.figures[:3])
        each = [np.bincount(g[s:t] - g0, minlength=g1 - g0) for g, (s, t) in zip(self.group, ((a0, a1), (b0, b1)), strict=True)]
        return self.ids[0][a0:a1], self.ids[1][b0:b1], self.group_ends[g0:g1] - self.offsets[d], each[0], each[1]

    def digests(self, pair: Pair) -> list[str]:
        """SHA-256 of every document's groups as text, all tokens put in order at once."""
        (ga, gb), n_groups = self.group, len(self.group_ends)
        each = [np.bincount(g, minlength=n_groups) for g in (ga, gb)]
        before = np.append(0, np.cumsum(each[1])), np.append(0, np.cumsum(each[0]))[1:]
        codes = np.empty(len(ga) + len(gb), np.int64)
        for k, (g, ids, base) in enumerate(zip((ga, gb), self.ids, (0, 2 * len(pair.a_bytes)), strict=True)):
            last = np.append(g[1:] != g[:-1], True)[: len(g)]
            codes[np.arange(len(g)) + before[k][g]] = base + 2 * ids.astype(np.int64) + last
        edge, out = np.append(0, np.cumsum(self.figures[0] + self.figures[1])).tolist(), []
        for s, t in zip(edge[:-1], edge[1:], strict=True):
            out.append(hashlib.sha256(b"".join(map(pair.written.__getitem__, codes[s:t].tolist()))[:-1]).hexdigest() if t > s else "")
        return out

    def pairs(self, n_b: int) -> tuple[np.ndarray, np.ndarray, bytes]:
        """Distinct linked id pairs as a * n_b + b in ascending order, their counts, and which of them each document has how often."""
        codes, at, times = np.unique(self.link_ids[0].astype(np.int64) * n_b + self.link_ids[1], return_inverse=True, return_counts=True)
        n_docs = len(self.offsets) - 1
        own, often = np.unique(self.link_doc * max(1, len(codes)) + at, return_counts=True)
        doc, which = np.divmod(own, max(1, len(codes)))
        return codes, times, blob_of(np.bincount(doc, minlength=n_docs).astype(np.int32), which.astype(np.int32), often.astype(np.int32))


def _shared(df: DataFrame, a_path: str, b_path: str):
    """Both files' bytes as broadcasts: a vocabulary's size is fixed. The driver reads the installed files."""
    out = []
    for path in (a_path, b_path):
        with open(path, "rb") as f:
            out.append(df.sparkSession.sparkContext.broadcast(f.read()))
    return out


def _slices(batches, pair: Pair):
    for batch in batches:
        texts = texts_of(batch.column("text"))
        for s, t in chunks(texts):
            yield batch.column("doc_id").slice(s, t - s), Slice(pair, texts[s:t])


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, a_ids and b_ids array<int>, and groups: array of (end: byte offset in space + text, n_a, n_b: tokens of each in the group)."""
    a, b = _shared(docs, a_path, b_path)

    def run(batches):
        pair = _pair(a.value, b.value)
        for ids, part in _slices(batches, pair):
            rows = [part.spans(d) for d in range(len(ids))]
            groups = [[{"end": x, "n_a": y, "n_b": z} for x, y, z in zip(*(c.tolist() for c in r[2:]), strict=True)] for r in rows]
            kind = pa.struct([("end", pa.int64()), ("n_a", pa.int32()), ("n_b", pa.int32())])
            yield pa.RecordBatch.from_arrays([ids, *(pa.array([r[i] for r in rows], pa.list_(pa.int32())) for i in (0, 1)), pa.array(groups, pa.list_(kind))], names=["doc_id", "a_ids", "b_ids", "groups"])
        pair.forget()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, a_ids array<int>, b_ids array<int>, groups array<struct<end: long, n_a: int, n_b: int>>")


def _first_pass(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row a slice, stored: its documents' figures, its pairs with their counts, and its documents' pairs."""
    a, b = _shared(docs, a_path, b_path)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        pair, at = _pair(a.value, b.value), TaskContext.get().partitionId() << 32
        n_b = len(pair.b_bytes)
        for ids, part in _slices(batches, pair):
            codes, times, own = part.pairs(n_b)
            figures = [pa.array(f) for f in part.figures]
            rows = pa.StructArray.from_arrays([ids, *figures, pa.array(part.digests(pair), pa.string())], names=["doc_id", *FIGURES, "groups_sha256"])
            of = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            yield pa.RecordBatch.from_arrays([pa.array([at]), of(rows), of(pa.array(codes)), of(pa.array(times)), pa.array([own], pa.binary())], names=["slice", "docs", "pairs", "times", "own"])
            at += 1
        pair.forget()
        pa.default_memory_pool().release_unused()

    docs_kind = f"array<struct<doc_id: {kind}, {', '.join(f'{f}: long' for f in FIGURES)}, groups_sha256: string>>"
    rows = docs.select("doc_id", "text").mapInArrow(run, f"slice long, docs {docs_kind}, pairs array<long>, times array<long>, own binary")
    return stored(rows, "slices")


def _n_b(b_path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()


def _counted(slices: DataFrame, n_b: int) -> DataFrame:
    """pair, b_id, count and whether the count is its b_id's highest; stored. At most as many rows as there are id pairs."""
    each = slices.select(F.explode(F.arrays_zip("pairs", "times")).alias("e")).select(F.col("e.pairs").alias("pair"), F.col("e.times").alias("times"))
    counts = stored(each.groupBy("pair").agg(F.sum("times").alias("count")).withColumn("b_id", F.pmod("pair", F.lit(n_b))), "counts")
    best = counts.groupBy("b_id").agg(F.max("count").alias("most"))  # at most B's vocabulary
    marked = stored(counts.join(F.broadcast(best), "b_id").select("pair", "b_id", "count", (F.col("count") == F.col("most")).alias("best")), "pairs")
    release(counts)
    return marked


def translation(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """a_id, b_id, count (links that hold the pair, corpus-wide) and best (no other pair of this b_id has more): a table from B's tokens to A's."""
    n_b = _n_b(b_path)
    slices = _first_pass(docs, a_path, b_path)
    pairs = _counted(slices, n_b)
    release(slices)
    return pairs.select(F.expr(f"pair div {n_b}").cast("int").alias("a_id"), F.col("b_id").cast("int").alias("b_id"), "count", "best")


def _settled(slices: pa.Table, counts: pa.Table) -> pa.Table:
    """One slice's documents with the sums over their links; counts has each of its pairs once."""
    docs = slices.column("docs").combine_chunks().flatten()
    order = np.argsort(counts.column("pair").to_numpy())
    count = counts.column("count").to_numpy()[order].astype(np.int64)
    best = counts.column("best").to_numpy(zero_copy_only=False)[order].astype(np.int64)
    size, which, often = arrays_of(slices.column("own")[0].as_py(), [np.int32, np.int32, np.int32])
    edge = np.append(0, np.cumsum(size))
    sums = [np.diff(np.append(0, np.cumsum(values[which] * often))[edge]) for values in (best, count)]
    return pa.table([*docs.flatten(), *map(pa.array, sums)], names=["doc_id", *FIGURES, "groups_sha256", "n_best", "count_sum"])


def summary(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 ('' without tokens)."""
    slices = _first_pass(docs, a_path, b_path)
    marked = _counted(slices, _n_b(b_path))
    own = slices.select(F.col("slice").alias("of"), F.explode("pairs").alias("pair")).join(marked.select("pair", "count", "best"), "pair")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = slices.select("slice", "docs", "own").groupBy("slice").cogroup(own.groupBy("of")).applyInArrow(_settled, f"doc_id {kind}, {', '.join(f'{f} long' for f in FIGURES)}, groups_sha256 string, n_best long, count_sum long")
    return rows.select("doc_id", *FIGURES, "n_best", "count_sum", "groups_sha256")
