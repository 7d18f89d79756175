"""Byte-level BPE encoding and decoding as a monoid over byte strings.

Encoded strings form a monoid under join(): halves of a piece are encoded on
their own and joined by re-encoding a window about the seam. The window grows
until its outer tokens are stable beside their neighbours. A token sequence
whose adjacent pairs each encode to themselves is the encoding of its bytes,
so tokens outside the window are then final. Decoding concatenates byte
strings up a tree of the ids.

Pieces are the matches of a pattern and are encoded separately; a piece that
is itself in the vocabulary is one token. Pieces repeat, so each worker keeps
a bounded cache of encoded pieces.

Defined results: a null text is the empty text; it has no ids.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Pieces a worker remembers before it starts anew.
CACHE = 300_000
LEAF = 4
_DECODE_LEAF = 4096


class Codec:
    """Encoding and decoding by the ranks of one vocabulary file (lines of base64 token and rank)."""

    def __init__(self, raw: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}
        self.tokens = {b: a for a, b in self.ranks.items()}
        self.find = regex.compile(pattern).findall
        self.known: dict[str, str] = {}
        self.parts: dict[str, str] = {}
        self.seams: dict[tuple[bytes, bytes], list[bytes]] = {}
        self.halves: dict[bytes, list[bytes]] = {}

    def merged(self, piece: bytes) -> list[bytes]:
        """Lowest-ranked adjacent pair first, leftmost of equals, until none is left."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        get = self.ranks.get
        far = len(self.ranks) + 1
        pairs = [get(piece[i : i + 2], far) for i in range(len(piece) - 1)]
        while pairs and (low := min(pairs)) < far:
            i = pairs.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], far)
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], far)
        return parts

    def seam(self, a: bytes, b: bytes) -> list[bytes]:
        """The encoding of two adjacent tokens' bytes, remembered."""
        known = self.seams.get((a, b))
        if known is None:
            if len(self.seams) >= CACHE:
                self.seams.clear()
            known = self.seams[a, b] = self.merged(a + b)
        return known

    def holds(self, a: bytes, b: bytes) -> bool:
        """Whether two adjacent tokens encode to themselves."""
        return self.seam(a, b) == [a, b]

    def join(self, a: list[bytes], b: list[bytes]) -> list[bytes]:
        """The encoding of the bytes of a and b, from their encodings."""
        if not a or not b:
            return a or b
        i = j = 1
        window = self.seam(a[-1], b[0])
        while True:
            left = i == len(a) or self.holds(a[len(a) - i - 1], window[0])
            right = j == len(b) or self.holds(window[-1], b[j])
            if left and right:
                return a[: len(a) - i] + window + b[j:]
            i = i if left else min(len(a), 2 * i)
            j = j if right else min(len(b), 2 * j)
            window = self.merged(b"".join(a[len(a) - i :] + b[:j]))

    def tree(self, piece: bytes) -> list[bytes]:
        """The encoding of a piece from those of its halves; short halves repeat and are remembered."""
        known = self.halves.get(piece)
        if known is None:
            if len(piece) <= LEAF:
                known = self.merged(piece)
            else:
                middle = len(piece) // 2
                known = self.join(self.tree(piece[:middle]), self.tree(piece[middle:]))
            if len(piece) <= 8:
                if len(self.halves) >= CACHE:
                    self.halves.clear()
                self.halves[piece] = known
        return known

    def piece(self, text: str) -> str:
        """A piece's ids in decimal, joined by commas."""
        known = self.known.get(text)
        if known is None:
            raw = text.encode()
            whole = self.ranks.get(raw)
            known = str(whole) if whole is not None else ",".join([str(self.ranks[t]) for t in self.tree(raw)])
            self._keep(self.known, text, known)
        return known

    def forget(self) -> None:
        """Drop the remembered pieces: at the end of a task, as Spark keeps idle workers beside what runs next."""
        for cache in (self.known, self.parts, self.seams, self.halves):
            cache.clear()

    def _keep(self, cache: dict, key: str, value: str) -> None:
        if len(key) <= 64:
            if len(cache) >= CACHE:
                cache.clear()
            cache[key] = value

    def run(self, text: str) -> str:
        return ",".join([self.piece(p) for p in self.find(text)])

    def encoded(self, text: str | None) -> str:
        """A text's ids in decimal, joined by commas.

        No piece crosses the start of a space that has a character other than
        white space on both sides, so the text is cut there and the parts,
        which repeat far more than texts do, are looked up whole.
        """
        if not text:
            return ""
        parts = text.split(" ")
        get = self.parts.get
        found = [get(p) for p in parts]
        found[0] = self.run(parts[0]) if parts[0] else ""
        if None in found or not parts[0] or parts[0][-1].isspace():
            found = self._cut(parts, found)
        return ",".join(found)

    def _cut(self, parts: list[str], found: list[str | None]) -> list[str]:
        """The same for texts with new parts or with other white space beside a space."""
        out, held = [], parts[0]
        ready: str | None = found[0]
        for part, known in zip(parts[1:], found[1:], strict=True):
            clean = known is not None or bool(part) and not (part[0].isspace() or part[-1].isspace())
            if held and not held[-1].isspace() and (clean or part and not part[0].isspace()):
                out.append(self.run(held) if ready is None else ready)
                if clean and known is None:
                    known = self.parts.get(part)
                    if known is None:
                        known = self.run(" " + part)
                        self._keep(self.parts, part, known)
                held, ready = " " + part, known if clean else None
            else:
                held, ready = held + " " + part, None
        out.append(self.run(held) if ready is None else ready)
        return out if out != [""] else []

    def encode(self, text: str | None) -> list[int]:
        found = self.encoded(text)
        return list(map(int, found.split(","))) if found else []

    def decode(self, ids: list[int]) -> bytes:
        level = [b"".join(map(self.tokens.__getitem__, ids[i : i + _DECODE_LEAF])) for i in range(0, len(ids), _DECODE_LEAF)]
        while len(level) > 1:
            level = [b"".join(level[i : i + 2]) for i in range(0, len(level), 2)]
        return level[0] if level else b""


_codecs: dict[tuple[int, str], Codec] = {}


def codec(raw: bytes, pattern: str) -> Codec:
    """One codec for each worker process and vocabulary."""
    key = hash(raw), pattern
    if key not in _codecs:
        _codecs[key] = Codec(raw, pattern)
    return _codecs[key]


def _vocabulary(df: DataFrame, path: str):
    """The file's bytes as a broadcast: a vocabulary's size is fixed. The driver reads the installed file."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, pattern: str, keep: list[str] | None = None) -> DataFrame:
    """docs' columns `keep` (default doc_id) with n_tokens and ids array<int>."""
    keep = ["doc_id"] if keep is None else keep
    shared = _vocabulary(docs, path)

    def run(batches):
        c = codec(shared.value, pattern)
        for batch in batches:
            ids = [c.encode(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=[*keep, "n_tokens", "ids"])
        c.forget()

    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    return docs.select(*keep, *([] if "text" in keep else ["text"])).mapInArrow(run, f"{kinds}, n_tokens long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and data binary (the bytes of ids; null ids give none) from rows with doc_id and ids."""
    shared = _vocabulary(encoded, path)

    def run(batches):
        c = codec(shared.value, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([c.decode(x or []) for x in batch.column("ids").to_pylist()], pa.binary())], names=["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def round_trip(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids array<int>): digests of the ids and of what they decode to, in one pass."""
    shared = _vocabulary(docs, path)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids

    def run(batches):
        c = codec(shared.value, pattern)
        for batch in batches:
            rows: tuple[list, list, list, list] = ([], [], [], [])
            for text in batch.column("text"):
                found = c.encoded(text.as_py())
                ids = list(map(int, found.split(","))) if found else []
                rows[0].append(len(ids))
                rows[1].append(hashlib.sha256(found.encode()).hexdigest())
                rows[2].append(hashlib.sha256(c.decode(ids)).hexdigest())
                if with_ids:
                    rows[3].append(pa.array(ids, pa.int32()))
            columns = [batch.column("doc_id"), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.string())]
            if with_ids:
                columns.append(pa.array(rows[3], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=names)
        c.forget()
        pa.default_memory_pool().release_unused()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
