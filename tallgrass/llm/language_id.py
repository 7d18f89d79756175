"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram of letters, or of
letters and a word's edge, is the product of its letters' vectors, rotated by
their places (binding); a text is the sum of its trigrams' vectors (bundling).
A language's prototype is the sum over its training texts, and a text has the
language whose prototype is nearest by cosine.

Training needs counts of trigrams by language only; each task sends one vector
for each language, summed up by Spark. The prototypes that reach the tasks are
as many as languages, at most MOST.

Defined results: a text that is null or has no letter is `und` with score 0,
as is every text when nothing was learned; equal cosines go to the smaller
language name; letters are those of str.isalpha after lower-casing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix

DIM = 512
#: Languages that may be learned: a bound on what reaches the driver and every task.
MOST = 10_000
#: Characters and documents that are counted at once.
CHARS, DOCS = 1 << 20, 256
UNKNOWN = "und"
_DENSE = 1 << 22


def letter_vectors(codes: np.ndarray, dim: int = DIM) -> np.ndarray:
    """Rows of +1 and -1 for code points; code 0 is a word's edge. They depend on nothing else."""
    words = mix(codes.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, dim // 64 + 1, dtype=np.uint64)[None, :])
    bits = np.unpackbits(words.view(np.uint8), axis=1)
    return bits.astype(np.float32) * 2 - 1


_alpha: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _alpha:
        _alpha.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _alpha[0]


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(owner, kind) of each trigram and (a, b, c) code points by kind: trigrams whose middle is a letter."""
    lowered = [t.lower() for t in texts]
    joined = "\n" + "\n".join(lowered) + "\n"
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _is_letter()[code]
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]  # one edge stands for all that is between two words
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) + 1 for t in lowered])
    owner = np.append(np.int32(0), owner)[keep]
    code = np.where(letter, code, 0)[keep]
    used = np.zeros(0x110000, dtype=bool)
    used[code] = True
    used[0] = True
    alphabet = np.flatnonzero(used)
    place = np.zeros(0x110000, dtype=np.int32)
    place[alphabet] = np.arange(len(alphabet))
    s = place[code].astype(np.int64)
    n = len(alphabet)
    middle = np.flatnonzero(s[1:-1])
    joint = (s[middle] * n + s[middle + 1]) * n + s[middle + 2]
    if n**3 <= _DENSE:
        kinds = np.flatnonzero(np.bincount(joint, minlength=n**3))
        where = np.zeros(n**3, dtype=np.int32)
        where[kinds] = np.arange(len(kinds))
        kind = where[joint]
    else:
        kinds, kind = np.unique(joint, return_inverse=True)
    return owner[middle + 1], kind, alphabet[kinds // (n * n)], alphabet[kinds // n % n], alphabet[kinds % n]


def bound(a: np.ndarray, b: np.ndarray, c: np.ndarray, dim: int = DIM) -> np.ndarray:
    """The vectors of trigrams."""
    codes, place = np.unique(np.concatenate([a, b, c]), return_inverse=True)
    one = letter_vectors(codes, dim)
    first, second = np.roll(one, 2, axis=1), np.roll(one, 1, axis=1)
    n = len(a)
    return first[place[:n]] * second[place[n : 2 * n]] * one[place[2 * n :]]


def bundled(texts: list[str], group: np.ndarray, groups: int, dim: int = DIM) -> np.ndarray:
    """The sum of all trigram vectors of the texts in each group. The sums are integers, held exactly in single precision up to 2**24."""
    owner, kind, a, b, c = trigrams(texts)
    if not len(kind):
        return np.zeros((groups, dim), np.float32)
    counts = np.bincount(group[owner] * len(a) + kind, minlength=groups * len(a)).reshape(groups, len(a))
    return counts.astype(np.float32) @ bound(a, b, c, dim)


def _parts(texts: list[str | None]):
    """Index lists of texts that are counted together."""
    held, size = [], 0
    for i, t in enumerate(texts):
        if t:
            held.append(i)
            size += len(t)
        if size >= CHARS or len(held) >= DOCS:
            yield held
            held, size = [], 0
    if held:
        yield held


def _train(dim: int):
    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for part in _parts(texts):
                names = sorted({langs[i] for i in part})
                group = np.array([names.index(langs[i]) for i in part], dtype=np.int64)
                for name, row in zip(names, bundled([texts[i] for i in part], group, len(names), dim), strict=True):
                    sums[name] = sums.get(name, 0) + row.astype(np.int64)
        for name, row in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * dim), pa.array(range(dim), pa.int32()), pa.array(row)], names=["lang", "at", "value"])

    return run


def prototypes(labelled: DataFrame, dim: int = DIM) -> dict[str, np.ndarray]:
    """Unit prototype by language, from rows (lang, text) with a non-null lang."""
    sent = labelled.select("lang", "text").where("lang IS NOT NULL AND text IS NOT NULL").mapInArrow(_train(dim), "lang string, at int, value long")
    whole = sent.groupBy("lang", "at").agg(F.sum("value").alias("value"))
    rows = whole.limit(MOST * dim + 1).collect()
    if len(rows) > MOST * dim:
        raise ValueError(f"more than {MOST} languages")
    found: dict[str, np.ndarray] = {}
    for r in rows:
        found.setdefault(r.lang, np.zeros(dim))[r["at"]] = r.value
    return {k: v / n for k, v in sorted(found.items()) if (n := np.linalg.norm(v)) > 0}


def _predict(names: list[str], matrix: np.ndarray):
    dim = matrix.shape[1] if names else DIM

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            lang, score = np.full(len(texts), -1), np.zeros(len(texts))
            for part in _parts(texts) if names else ():
                vectors = bundled([texts[i] for i in part], np.arange(len(part)), len(part), dim).astype(np.float64)
                size = np.linalg.norm(vectors, axis=1)
                full = np.flatnonzero(size)
                cosine = vectors[full] @ matrix.T / size[full, None]
                at = np.array(part)[full]
                lang[at], score[at] = cosine.argmax(axis=1), np.clip(cosine.max(axis=1), 0, 1)
            keep = [batch.column(n) for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays(
                [*keep, pa.array([names[n] if n >= 0 else UNKNOWN for n in lang.tolist()], pa.string()), pa.array(score)],
                names=[*(n for n in batch.schema.names if n != "text"), "lang_pred", "score"],
            )

    return run


def predicted(docs: DataFrame, learned: dict[str, np.ndarray], keep: list[str]) -> DataFrame:
    """docs' columns `keep` with lang_pred and score (cosine with the prototype, at least 0)."""
    names = list(learned)
    matrix = np.array([learned[n] for n in names]) if names else np.zeros((0, DIM))
    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    return docs.select(*keep, "text").mapInArrow(_predict(names, matrix), f"{kinds}, lang_pred string, score double")


def held_out(doc_id) -> "F.Column":
    """Whether crc32 of doc_id as text leaves 2 when divided by 4; a null doc_id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, dim: int = DIM) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score. Rows that are not held out and have a doc_id and lang teach."""
    rows = docs.select("doc_id", "lang", "text", held_out(F.col("doc_id")).alias("held_out"))
    learned = prototypes(rows.where("NOT held_out AND doc_id IS NOT NULL"), dim)
    return predicted(rows, learned, ["doc_id", "held_out"])
