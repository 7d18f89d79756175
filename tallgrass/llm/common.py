"""What the operators share: tables in the shared folder, word and hash kernels."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, in Java's and DuckDB's syntax: ASCII white space ends it, nothing else does.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one pass of the numpy kernels holds as 64-bit values.
CHUNK = 4 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local master, as in tests, gets a new one under /tmp where that is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share: intermediate tables are written there")
        at = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it again. Unlike cached blocks, the files outlive executors.

    The write's own shuffle files go as soon as it ends, so that steps that
    follow one another don't add up on the executors' disks. `release` deletes
    the table; one that a query's result still reads goes when the driver ends.
    """
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, "false")
    path = new_path(df.sparkSession, label)
    conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(_CLEANUP, before)
    at, files = _file_system(df.sparkSession, path)
    files.deleteOnExit(at)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def release(*tables: DataFrame) -> None:
    """Delete stored tables whose last reader has been stored itself."""
    for table in tables:
        at, files = _file_system(table.sparkSession, table.stored_at)
        files.delete(at, True)
        files.cancelDeleteOnExit(at)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def normalised(texts: list[bytes | None]) -> bytes:
    """Every text's words joined by one space, texts ended by line feeds. bytes.split() breaks at exactly the bytes that WORD excludes."""
    return b"".join(b" ".join(t.split()) + b"\n" if t else b"\n" for t in texts)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the constants are those of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An ordered pair of hashes as one hash."""
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + b)


_MASK = np.array([0] + [(1 << (8 * n)) - 1 for n in range(1, 9)], dtype=np.uint64)


class Words:
    """The words of a normalised buffer: byte ranges, text index and 64-bit hash of each."""

    def __init__(self, buf: bytes):
        self.buf = buf
        b = np.frombuffer(buf + b"\0" * 8, dtype=np.uint8)
        sep = np.flatnonzero((b[: len(buf)] == 32) | (b[: len(buf)] == 10))
        first = np.empty(len(sep), dtype=np.int64)
        if len(sep):
            first[0] = 0
            first[1:] = sep[:-1] + 1
        text = np.cumsum(b[sep] == 10) - (b[sep] == 10)
        self.n_texts = int((b[sep] == 10).sum())
        full = sep > first
        self.start, self.end, self.text = first[full], sep[full].astype(np.int64), text[full]
        self.hash = self._hashes(b)

    def _hashes(self, b: np.ndarray) -> np.ndarray:
        wide = np.ndarray((max(len(b) - 7, 0),), dtype="<u8", buffer=b.data, strides=(1,))
        size = self.end - self.start
        h = mix(size.astype(np.uint64) + np.uint64(1))
        if len(size):
            h = paired(h, wide[self.start] & _MASK[np.minimum(size, 8)])
            rest, at = np.flatnonzero(size > 8), 8
            while len(rest):
                h[rest] = paired(h[rest], wide[self.start[rest] + at] & _MASK[np.minimum(size[rest] - at, 8)])
                at += 8
                rest = rest[size[rest] > at]
        return h

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every window of k words within one text."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        first = np.flatnonzero(self.text[: n] == self.text[k - 1 :])
        return first, window_hashes(self.hash, k)[first]

    def counts(self) -> np.ndarray:
        return np.bincount(self.text, minlength=self.n_texts)


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of h[i : i + k] for each i, by doubling."""
    out, have, power, width, n = None, 0, h, 1, len(h) - k + 1
    while True:
        if k & width:
            out = power[have : have + n] if out is None else paired(out, power[have : have + n])
            have += width
        if width * 2 > k:
            return out
        power = paired(power[:-width], power[width:])
        width *= 2


def chunks(texts: list[bytes | None], limit: int = CHUNK):
    """Index ranges of consecutive texts of about `limit` bytes; a longer text is alone."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= limit:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def texts_of(column) -> list[bytes | None]:
    """An Arrow string column as UTF-8 bytes."""
    import pyarrow as pa

    return column.cast(pa.large_binary()).to_pylist()


def let(value, f) -> "F.Column":
    """f(value) with value computed once: inside a lambda, an expression would run for every element."""
    return F.element_at(F.transform(F.array(value), f), 1)


def split_words(text) -> "F.Column":
    """The words of a text as an array, on the JVM; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def n_words(text) -> "F.Column":
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def smallest(rows: DataFrame, hashed: F.Column, bound: int, *ties: str) -> DataFrame:
    """The `bound` rows of the smallest hashes, or about as many: those above a threshold go first, so that no task has more than its share to sort and send."""
    total = rows.count()
    share = min(1.0, 1.5 * (bound + 64) / max(1, total))
    below = F.shiftrightunsigned(hashed, 1) <= F.lit(min(int(share * (1 << 63)), (1 << 63) - 1))
    return rows.where(below).orderBy(F.shiftrightunsigned(hashed, 1), *ties).limit(bound)
