"""Scans of folder trees on a mount that the driver and all executors share.

`FolderSource` is a Spark data source, in batches and as a stream. The driver
lists the upper levels until there are enough folders to deal out; tasks walk
what is below. A folder of more than WIDE entries is not listed by the driver:
each task reads its names and takes a share of them by hash. Rows hold what a directory entry tells; contents are read by
`fingerprinted` and `with_text`, which deal the files anew, so that a folder
with a large share of all files is one task's listing but not its reading.

Links are not followed. Entries that go while they are listed and folders that
may not be read are left out; another error fails the task, which Spark tries
again. An empty or missing folder has no rows.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import time
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, InputPartition, LessThan, LessThanOrEqual, StringStartsWith

from tallgrass.functions import resource
from tallgrass.functions.paths import extension, stem

# Folders that scans leave out beside those that start with a dot, sizes for fingerprints, names of assets, and the first folder of a mirror by source.
SKIPPED = ["__pycache__", ".git", ".svn", ".hg", "node_modules", ".idea", ".vscode"]
FINGERPRINT_MOST, FINGERPRINT_PART, FINGERPRINT_DIGITS = 256 << 20, 64 << 10, 24
ASSETS = {"tvshow_nfo": ["tvshow.nfo"], "movie_nfo": ["movie.nfo"], "poster": ["poster.jpg", "poster.png", "poster.webp"], "fanart": ["fanart.jpg", "fanart.png", "fanart.webp"], "clearlogo": ["clearlogo.png", "clearlogo.svg", "clearlogo.webp"]}
NAMESPACES = {"pan115": "115", "baidu": "baidu", "local": "local", "openlist": "openlist"}

SCHEMA = "path string, parent string, name string, real_path string, is_dir boolean, depth int, size long, mtime double, changed long, entries long"
#: Folders for each task that the driver looks for before it deals them out, and the levels that it lists for them at most.
FOLDERS, UPPER = 4, 6
#: Entries of a folder that the driver looks at; a wider one is dealt out by shares.
WIDE = 4096


@dataclass
class Walk(InputPartition):
    """Folders (path below the root, depth) that a task lists, with all below them or alone; of those in `wide` the entries of share `share` of `shares`, with all below them."""

    folders: list[tuple[str, int]]
    deep: bool
    since: int = -1
    until: int = 1 << 62
    wide: tuple[tuple[str, int], ...] = ()
    share: int = 0
    shares: int = 1


def _skipped(name: str) -> bool:
    return name.startswith(".") or name in SKIPPED


class _Walker:
    """Lists folders. options: path; skip (leave out SKIPPED, default true), max_depth (a deeper folder is an error), splits."""

    def __init__(self, options):
        self.root = os.path.abspath(options["path"].removeprefix("file://").removeprefix("file:"))
        self.skip = options.get("skip", "true").lower() != "false"
        self.most = int(options["max_depth"]) if "max_depth" in options else None
        self.splits = int(options.get("splits", "16"))
        self.below, self.start = 1 << 30, ""

    def listed(self, folder: str, depth: int, share: int = 0, shares: int = 1) -> tuple[list[tuple[os.DirEntry, str, os.stat_result]], int]:
        """A share of a folder's entries by name, with their paths below the root, and the number of all its entries."""
        if self.most is not None and depth > self.most:
            raise ValueError(f"{folder} is deeper than {self.most} folders")
        found, total = [], 0
        try:
            with os.scandir(os.path.join(self.root, folder)) as entries:
                for entry in entries:
                    try:
                        if not (entry.is_dir(follow_symlinks=False) or entry.is_file(follow_symlinks=False)):
                            continue
                        if shares == 1 or zlib.crc32(os.fsencode(entry.name)) % shares == share:
                            found.append((entry, f"{folder}/{entry.name}" if folder else entry.name, entry.stat(follow_symlinks=False)))
                        total += 1
                    except OSError:
                        continue
        except (PermissionError, FileNotFoundError, NotADirectoryError):
            return [], 0
        return sorted(found, key=lambda x: x[0].name), total

    def is_wide(self, folder: str) -> bool:
        """Whether a folder has more than WIDE entries; no more of them are read."""
        try:
            with os.scandir(os.path.join(self.root, folder)) as entries:
                return sum(1 for _ in itertools.islice(entries, WIDE + 1)) > WIDE
        except (PermissionError, FileNotFoundError, NotADirectoryError):
            return False

    def inner(self, folder: str, depth: int) -> list[tuple[str, int]]:
        """Folders directly below that are walked."""
        if depth + 1 >= self.below:
            return []
        return [(path, depth + 1) for e, path, _ in self.listed(folder, depth)[0] if self._walked(e, path, depth)]

    def _walked(self, entry: os.DirEntry, path: str, depth: int) -> bool:
        return entry.is_dir(follow_symlinks=False) and not (self.skip and _skipped(entry.name)) and depth + 1 < self.below and self._on_the_way(path)

    def _on_the_way(self, path: str) -> bool:
        return path.startswith(self.start) or self.start.startswith(path + "/")

    def deal(self, since: int = -1, until: int = 1 << 62) -> list[Walk]:
        """The upper folders one by one, wide ones by shares of their entries, and what is below the others in about `splits` parts."""
        level, alone, wide = [("", 0)], [], []
        for _ in range(UPPER):
            if len(level) >= FOLDERS * self.splits or not level:
                break
            of = {x: self.is_wide(x[0]) for x in level}
            wide += [x for x in level if of[x]]
            level = [x for x in level if not of[x]]
            alone += level
            level = [x for folder in level for x in self.inner(*folder)]
        parts = [Walk(level[i :: self.splits], True, since, until) for i in range(min(self.splits, len(level)))]
        parts += [Walk([], True, since, until, tuple(wide), i, self.splits) for i in range(self.splits) if wide]
        return parts + [Walk(alone[i :: self.splits], False, since, until) for i in range(min(self.splits, len(alone)))] or [Walk([], False)]

    def rows(self, part: Walk) -> Iterator[tuple]:
        """A row for each entry; a folder's number of entries stands in the row of the folder itself, which its own listing gives."""
        todo = [(*x, 0, 1) for x in part.folders] + [(*x, part.share, part.shares) for x in part.wide]
        while todo:
            folder, depth, share, shares = todo.pop()
            entries, total = self.listed(folder, depth, share, shares)
            if share == 0:
                yield self._row(folder, os.path.basename(folder), depth, None, total)
            for entry, path, stat in entries:
                if entry.is_dir(follow_symlinks=False):
                    if part.deep and self._walked(entry, path, depth):
                        todo.append((path, depth + 1, 0, 1))
                elif part.since < max(stat.st_mtime_ns, stat.st_ctime_ns) <= part.until:
                    yield self._row(path, entry.name, depth + 1, stat, None)

    def _row(self, path: str, name: str, depth: int, stat: os.stat_result | None, entries: int | None) -> tuple:
        parent = path[: -len(name) - 1] if "/" in path else ""
        of = (stat.st_size, stat.st_mtime, max(stat.st_mtime_ns, stat.st_ctime_ns)) if stat else (None, None, None)
        return (path, parent, name, os.path.join(self.root, path), stat is None, depth, *of, entries)


class _Reader(_Walker, DataSourceReader):
    def partitions(self):
        return self.deal()

    def read(self, partition):
        return self.rows(partition)


class _Pushed(_Reader):
    """Spark refuses a reader that takes filters unless spark.sql.python.filterPushdown.enabled is set, so this is one of its own."""

    def pushFilters(self, filters):
        """A bound of depth and the start of path spare the folders beyond them; Spark applies all filters again."""
        for f in filters:
            if isinstance(f, LessThan | LessThanOrEqual | EqualTo) and f.attribute == ("depth",):
                self.below = min(self.below, int(f.value) + (not isinstance(f, LessThan)))
            elif isinstance(f, StringStartsWith | EqualTo) and f.attribute == ("path",):
                self.start = f.value if len(f.value) > len(self.start) else self.start
        return filters


class _Stream(_Walker, DataSourceStreamReader):
    """Files by the time of their last change: an offset is a time in nanoseconds, `settle` seconds (default 1) before now, as a file may still change within them."""

    def __init__(self, options):
        super().__init__(options)
        self.since, self.settle = int(options.get("since", "-1")), float(options.get("settle", "1"))

    def initialOffset(self):
        return {"at": self.since}

    def latestOffset(self):
        return {"at": time.time_ns() - int(self.settle * 1e9)}

    def partitions(self, start, end):
        return self.deal(start["at"], end["at"])

    def read(self, partition):
        return (row for row in self.rows(partition) if not row[4])

    def commit(self, end):
        """Offsets are times: nothing is held for them."""


class FolderSource(DataSource):
    """spark.read.format("folder_tree"), options path, skip, max_depth, splits, and push (take filters); as a stream since and settle, too."""

    @classmethod
    def name(cls) -> str:
        return "folder_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return (_Pushed if self.options.get("push") == "true" else _Reader)(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)


def nodes(spark: SparkSession, root: str, skip: bool = True, max_depth: int | None = None, max_entries: int | None = None) -> DataFrame:
    """Folders and files below root (SCHEMA; the root itself has path ''). A folder below max_depth, or more than max_entries entries in all, is an error (the latter by a count before the result is given)."""
    spark.dataSource.register(FolderSource)
    reader = spark.read.format("folder_tree").option("path", root).option("skip", str(skip).lower()).option("push", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    rows = (reader if max_depth is None else reader.option("max_depth", max_depth)).load()
    if max_entries is not None and (rows.agg(F.sum("entries")).first()[0] or 0) > max_entries:
        raise ValueError(f"{root} has more than {max_entries} entries")
    return rows


def listed_files(rows: DataFrame, source: str = "local", root_name: str | None = None) -> DataFrame:
    """The files among nodes, without system files, with stem, ext, virtual_root, kind and id. root_name: paths start with it."""
    path = F.concat(F.lit(f"{root_name}/"), F.col("path")) if root_name else F.col("path")
    top = F.when(path.contains("/"), F.substring_index(path, "/", 1)).otherwise("")
    above = F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")
    files = rows.where(~F.col("is_dir") & ~resource.is_system("name"))
    return files.select(
        path.alias("path"), top.alias("virtual_root"), above.alias("parent"), "name", stem("name").alias("stem"), extension("name").alias("ext"), F.size(F.split(path, "/")).alias("depth"),
        "real_path", resource.kind(F.lit(""), extension("name")).alias("kind"), "size", "mtime", resource.stable_id(F.lit(source), path).alias("id"),
    )


def _fingerprint(path: str, size: int | None) -> str:
    if size is None or not 0 <= size <= FINGERPRINT_MOST:
        return ""
    try:
        digest = hashlib.sha256(str(size).encode())
        with open(path, "rb") as f:
            digest.update(f.read(FINGERPRINT_PART))
            if size > FINGERPRINT_PART:
                f.seek(size - FINGERPRINT_PART)
                digest.update(f.read(FINGERPRINT_PART))
        return digest.hexdigest()[:FINGERPRINT_DIGITS]
    except OSError:
        return ""


def _with(files: DataFrame, name: str, of, splits: int | None) -> DataFrame:
    """files, dealt evenly, with the column `name`: of(real_path, size)."""
    keep = [c for c in files.columns if c != name]

    def run(batches):
        for batch in batches:
            found = [of(p, s) for p, s in zip(batch.column("real_path").to_pylist(), batch.column("size").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(found, pa.string())], names=[*keep, name])

    dealt = files.repartition(splits, "real_path") if splits else files.repartition("real_path")
    return dealt.mapInArrow(run, files.drop(name).schema.add(name, "string"))


def fingerprinted(files: DataFrame, splits: int | None = None) -> DataFrame:
    """files (real_path, size, ...) with fingerprint: of the size, the first and the last part; '' for large and unreadable files."""
    return _with(files, "fingerprint", _fingerprint, splits)


def with_text(files: DataFrame, most: int = 64 << 10, splits: int | None = None) -> DataFrame:
    """files with text: the trimmed content of small UTF-8 files; null for larger, unreadable and other ones."""

    def text(path: str, size: int | None) -> str | None:
        try:
            if size is None or size > most:
                return None
            with open(path, encoding="utf-8") as f:
                return f.read().strip()
        except (OSError, UnicodeDecodeError):
            return None

    return _with(files, "text", text, splits)


def paged(rows: DataFrame, per_page: int) -> DataFrame:
    """Nodes with page (from 1, `per_page` members of a folder by name) and total, the folder's members; the root is no member."""
    own = Window.partitionBy("parent")
    members = rows.where("path != ''")
    return members.select("*", (F.floor((F.row_number().over(own.orderBy("name")) - 1) / per_page) + 1).cast("int").alias("page"), F.count("*").over(own).alias("total"))


def mirror_files(rows: DataFrame, source: str | None = None) -> DataFrame:
    """Of a mirror's nodes (listed without skipping) the stream files, with the path that each holds ('' if unreadable), and the assets with their kind.

    Columns path, namespace, source, kind ('strm' or an asset's), real_path, size, mtime. A file at the top belongs to no namespace and is left out; source: only that one's namespace.
    """
    lower = F.lower("name")
    kind = F.when(lower.endswith(".strm"), "strm")
    for asset, names in ASSETS.items():
        kind = kind.when(lower.isin(*names), asset)
    space = F.substring_index("path", "/", 1)
    files = rows.where(~F.col("is_dir") & F.col("path").contains("/")).select("path", space.alias("namespace"), _source_of(space, source).alias("source"), kind.alias("kind"), "real_path", "size", "mtime").where("kind IS NOT NULL")
    if source is not None:
        files = files.where(F.col("namespace") == NAMESPACES.get(source, source))
    # One walk of the tree for both: a size is what with_text reads a file by.
    strm = F.col("kind") == "strm"
    held = with_text(files.withColumn("_size", F.col("size")).withColumn("size", F.when(strm, F.col("size"))))
    return held.select("path", "namespace", "source", "kind", F.when(strm, F.coalesce("text", F.lit(""))).otherwise(F.col("real_path")).alias("real_path"), F.col("_size").alias("size"), "mtime")


def _source_of(space: Column, source: str | None) -> Column:
    """The source that a namespace stands for, the namespace itself where none does."""
    if source is not None:
        return F.lit(source)
    found = space
    for name, of in NAMESPACES.items():
        found = F.when(space == of, name).otherwise(found)
    return found


def write_tree(rows: DataFrame, root: str) -> int:
    """Write (path, content binary) as files below root, a path that executors can open; the number written. A file appears whole: it is renamed into its place, so that a task tried again leaves the same. Rows are dealt over the shuffle partitions, as a small table is one task's split but many files."""
    base = root.removeprefix("file://").removeprefix("file:")
    if "://" in base:
        raise ValueError(f"{root} is no mounted folder")

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                at = os.path.join(base, path)
                os.makedirs(os.path.dirname(at), exist_ok=True)
                part = f"{at}.{os.getpid()}.part"
                with open(part, "wb") as f:
                    f.write(content or b"")
                os.replace(part, at)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    dealt = rows.where("path IS NOT NULL").select("path", "content").repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")
    return dealt.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0
