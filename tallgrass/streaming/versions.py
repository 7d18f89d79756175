"""Tables in copy-on-write versions behind a pointer, and a stream of listing pages that commits to them.

A version is a small JSON file that names, for each table and bucket, the folder
of Parquet files that holds it. A commit writes the buckets that changed to new
folders and then renames the next version's file into its place, which fails if
that number exists: readers see a whole version or the one before, a task or
driver that dies leaves files that nothing names, and of two writers that start
from one version the later gets `Conflict` and changes nothing. Each writer's
last batch is part of the version, so a batch that Spark sends again after a
restart is seen and skipped.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallgrass.operators import staging


class Conflict(Exception):
    """Another writer has committed since the version was read."""


class Tables:
    """Versioned tables below `root`. layout: name to (schema, columns that a bucket's number is taken from); `buckets` of each table, fixed by the first version."""

    def __init__(self, spark: SparkSession, root: str, layout: dict[str, tuple[str, list[str]]], buckets: int = 64):
        self.spark, self.root, self.layout, self.buckets = spark, root.rstrip("/"), layout, buckets
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._files = self._path(self.root).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._files.getUri(), conf)
        self._no_options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        self._files.mkdirs(self._path(f"{self.root}/versions"))

    def _named(self, number: int):
        return self._path(f"{self.root}/versions/{number:012d}.json")

    def numbers(self) -> list[int]:
        """The versions that exist, in order."""
        names = [x.getPath().getName() for x in self._files.listStatus(self._path(f"{self.root}/versions"))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def version(self, number: int | None = None) -> dict:
        """A version, the last by default: number, writers (last batch of each) and tables (bucket to folder)."""
        if number is None:
            number = max(self.numbers(), default=0)
        if not number:
            return {"number": 0, "writers": {}, "tables": {t: {} for t in self.layout}}
        stream = self._files.open(self._named(number))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self, name: str, version: dict | None = None) -> DataFrame:
        """A table at a version. Its files are named one by one, so what later commits write doesn't show."""
        version = version or self.version()
        schema = StructType.fromDDL(self.layout[name][0])
        paths = sorted(version["tables"][name].values())
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{p}" for p in paths)) if paths else self.spark.createDataFrame([], schema)

    def bucket(self, name: str) -> Column:
        return F.pmod(F.xxhash64(*self.layout[name][1]), F.lit(self.buckets)).cast("int")

    def commit(self, base: dict, changes: dict[str, DataFrame], touched: dict[str, DataFrame], writer: str | None = None, batch: int = 0) -> dict:
        """The version after `base` with `changes` (whole tables, of which only the buckets of the rows `touched` are written); base itself where this batch of this writer was committed already."""
        if writer is not None and self.version()["writers"].get(writer, -1) >= batch:
            return self.version()
        tables = {t: dict(b) for t, b in base["tables"].items()}
        for name, rows in changes.items():
            some = sorted(r[0] for r in touched[name].select(self.bucket(name)).distinct().collect())  # at most `buckets` numbers
            if not some:
                continue
            at = f"data/{uuid.uuid4().hex}"
            kept = rows.select(*StructType.fromDDL(self.layout[name][0]).names).withColumn("_bucket", self.bucket(name)).where(F.col("_bucket").isin(some))
            kept.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/{at}")
            for b in some:
                folder = f"{at}/_bucket={b}"
                tables[name].pop(str(b), None)
                if self._files.exists(self._path(f"{self.root}/{folder}")):
                    tables[name][str(b)] = folder
        writers = base["writers"] | ({writer: batch} if writer is not None else {})
        new = {"number": base["number"] + 1, "writers": writers, "tables": tables}
        part = self._path(f"{self.root}/versions/.{uuid.uuid4().hex}")
        out = self._files.create(part)
        out.write(json.dumps(new).encode())
        out.close()
        try:
            self._context.rename(part, self._named(new["number"]), self._no_options)
        except Py4JJavaError as error:
            self._files.delete(part, False)
            if "FileAlreadyExists" not in error.java_exception.toString():
                raise
            raise Conflict(f"version {new['number']} exists") from None
        return new

    def vacuum(self, keep: int = 2) -> int:
        """Delete all but the last `keep` versions and the folders that these don't name; the number of folders deleted. Not while a writer is between reading and committing."""
        numbers = self.numbers()
        for n in numbers[:-keep]:
            self._files.delete(self._named(n), False)
        named = {p for n in numbers[-keep:] for t in self.version(n)["tables"].values() for p in t.values()}
        gone = 0
        data = self._path(f"{self.root}/data")
        for batch in self._files.listStatus(data) if self._files.exists(data) else []:
            for bucket in self._files.listStatus(batch.getPath()):
                if bucket.isDirectory() and f"data/{batch.getPath().getName()}/{bucket.getPath().getName()}" not in named:
                    gone += bool(self._files.delete(bucket.getPath(), True))
        return gone


def catalog_tables(spark: SparkSession, root: str, buckets: int = 64) -> Tables:
    """nodes by folder, folders by place, and stage: pages of runs that aren't decided yet."""
    return Tables(spark, root, {"nodes": (staging.NODES, ["root", "parent"]), "folders": (staging.FOLDERS, ["root", "path"]), "stage": (staging.PAGES, ["run"])}, buckets)


def commit_pages(tables: Tables, pages: DataFrame, roots: DataFrame, stamp: str, now: Column, writer: str | None = None, batch: int = 0) -> DataFrame:
    """Add pages to the stage and commit what they complete, in one version; the verdicts of all runs concerned.

    A page that comes again replaces itself. Runs that aren't 'open' any more
    leave the stage, whatever their verdict: refused, stale and superseded ones
    change nothing else.
    """
    base = tables.version()
    nodes, folders, stage = (tables.read(t, base) for t in ("nodes", "folders", "stage"))
    again = pages.select("run", "page").distinct()
    staged = stage.join(again, ["run", "page"], "left_anti").unionByName(pages)
    runs = staging.fenced(staging.verdicts(staged), roots).persist()
    try:
        changed = staging.merged(nodes, staged, runs, stamp)
        after = staging.queued(folders, changed, staged, runs, now)
        still = staged.join(runs.where("verdict = 'open'").select("run"), "run", "left_semi")
        # What is written: buckets of nodes that changed, of folders that differ, of runs met.
        differ = after.join(folders.withColumnsRenamed({"state": "_s", "accepted": "_a", "verified_at": "_v"}).select("root", "path", "_s", "_a", "_v", F.lit(True).alias("_in")), ["root", "path"], "full")
        differ = differ.where("_in IS NULL OR state IS NULL OR state != _s OR NOT accepted <=> _a OR NOT verified_at <=> _v")
        touched = {"nodes": changed.where("change IS NOT NULL"), "folders": differ, "stage": pages.select("run").unionByName(stage.join(runs.where("verdict != 'open'"), "run", "left_semi").select("run"))}
        tables.commit(base, {"nodes": changed, "folders": after, "stage": still}, touched, writer, batch)
        return tables.spark.createDataFrame(runs.collect(), runs.schema) if writer is None else runs
    finally:
        runs.unpersist()


def committing(tables: Tables, roots: Callable[[], DataFrame], writer: str, stamp: Callable[[], str], now: Callable[[], Column]) -> Callable[[DataFrame, int], None]:
    """For writeStream.foreachBatch: each micro-batch of pages in one version. A batch that meets another writer's commit starts over from its version."""

    def apply(pages: DataFrame, batch: int) -> None:
        while True:
            try:
                commit_pages(tables, pages, roots(), stamp(), now(), writer, batch)
                return
            except Conflict:
                continue

    return apply
