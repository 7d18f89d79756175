"""Folder scans over trees on disk."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from tallgrass.sources import folders

FILES = {"a.mkv": 3, "d1/b.mp4": 70_000, "d1/Thumbs.db": 1, "d1/d2/c.srt": 0, "d1/d2/d3/e": 131_072, ".git/x": 1, "d1/.hidden/y.mkv": 1, "d4/node_modules/z.mkv": 1, "d4/.dot.mkv": 2, "d5/名.mkv": 65_536, "d5/%a_b.mkv": 1}


@pytest.fixture
def root(tmp_path):
    for path, size in FILES.items():
        at = tmp_path / "tree" / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(os.urandom(size))
    (tmp_path / "tree/empty").mkdir()
    os.symlink(tmp_path / "tree/d1", tmp_path / "tree/link")
    os.symlink(tmp_path / "tree/a.mkv", tmp_path / "tree/link.mkv")
    return str(tmp_path / "tree")


WALKED = {p for p in FILES if not p.startswith((".git", "d1/.hidden", "d4/node_modules"))}


def test_files(spark, root):
    rows = folders.fingerprinted(folders.listed_files(folders.nodes(spark, root), root_name="top")).collect()
    assert {r.path for r in rows} == {f"top/{p}" for p in WALKED} - {"top/d1/Thumbs.db"}
    for r in rows:
        data = open(r.real_path, "rb").read()
        part = data[:65536] + (data[-65536:] if len(data) > 65536 else b"")
        assert (r.size, r.fingerprint) == (len(data), hashlib.sha256(str(len(data)).encode() + part).hexdigest()[:24])
        assert (r.virtual_root, r.parent, r.depth) == ("top", os.path.dirname(r.path), r.path.count("/") + 1)
        assert r.id == hashlib.md5(f"local:{r.path}".encode()).hexdigest() and r.mtime == os.stat(r.real_path).st_mtime
    by = {r.name: r for r in rows}
    assert (by["b.mp4"].kind, by["c.srt"].kind, by["e"].ext, by[".dot.mkv"].stem, by[".dot.mkv"].ext) == ("video", "subtitle", "", ".dot", ".mkv")


@pytest.mark.parametrize("upper", [0, 1, 6])
def test_every_deal_gives_the_same(spark, root, upper, monkeypatch):
    monkeypatch.setattr(folders, "UPPER", upper)
    rows = folders.nodes(spark, root, skip=False).collect()
    assert sorted(r.path for r in rows if not r.is_dir) == sorted(FILES)
    want = {d for d, _, _ in os.walk(root)}
    assert sorted(r.real_path.rstrip("/") for r in rows if r.is_dir) == sorted(want)
    assert {r.path: r.entries for r in rows if r.is_dir}["d1/d2"] == 2


def test_wide_folders_are_dealt_by_shares(spark, root, tmp_path, monkeypatch):
    """The driver doesn't list a wide folder, whose entries fall to all tasks, each once."""
    for n in range(300):
        at = tmp_path / "tree" / "d1" / str(n)
        at.mkdir()
        (at / "x.mkv").write_bytes(b"1")
    row = lambda r: (r[0], r[1], r[2], r[4], r[5], r[6], r[9])
    reader = folders._Reader({"path": root})
    want = sorted(row(r) for p in reader.partitions() for r in reader.read(p))
    monkeypatch.setattr(folders, "WIDE", 100)
    asked = []
    listed = reader.listed
    monkeypatch.setattr(reader, "listed", lambda folder, *more: asked.append(folder) or listed(folder, *more))
    parts = reader.partitions()
    assert "d1" not in asked and len(parts) <= 3 * reader.splits
    assert sorted(row(r) for p in parts for r in reader.read(p)) == want
    assert sum(any(r[0].startswith("d1/") for r in reader.read(p)) for p in parts) == reader.splits


def test_files_are_written_and_walked_in_all_tasks(spark, tmp_path):
    rows = spark.range(200).coalesce(1).selectExpr("concat(id % 3, '/', id, '/e.strm') AS path", "encode(id, 'UTF-8') AS content")
    at = f"{tmp_path}/all"
    spark.sparkContext.setJobGroup("written", "")
    try:
        assert folders.write_tree(rows, at) == 200
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("written") for s in tracker.getJobInfo(j).stageIds]
    assert max(s.numTasks for s in stages if s) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = folders.mirror_files(folders.nodes(spark, at, skip=False))
    assert found._jdf.queryExecution().executedPlan().toString().count("BatchScan") == 1
    assert {(r.path, r.real_path, r.size) for r in found.collect()} == {(f"{n % 3}/{n}/e.strm", str(n), len(str(n))) for n in range(200)}


def test_limits(spark, root, tmp_path):
    with pytest.raises(Exception, match="deeper than 2"):
        folders.nodes(spark, root, max_depth=2).collect()
    assert folders.nodes(spark, root, max_depth=3).count() and folders.nodes(spark, root, max_entries=17).count()
    with pytest.raises(ValueError, match="more than 9 entries"):
        folders.nodes(spark, root, max_entries=9)
    assert folders.nodes(spark, str(tmp_path / "missing")).where("path != ''").count() == 0


def test_pushed_filters(spark, root):
    reader = folders._Pushed({"path": root})
    kept = [folders.LessThanOrEqual(("depth",), 1), folders.StringStartsWith(("path",), "d1/d2")]
    assert list(reader.pushFilters(kept)) == kept
    assert {r[0] for p in reader.partitions() for r in reader.read(p)} == {"", "a.mkv", "d1", "d1/b.mp4", "d1/Thumbs.db"}  # a folder is listed for its own number of entries
    reader = folders._Pushed({"path": root})
    reader.pushFilters(kept[1:])
    assert {r[0] for p in reader.partitions() for r in reader.read(p) if r[4]} == {"", "d1", "d1/d2", "d1/d2/d3"}
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        rows = folders.nodes(spark, root)
        assert {r.path for r in rows.where("depth <= 2 AND NOT is_dir").collect()} == {p for p in WALKED if p.count("/") < 2}
        assert {r.path for r in rows.where(F.col("path").startswith("d1/d2") & ~F.col("is_dir")).collect()} == {"d1/d2/c.srt", "d1/d2/d3/e"}
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_pages(spark, root):
    rows = folders.paged(folders.nodes(spark, root, skip=False), 2).where("parent = ''").orderBy("name").collect()
    assert [(r.name, r.page, r.total) for r in rows] == [(".git", 1, 6), ("a.mkv", 1, 6), ("d1", 2, 6), ("d4", 2, 6), ("d5", 3, 6), ("empty", 3, 6)]


def test_mirror(spark, tmp_path):
    tree = {"115/W/e.strm": b" /x/y.mkv \n", "115/W/tvshow.nfo": b"<a/>", "own/FANART.PNG": b"1", "own/bad.strm": b"\xff", "own/other.txt": b"", "top.strm": b"z"}
    assert folders.write_tree(spark.createDataFrame([*tree.items(), (None, b"x")], "path string, content binary"), f"file://{tmp_path}/m") == 6
    rows = folders.nodes(spark, f"{tmp_path}/m", skip=False)
    got = {r.path: (r.source, r.kind, r.real_path if r.kind == "strm" else None) for r in folders.mirror_files(rows).collect()}
    assert got == {"115/W/e.strm": ("pan115", "strm", "/x/y.mkv"), "115/W/tvshow.nfo": ("pan115", "tvshow_nfo", None), "own/FANART.PNG": ("own", "fanart", None), "own/bad.strm": ("own", "strm", "")}
    assert {r.path for r in folders.mirror_files(rows, "pan115").collect()} == {"115/W/e.strm", "115/W/tvshow.nfo"}


def test_stream_over_restarts(spark, root, tmp_path):
    """Each micro-batch has the files changed since the last, over restarts from the checkpoint."""
    spark.dataSource.register(folders.FolderSource)

    def once():
        stream = spark.readStream.format("folder_tree").option("path", root).option("settle", "0").load()
        stream.select("path", "size").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start().awaitTermination(120)
        return sorted(r.path for r in spark.read.schema("path string, size long").parquet(f"{tmp_path}/out").collect())

    assert once() == sorted(WALKED)
    with open(f"{root}/d1/new.mkv", "wb") as f:
        f.write(b"1")
    os.rename(f"{root}/a.mkv", f"{root}/d4/moved.mkv")
    assert once() == sorted([*WALKED, "d1/new.mkv", "d4/moved.mkv"])
    assert once() == sorted([*WALKED, "d1/new.mkv", "d4/moved.mkv"])
