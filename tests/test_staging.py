"""Commits of listings page by page: refusals, fences, tombstones, versions and streams."""

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from tallgrass.operators import staging
from tallgrass.session import shared_folder
from tallgrass.streaming import versions

def now():
    return F.lit(dt.datetime(2024, 1, 1))


def page(run, folder, number, total, last, *entries, root="r", generation=2):
    rows = [(run, root, folder, generation, number, total, last, f"{folder}/{n}", n, *rest) for n, *rest in entries]
    return rows or [(run, root, folder, generation, number, total, last, None, None, None, None, None)]


def f(name, size=1, mtime=1.0):
    return (name, "file", size, mtime)


def d(name, mtime=None):
    return (name, "dir", None, mtime)


def pages(spark, *some):
    return spark.createDataFrame([r for p in some for r in p], staging.PAGES)


def roots(spark, **active):
    return spark.createDataFrame(list(active.items()), "root string, active int")


def test_verdicts(spark):
    rows = pages(
        spark,
        page("ok", "/a", 1, 3, False, f("x"), f("y")), page("ok", "/a", 2, 3, True, f("z")), page("none", "/b", 1, 0, True),
        page("same page", "/c", 1, 2, True, f("x"), f("x")), page("two pages", "/c", 1, 3, False, f("x"), f("y")), page("two pages", "/c", 2, 3, True, f("x")),
        page("drift", "/d", 1, 2, False, f("x")), page("drift", "/d", 2, 3, True, f("y")), page("untold", "/d", 1, 2, False, f("x")), page("untold", "/d", 2, None, True, f("y")),
        page("over", "/e", 1, 1, True, f("x"), f("y")), page("short", "/f", 1, 5, True, f("x")), page("open", "/g", 1, 5, False, f("x")), page("no total", "/h", 1, None, True, f("x")), page("no total, open", "/h", 1, None, False, f("x")),
    )
    got = {r.run: (r.n, r.verdict) for r in staging.verdicts(rows).collect()}
    assert got == {"ok": (3, "complete"), "none": (0, "complete"), "same page": (2, "repeated"), "two pages": (3, "repeated"), "drift": (2, "drift"), "untold": (2, "drift"), "over": (2, "over"), "short": (1, "short"), "open": (1, "open"), "no total": (1, "complete"), "no total, open": (1, "open")}


def test_fence(spark):
    rows = pages(spark, page("late", "/a", 1, 1, True, f("x"), generation=1), page("first", "/a", 1, 1, True, f("x")), page("second", "/a", 1, 1, True, f("x")), page("other", "/a", 1, 1, True, f("x"), root="q", generation=1), page("open", "/b", 1, 2, False, f("x"), generation=1))
    got = {r.run: r.verdict for r in staging.fenced(staging.verdicts(rows), roots(spark, r=2)).collect()}
    assert got == {"late": "stale", "first": "superseded", "second": "accepted", "other": "accepted", "open": "open"}


NODES = [
    ("r", "/a/same", "/a", "same", "file", 1, 1.0, 1, 1, ""), ("r", "/a/size", "/a", "size", "file", 1, 1.0, 1, 1, ""), ("r", "/a/back", "/a", "back", "file", 1, 1.0, 1, 1, "gone"), ("r", "/a/lost", "/a", "lost", "file", 1, 1.0, 1, 1, ""),
    ("r", "/a/dead", "/a", "dead", "file", 1, 1.0, 1, 1, "gone"), ("r", "/a/now", "/a", "now", "file", 1, 1.0, 2, 2, ""), ("r", "/a/dir", "/a", "dir", "dir", None, 1.0, 1, 1, ""), ("r", "/a/dir/x", "/a/dir", "x", "file", 1, 1.0, 1, 1, None),
    ("r", "/a/dir/y", "/a/dir", "y", "file", 1, 1.0, 1, 1, "long ago"), ("r", "/a/dirt", "/a", "dirt", "dir", None, 1.0, 1, 1, ""), ("r", "/a/dirt/z", "/a/dirt", "z", "file", 1, 1.0, 1, 1, ""), ("r", "/a/un", "/a", "un", "dir", None, None, 1, 1, ""), ("r", "/a/mv", "/a", "mv", "dir", None, 1.0, 1, 1, ""), ("r", "/a/sc", "/a", "sc", "dir", None, 1.0, 1, 1, ""), ("q", "/a/lost", "/a", "lost", "file", 1, 1.0, 1, 1, ""), ("r", "/b/o", "/b", "o", "file", 1, 1.0, 1, 1, ""),
]
LISTED = [f("same"), f("size", 2), f("back"), f("new"), d("dirt", 1.0), d("un", 5.0), d("mv", 9.0), d("sc", 9.0), d("fresh")]


def folder(path, state, **more):
    return ("r", path, path.rsplit("/", 1)[0], path.count("/"), state, 1, 0, "", None, None)


@pytest.fixture
def start(spark):
    names = {"/a": "queued", "/a/dir": "complete", "/a/dir/in": "queued", "/a/dirt": "complete", "/a/mv": "complete", "/a/sc": "scanning", "/b": "complete"}
    return spark.createDataFrame(NODES, staging.NODES), spark.createDataFrame([folder(p, s) for p, s in names.items()], staging.FOLDERS)


WANT = {
    "/a/same": ("unchanged", "", 2), "/a/size": ("updated", "", 2), "/a/back": ("unchanged", "", 2), "/a/lost": ("missing", "T", 1), "/a/dead": (None, "gone", 1), "/a/now": (None, "", 2), "/a/dir": ("missing", "T", 1), "/a/dir/x": ("missing", "T", 1),
    "/a/dir/y": (None, "long ago", 1), "/a/dirt": ("unchanged", "", 2), "/a/dirt/z": (None, "", 1), "/a/un": ("updated", "", 2), "/a/mv": ("updated", "", 2), "/a/sc": ("updated", "", 2), "/b/o": (None, "", 1), "/a/new": ("added", "", 2), "/a/fresh": ("added", "", 2),
}


def test_merge_and_queue(spark, start):
    nodes, folders = start
    some = pages(spark, page("1", "/a", 1, 9, True, *LISTED))
    runs = staging.fenced(staging.verdicts(some), roots(spark, r=2))
    changed = staging.merged(nodes, some, runs, "T")
    got = {(r.root, r.path): (r.change, r.tombstone, r.last_seen) for r in changed.collect()}
    assert got.pop(("q", "/a/lost")) == (None, "", 1)
    assert {p: v for (_, p), v in got.items()} == WANT
    rows = {r.path: r for r in staging.queued(folders, changed, some, runs, now()).collect()}
    assert {p: r.state for p, r in rows.items()} == {"/a": "complete", "/a/dirt": "complete", "/a/mv": "queued", "/a/sc": "scanning", "/b": "complete", "/a/fresh": "queued"}
    lines = "\n".join(sorted(f"/a/{n}\t{k}\t{'' if s is None else s}\t{'' if m is None else int(m)}" for n, k, s, m in LISTED))
    r = rows["/a"]
    jitter = int(hashlib.md5(b"/a").hexdigest(), 16) % 86400
    assert (r.accepted, r.n_entries, r.member_hash, r.verified_at) == (2, 9, hashlib.sha256(lines.encode()).hexdigest(), dt.datetime(2024, 1, 1)) and r.due_at == dt.datetime(2024, 1, 2) + dt.timedelta(seconds=jitter)
    assert (rows["/a/fresh"].depth, rows["/a/fresh"].parent) == (2, "/a")


def test_whole_stale_commit_changes_nothing(spark, start):
    nodes, folders = start
    some = pages(spark, page("1", "/a", 1, 9, True, *LISTED))
    runs = staging.fenced(staging.verdicts(some), roots(spark, r=3))
    changed = staging.merged(nodes, some, runs, "T")
    assert changed.where("change IS NOT NULL").count() == 0 and changed.count() == len(NODES)
    assert {(r.path, r.state) for r in staging.queued(folders, changed, some, runs, now()).collect()} == {(r.path, r.state) for r in folders.collect()}


def test_baseline_target(spark):
    rows = spark.createDataFrame([("a", 2, 1), ("b", 3, None), ("c", 1, 0)], "root string, target int, completed int")
    done = spark.createDataFrame([("a", 2), ("a", 2), ("b", 2), ("x", 1)], "root string, generation int")
    assert {r.root: r.completed for r in staging.baseline_completed(rows, done).collect()} == {"a": 2, "b": None, "c": 0}


def state(tables):
    return sorted(((r.root, r.path, r.last_seen, r.tombstone) for r in tables.read("nodes").collect())), sorted((r.root, r.path, r.state) for r in tables.read("folders").collect()), sorted((r.run, r.page) for r in tables.read("stage").collect())


def test_versions(spark, start):
    nodes, folders = start
    tables = versions.catalog_tables(spark, shared_folder(spark, "versions"), buckets=4)
    tables.commit(tables.version(), {"nodes": nodes, "folders": folders}, {"nodes": nodes, "folders": folders})
    one = tables.version()
    half = pages(spark, page("1", "/a", 1, 9, False, *LISTED[:5]))
    rest = pages(spark, page("1", "/a", 2, 9, True, *LISTED[5:]))
    assert [r.verdict for r in versions.commit_pages(tables, half, roots(spark, r=2), "T", now()).collect()] == ["open"]
    assert state(tables)[0] == sorted((r[0], r[1], r[8], r[9] or "") if r[9] is not None else (r[0], r[1], r[8], r[9]) for r in NODES) and len(state(tables)[2]) == 5
    assert [r.verdict for r in versions.commit_pages(tables, rest, roots(spark, r=2), "T", now()).collect()] == ["accepted"]
    after = state(tables)
    assert {p: (t or "", s) for r, p, s, t in after[0] if r == "r"} == {p: (t, s) for p, (_, t, s) in WANT.items()} and not after[2]
    assert sum(p == q for p, q in zip(one["tables"]["nodes"].items(), tables.version()["tables"]["nodes"].items())) < 4
    # A late generation, a repeated path and a drift of totals leave both tables alone.
    bad = pages(spark, page("late", "/a", 1, 1, True, f("x"), generation=1), page("two", "/b", 1, 2, True, f("x"), f("x")), page("drift", "/b", 1, 1, False, f("x")), page("drift", "/b", 2, 2, True, f("y")))
    assert {r.run: r.verdict for r in versions.commit_pages(tables, bad, roots(spark, r=2), "T", now()).collect()} == {"late": "stale", "two": "repeated", "drift": "drift"}
    assert state(tables) == after
    # Two writers from one version: the later one is told.
    base = tables.version()
    tables.commit(base, {"nodes": nodes}, {"nodes": nodes.limit(0)})
    with pytest.raises(versions.Conflict):
        tables.commit(base, {"nodes": nodes}, {"nodes": nodes})
    assert state(tables) == after
    assert tables.read("nodes", one).count() == len(NODES)
    assert tables.vacuum(1) > 0 and state(tables) == after and tables.numbers() == [tables.version()["number"]]


def test_stream_of_pages(spark, start, tmp_path):
    """Pages in several micro-batches and over a restart give what one commit gives; a batch sent again changes nothing."""
    nodes, folders = start
    some = [page("1", "/a", 1, 9, False, *LISTED[:4]), page("1", "/a", 2, 9, True, *LISTED[4:]), page("2", "/b", 1, 0, True), page("old", "/b", 1, 1, True, f("n"), generation=1)]
    results = []
    for order in ([some], [[p] for p in reversed(some)]):
        at = tmp_path / f"in{len(results)}"
        tables = versions.catalog_tables(spark, shared_folder(spark, "versions"), buckets=3)
        tables.commit(tables.version(), {"nodes": nodes, "folders": folders}, {"nodes": nodes, "folders": folders})
        commit = versions.committing(tables, lambda: roots(spark, r=2), "pages", lambda: "T", now)
        for batch in order:
            pages(spark, *batch).coalesce(1).write.mode("append").parquet(str(at))
            stream = spark.readStream.schema(staging.PAGES).parquet(str(at))
            stream.writeStream.foreachBatch(commit).option("checkpointLocation", f"{at}-log").trigger(availableNow=True).start().awaitTermination(120)
        number = tables.version()["number"]
        assert number == 1 + len(order) and tables.version()["writers"] == {"pages": len(order) - 1}
        commit(pages(spark, page("3", "/b", 1, 1, True, f("x"))), 0)
        assert tables.version()["number"] == number
        results.append(state(tables))
    assert results[0] == results[1]
