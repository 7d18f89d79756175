"""The discovery loop over random trees against closures counted from scratch."""

import random

import pytest
from pyspark.sql import functions as F

from tallgrass.operators import discovery, relate


@pytest.fixture(autouse=True)
def checkpoints(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_close_the_tree(spark, seed):
    rng = random.Random(seed)
    folders = ["/r"]
    for i in range(40):
        folders.append(f"{rng.choice(folders)}/n{i}")
    kids = {f: [g for g in folders if g.rsplit("/", 1)[0] == f] for f in folders}
    candidate = {f: rng.random() < 0.3 for f in folders}
    when = {f: rng.randrange(5) for f in folders}  # folders may be scanned before those above them
    bad = {f for f in folders if rng.random() < 0.05}
    state, units = spark.createDataFrame([], discovery.STATE), {}
    for batch in range(5):
        rows = [(f, f.rsplit("/", 1)[0] or "/", f not in bad, kids[f], candidate[f]) for f in folders if when[f] == batch]
        state, left = discovery.advanced(state, spark.createDataFrame([*rows, *rows[:2], (None, None, True, [], False)], discovery.SCANS), batch)
        state = state.checkpoint()
        for r in left.collect():
            assert r.folder not in units and r.closed == batch
            units[r.folder] = batch
    below = {f: [g for g in folders if g == f or g.startswith(f + "/")] for f in folders}
    closed = {f: None if bad & set(below[f]) else max(when[g] for g in below[f]) for f in folders}
    assert {r.folder: r.closed for r in state.collect()} == closed
    owned = {f for f in folders if any(candidate[g] and f.startswith(g + "/") for g in folders)}
    late = {f for f in folders if f in owned and not any(candidate[g] and when[g] <= closed[f] for g in folders if closed[f] is not None and f.startswith(g + "/"))}
    assert {f: b for f, b in units.items() if f not in late} == {f: b for f, b in closed.items() if candidate[f] and b is not None and f not in owned}
    done = state.select("folder", "done")
    assert {r.folder: r.closed for r in relate.subtree_closed(done, "folder", F.col("done")).collect()} == {f: b is not None for f, b in closed.items()}


def test_rescans(spark):
    """A failed scan keeps everything above open; a new child opens it again; units leave once."""
    state, log = spark.createDataFrame([], discovery.STATE), []
    steps = [[("/r", "/", True, ["/r/a", "/r/b"], False), ("/r/a", "/r", True, [], True)], [("/r/b", "/r", False, ["/r/b/x"], True)], [("/r/b", "/r", True, [], True)], [("/r/a", "/r", True, ["/r/a/new"], True)], [("/r/a/new", "/r/a", True, [], False)]]
    for i, rows in enumerate(steps):
        state, units = discovery.advanced(state, spark.createDataFrame(rows, discovery.SCANS), i)
        state = state.checkpoint()
        log.append(([r.folder for r in units.collect()], sorted(r.folder for r in state.where("closed IS NOT NULL").collect())))
    assert log == [(["/r/a"], ["/r/a"]), ([], ["/r/a"]), (["/r/b"], ["/r", "/r/a", "/r/b"]), ([], ["/r/b"]), ([], ["/r", "/r/a", "/r/a/new", "/r/b"])]
    assert {r.folder: r.emitted for r in state.collect()} == {"/r": None, "/r/a": 0, "/r/a/new": None, "/r/b": 2}
