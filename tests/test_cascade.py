"""Cascades over small tables: cycles, last references, nulls, moves."""

import pytest
from pyspark.sql import functions as F

from tallgrass.operators import cascade
from tallgrass.operators.cascade import Link

KEYS = {"roots": "root", "units": "unit", "jobs": "job", "links": "id", "batches": "batch"}
LINKS = [Link("units", "root", "roots"), Link("jobs", "unit", "units"), Link("jobs", "parent", "jobs"), Link("links", "root", "roots"), Link("links", "batch", "batches", "last"), Link("units", "latest", "jobs", "null")]


@pytest.fixture
def tables(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    rows = lambda data, schema: spark.createDataFrame(data, schema)
    return {
        "roots": rows([("r1",), ("r2",), ("r3",)], "root string"), "units": rows([("u1", "r1", None), ("u2", "r2", "j9"), ("u3", None, "j1"), ("u4", "r3", "j7"), (None, "r1", None)], "unit string, root string, latest string"),
        # j1 -> j2 -> j3 -> j1 is a cycle; j7 hangs on j3 though its unit stays.
        "jobs": rows([("j1", "u1", "j3"), ("j2", None, "j1"), ("j3", None, "j2"), ("j7", "u4", "j3"), ("j9", "u2", None), ("j9", "u2", None)], "job string, unit string, parent string"),
        "links": rows([(1, "r1", "b1"), (2, "r1", "b2"), (3, "r2", "b2")], "id int, root string, batch string"), "batches": rows([("b1",), ("b2",), ("b3",)], "batch string"),
    }


def values(kept, column):
    return sorted(str(r[0]) for r in kept.select(column).collect())


def test_deletes(spark, tables):
    doomed = spark.createDataFrame([("r1",), ("r1",), (None,), ("missing",)], "x string")
    kept, gone = cascade.deleted(tables, KEYS, LINKS, {"roots": doomed})
    assert {t: values(g, "key") for t, g in gone.items()} == {"roots": ["r1"], "units": ["u1"], "jobs": ["j1", "j2", "j3", "j7"], "links": ["1", "2"], "batches": ["b1", "b3"]}
    assert values(kept["roots"], "root") == ["r2", "r3"] and values(kept["jobs"], "job") == ["j9", "j9"] and values(kept["batches"], "batch") == ["b2"]
    assert {r.unit: (r.root, r.latest) for r in kept["units"].collect()} == {"u2": ("r2", "j9"), "u3": (None, None), "u4": ("r3", None), None: ("r1", None)}
    tally = {r.name: (r.deleted, r.left) for r in cascade.tallied(kept, gone).collect()}
    assert tally == {"roots": (1, 2), "units": (1, 4), "jobs": (4, 2), "links": (2, 1), "batches": (2, 1)}
    for link in LINKS:  # no orphan in any table
        if link.rule != "last":
            refers = kept[link.child].where(F.col(link.column).isNotNull() & F.col(KEYS[link.child]).isNotNull())
            assert refers.join(kept[link.parent].select(F.col(KEYS[link.parent]).alias(link.column)), link.column, "left_anti").count() == 0


def test_nothing_doomed(spark, tables):
    kept, gone = cascade.deleted(tables, KEYS, [x for x in LINKS if x.rule != "last"], {"roots": spark.createDataFrame([], "x string")})
    assert all(g.count() == 0 for g in gone.values()) and all(kept[t].count() == tables[t].count() for t in tables)


def test_promotion(spark, tables):
    mapping = spark.createDataFrame([("r1", "r3"), ("r2", "r3")], "old string, new string")
    kept, gone = cascade.promoted(tables, KEYS, LINKS, "roots", mapping, ["units"])
    assert values(kept["roots"], "root") == ["r3"] and kept["jobs"].count() == 6 and kept["links"].count() == 0 and kept["batches"].count() == 0
    assert {r.unit: r.root for r in kept["units"].collect()} == {"u1": "r3", "u2": "r3", "u3": None, "u4": "r3", None: "r3"} and gone["units"].count() == 0
    with pytest.raises(ValueError, match="open jobs"):
        cascade.promoted(tables, KEYS, LINKS, "roots", mapping, ["units"], spark.createDataFrame([("r2",)], "x string"))


def test_convergence(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "old"), (2, "b"), (None, "c")], "revision int, library string")
    want = spark.createDataFrame([(1, "a"), (2, "b"), (1, "a")], "revision int, library string")
    assert [tuple(r) for r in cascade.converged(rows, spark.createDataFrame([(1,)], "revision int"), want).collect()] == [(1, "a")]
