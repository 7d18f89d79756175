"""Orders of shelves, and showcases of sessions: whole, distinct, the same at every run, and even."""

from collections import Counter

import pytest

from tallgrass.operators import shelves

WORKS = "work_id int, title string, category string, poster string, rating double, year int"


def _ids(rows):
    return [r.work_id for r in sorted(rows, key=lambda r: r.place)]


@pytest.fixture(scope="module")
def works(spark):
    rows = [
        (1, "张", "c", "p", 2.0, None),
        (2, "阿", "c", "p", None, 2001),
        (3, "b", "c", "p", 2.0, 1999),
        (4, "B", "c", "p", 5.0, 2001),
        (5, None, "c", "p", 5.0, None),
        (6, "1x", "c", "p", -1.0, 2005),
        (7, "no poster", "c", " ", 9.0, 2020),
        (8, "b", "c", "p", 2.0, 1999),
        (9, "other", None, "p", None, None),
    ]
    return spark.createDataFrame(rows, WORKS)


@pytest.mark.parametrize(
    "order, want",
    [
        ("title", [5, 6, 2, 1, 3, 8, 4]),
        ("titleDesc", [4, 3, 8, 1, 2, 6, 5]),
        ("ratingDesc", [5, 4, 1, 3, 8, 2, 6]),
        ("ratingAsc", [6, 2, 1, 3, 8, 5, 4]),
        ("yearDesc", [6, 2, 4, 3, 8, 5, 1]),
        ("yearAsc", [3, 8, 2, 4, 6, 5, 1]),
        ("recent", [4, 1, 5, 6, 2, 3, 8]),
    ],
)
def test_orders(spark, works, order, want):
    recent = spark.createDataFrame([(4, 0), (1, 3), (7, 1)], "work_id int, recent_rank int")
    got = shelves.shelf(works, "category", order, 20, recent)
    assert _ids(got.where("category = 'c'").collect()) == want
    assert _ids(got.where("category IS NULL").collect()) == [9]
    assert _ids(shelves.shelf(works.where("category = 'c'"), "category", order, 3, recent).collect()) == want[:3]
    assert shelves.shelf(works, "category", order, 0, recent).count() == 0


def test_shelf_cuts_before_the_shuffle_and_names_its_orders(works):
    plan = shelves.shelf(works, "category", "title", 3)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan
    with pytest.raises(ValueError):
        shelves.order_of("other")
    with pytest.raises(ValueError):
        shelves.shelf(works, "category", "recent", 3)


def test_showcase_is_whole_distinct_and_stable(spark):
    w = spark.createDataFrame([("a", i) for i in range(40)] + [("a", 1), ("b", 1), ("b", 2), (None, 3), ("a", None)], "pool string, work_id int")
    s = spark.createDataFrame([("x", "a"), ("x", "a"), ("y", "a"), ("x", "b"), ("z", "none"), (None, "a"), ("q", None)], "session string, pool string")
    got = [tuple(r) for r in shelves.session_showcase(s, w, 8).collect()]
    again = [tuple(r) for r in shelves.session_showcase(s.repartition(3), w.repartition(7).orderBy("work_id"), 8).collect()]
    assert sorted(got) == sorted(again)
    sizes = Counter((session, pool) for session, pool, _, _ in got)
    assert sizes == {("x", "a"): 8, ("y", "a"): 8, ("x", "b"): 2}
    for key in sizes:
        mine = [r for r in got if (r[0], r[1]) == key]
        assert len({r[3] for r in mine}) == len(mine) and sorted(r[2] for r in mine) == list(range(len(mine)))
    one = lambda rows, key: [r[3] for r in sorted(rows, key=lambda r: r[2]) if (r[0], r[1]) == key]
    assert one(got, ("x", "a")) != one(got, ("y", "a"))
    other = [tuple(r) for r in shelves.session_showcase(s, w, 8, seed="another").collect()]
    assert one(got, ("x", "a")) != one(other, ("x", "a"))
    grown = shelves.session_showcase(s, w.union(spark.createDataFrame([("b", 3)], w.schema)), 8).collect()
    assert one([tuple(r) for r in grown], ("x", "a")) == one(got, ("x", "a")) and len([r for r in grown if r.pool == "b"]) == 3
    assert shelves.session_showcase(s, w, 0).count() == 0
    assert shelves.session_showcase(s, w.limit(0), 8).count() == 0
    assert shelves.session_showcase(s.limit(0), w, 8).count() == 0


def test_showcase_is_even(spark):
    sessions = spark.range(6000).selectExpr("id AS session", "'a' AS pool")
    works = spark.range(10).selectExpr("'a' AS pool", "id AS work_id")
    got = shelves.session_showcase(sessions, works, 3).groupBy("slot", "work_id").count().collect()
    assert len(got) == 30
    spread = (6000 * 0.1 * 0.9) ** 0.5
    assert all(abs(r["count"] - 600) < 5 * spread for r in got)
