"""Nested merges against cases by hand; any order and split of the works gives one result."""

import random

import pytest
from pyspark.sql import functions as F

from tallgrass.operators import merge

WORK = f"""work_id string, source string, card_type string, media_type string, import_scope string, dir_path string, title string, rating double, last_played string, metadata_state string,
    source_locations map<string,{merge.PLACE}>, source_episode_counts map<string,int>, episodes array<{merge.EPISODE}>, seasons array<{merge.SEASON}>, at int, extra int"""


def episode(id, group, season, number, source, path=None):
    return (id, group, season, number, "video", "t", source, f"P/{id}" if path is None else path)


SERIES = [
    ("b", "baidu", "", "", "seasonal", "", "", 0.0, "2", "ready", None, {"baidu": 9, "local": -3}, [episode("e2", "season", 1, 1, "baidu"), episode("e3", "season", 1, 2, "baidu")], [("season", 1, "B", True, "77", "", 3)], 1, 1),
    ("a", "pan115", "", "", "seasonal", "", "A", 7.0, "1", None, {"local": ("x", "y")}, None, [episode("e9", "season", 1, 1, "pan115"), episode("e1", "special", 0, 0, None)], [("season", 1, "A", False, "77", "tv", 5), ("sps", 0, "x", None, None, None, 2)], 2, 1),
    ("c", "other", "", "tv", "seasonal", None, "C", 3.0, None, "waiting_review", {"baidu": ("e0", "Z")}, None, [episode("e8", "special", 0, 0, "other", ""), episode("e7", "season", 1, 3, "other", "")], [("season", 1, "C", True, "77", "", 3)], 3, 1),
]
FOLDERS = [
    ("d", "local", "", "", "", "", "D", None, "9", None, None, None, [episode("e1", "season", 1, 1, "local")], None, 4, 1),
    ("d", "local", "", "", "", "", "D2", None, None, None, None, None, [episode("e5", "season", 1, 1, "local"), episode("e5", "season", 1, 1, "local")], None, 5, 1),
    ("d", "local", "", "", "", "", "D3", None, "8", None, None, None, [], None, 6, 1),
    ("s2", "baidu", "main_series", "tv", "", "/M/Show/season 2", "S2", 1.0, None, "waiting_review", None, None, [], [("season", 2, "s", None, None, None, 0)], 7, 1),
    ("s1", "baidu", "main_series", "", "", "/m/show/SPs/", "S1", 5.0, None, "", None, None, [], None, 8, 1),
    ("s0", "local", "main_series", "", "", "/m/show/SPs/", "L", 5.0, None, "", None, None, [], None, 9, 1),
]


def merged(spark, rows, parts=3):
    works = spark.createDataFrame(rows, WORK).repartition(parts)
    return {r.work_id: r for r in merge.deduplicated(works, F.col("at")).collect()}


def test_series(spark):
    a = merged(spark, SERIES)["a"]
    assert (a.kind, a.source, a.title, a.rating, a.last_played, a.metadata_state) == ("seasonal", "pan115", "A", 7.0, "2", "ready")
    assert a.sources == ["pan115", "baidu", "other"]
    assert {s: tuple(p) for s, p in a.source_locations.items()} == {"pan115": ("e9", "P/e9"), "baidu": ("e0", "Z"), "local": ("x", "y")}
    assert a.source_episode_counts == {"pan115": 2, "baidu": 9, "local": 0, "other": 2}
    assert [e.episode_id for e in a.episodes] == ["e1", "e8", "e9", "e3", "e7"]
    assert [(s.group_type, s.title, s.episode_count) for s in a.seasons] == [("season", "B", 3), ("sps", "x", 2)]


def test_any_order(spark):
    whole = merged(spark, SERIES + FOLDERS)
    for seed in range(3):
        rows = [(*r[:-2], i, 1) if r in SERIES else r for i, r in enumerate(random.Random(seed).sample(SERIES + FOLDERS, 9))]
        assert merged(spark, rows, seed + 1) == whole


def test_folders(spark):
    got = merged(spark, FOLDERS)
    assert sorted(got) == ["d", "s0", "s2"]
    # The fuller one took over, its place in the play order comes from the one before; repeated episodes of a single work stay.
    assert (got["d"].title, got["d"].last_played, len(got["d"].episodes), got["d"].source_episode_counts) == ("D2", "9", 2, {"local": 2})
    assert (got["s2"].kind, got["s2"].title, got["s2"].rating, got["s2"].dir_path, got["s2"].metadata_state) == ("mirror-series", "S2", 1.0, "/M/Show/season 2", "waiting_review")


def test_without_and_replaced(spark):
    works = spark.createDataFrame(SERIES + FOLDERS[:3], WORK)
    rows = {(r.work_id, r.title): r for r in merge.without(works, "baidu").collect()}
    assert ("b", "") not in rows and rows["c", "C"].source_locations == {"baidu": ("e0", "Z")} and rows["d", "D"].extra == 1
    a = merge.without(works.where("work_id = 'a'"), "pan115").first()
    assert (a.source, a.sources, [e.episode_id for e in a.episodes], a.seasons) == ("local", ["local"], [], [])
    new = spark.createDataFrame([("b2", *SERIES[0][1:14], 1, 1)], WORK)
    (one,) = (r for r in merge.replaced_source(works, new, "baidu", "at").collect() if r.kind == "seasonal")
    assert one.work_id == "a" and one.source_episode_counts["baidu"] == 9 and [e.episode_id for e in one.episodes] == ["e1", "e8", "e9", "e3", "e7"]


@pytest.mark.parametrize("rows", [0, 1])
def test_empty(spark, rows):
    """A table that has none of the columns holds one empty work."""
    assert merge.deduplicated(spark.range(rows).withColumnRenamed("id", "at"), F.col("at")).count() == rows


def test_works_are_made_once(spark):
    """All that is told of a work comes from the rows that `cut` gets: keys, parts and nested rows."""
    cuts = []

    def cut(rows):
        cuts.append(rows.columns)
        return spark.createDataFrame(rows.collect(), rows.schema)

    works = spark.range(6).selectExpr("id AS at", "concat('w', id % 4) AS work_id", "'baidu' AS source", "'seasonal' AS import_scope", "concat('p', id) AS plot")
    got, plain = (merge.deduplicated(works, F.col("at"), c).orderBy("work_id") for c in (cut, None))
    assert got.collect() == plain.collect() and len(cuts) == 1 and {"key", "parts"} <= set(cuts[0])
    assert "Range" not in got._jdf.queryExecution().optimizedPlan().toString()
