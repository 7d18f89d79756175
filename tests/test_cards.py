"""Cards: artwork by reference, season and folder, counts, locations and exception ids, over odd rows."""

import pytest

from tallgrass.operators import cards

SEASON = "struct<poster_path:string,fanart_path:string,clearlogo_path:string>"
EPISODE = "struct<source:string,episode_id:string,strm_path:string,group_type:string,episode_number:int>"
WORKS = f"work_id int, source string, sources array<string>, dir_path string, poster_path string, fanart_path string, clearlogo_path string, source_locations map<string,struct<episode_id:string,strm_path:string>>, seasons array<{SEASON}>, episodes array<{EPISODE}>, kind string, place int"


def _work(spark, *rows):
    return spark.createDataFrame(list(rows), WORKS)


def _row(key, folder="", poster="", seasons=None, episodes=None, locations=None, source="local", sources=None):
    return (key, source, sources, folder, poster, None, None, locations, seasons, episodes, "clash", 1)


def _files(spark, *paths):
    return spark.createDataFrame([(p,) for p in paths], "path string")


@pytest.mark.parametrize(
    "work, files, poster, local",
    [
        (_row(1, "/w", "https://a/p"), ["/w/poster.png"], "https://a/p", "/w/poster.png"),
        (_row(1, "/w", "/own.jpg"), ["/own.jpg", "/own.jpg", None, "/w/poster.jpg"], "/own.jpg", "/own.jpg"),
        (_row(1, "/w", "/own.jpg"), ["/w/poster.webp"], "/own.jpg", "/w/poster.webp"),
        (_row(1, "/w", "", [("", None, None), None, ("/s1", None, None), ("/s2", None, None)]), ["/s2"], "/s1", "/s2"),
        (_row(1, "/w", None, [("HTTPS://s", None, None)]), [], "HTTPS://s", ""),
        (_row(1, "/w//"), ["/w/poster.webp", "/w/poster.png"], "/w/poster.png", "/w/poster.png"),
        (_row(1, "/w/SEASON 2/"), ["/w/poster.jpg", "/w/SEASON 2/poster.webp"], "/w/SEASON 2/poster.webp", "/w/SEASON 2/poster.webp"),
        (_row(1, "/w/s01"), ["/w/poster.jpg"], "/w/poster.jpg", "/w/poster.jpg"),
        (_row(1, "/w/show"), ["/w/poster.jpg"], "", ""),
        (_row(1, "Season 1"), ["poster.jpg"], "poster.jpg", "poster.jpg"),
        (_row(1, "/sps"), ["/poster.jpg"], "/poster.jpg", "/poster.jpg"),
        (_row(1, "/"), ["/poster.jpg"], "/poster.jpg", "/poster.jpg"),
        (_row(1, None), ["poster.jpg"], "", ""),
        (_row(1, "/w"), ["/w/POSTER.jpg", "/w/x/poster.jpg"], "", ""),
    ],
)
def test_posters(spark, work, files, poster, local):
    got = cards.with_artwork(_work(spark, work), _files(spark, *files)).collect()
    assert [(r.poster_path, r.local_poster_path, r.kind, r.place) for r in got] == [(poster, local, "clash", 1)]


def test_other_artwork_and_empty_tables(spark):
    works = _work(spark, _row(1, "/w"), _row(2, "/v"))
    got = {r.work_id: r for r in cards.with_artwork(works, _files(spark, "/w/backdrop.jpg", "/w/fanart.webp", "/w/logo.png", "/w/clearlogo.webp")).collect()}
    assert (got[1].fanart_path, got[1].local_clearlogo_path, got[1].poster_path) == ("/w/fanart.webp", "/w/clearlogo.webp", "")
    assert (got[2].fanart_path, got[2].local_fanart_path) == ("", "")
    assert cards.summaries(works.limit(0), _files(spark, "/w/poster.jpg")).count() == 0
    assert cards.summaries(works, _files(spark, "/w").limit(0)).count() == 2


def test_paths_are_rewritten_in_columns(spark, capsys):
    """Patterns inside lambdas run uncompiled, again for each mention of the path."""
    cards.with_artwork(_work(spark, _row(1, "/w//")), _files(spark, "/w/poster.jpg")).explain()
    lambdas = [line for line in capsys.readouterr().out.splitlines() if "lambdafunction" in line]
    assert lambdas and not any("regexp" in line or "RLIKE" in line for line in lambdas)


@pytest.mark.parametrize("path, poster", [("/w\n", "/w\n/poster.jpg"), ("//w//\n", "/w\n/poster.jpg"), ("/\n", "\n/poster.jpg")])
def test_line_ends_in_folders(spark, path, poster):
    works, files = _work(spark, _row(1, path)), _files(spark, "/w\n/poster.jpg", "/w/poster.jpg", "\n/poster.jpg")
    assert cards.with_artwork(works, files).first().poster_path == poster


def test_counts_sources_and_locations(spark):
    episodes = [("local", "e2", "/B", "season", 7), ("local", "e2", "/a", "season", None), ("", "e1", "/x", "op_ed", 99), ("zoo", "e9", "/z", "special", 3), ("baidu", None, "/y", "season", 2), None]
    works = _work(
        spark,
        _row(1, episodes=episodes, locations={"openlist": ("e5", "/o"), "local": ("e3", "/c"), "pan115": ("", "/p")}, sources=["local", "zoo"]),
        _row(2, episodes=None, locations=None, sources=[]),
        _row(3, episodes=[(None, None, None, None, None)], locations={"local": None}),
    )
    got = {r.work_id: r for r in cards.summaries(works, _files(spark)).collect()}
    assert (got[1].episode_count, got[1].main_episode_count, got[1].latest_episode_number) == (5, 3, 7)
    assert got[1].sources == ["local", "zoo"] and got[2].sources == ["local"] and got[3].sources == ["local"]
    assert got[1].source_episode_ids == {"openlist": "e5", "local": "e3"} and got[2].source_episode_ids == {} and got[3].source_episode_ids == {}
    assert (got[2].episode_count, got[2].latest_episode_number, got[3].main_episode_count) == (0, 0, 0)
    assert "episodes" not in got[1].asDict()
    where = sorted((r.work_id, r.place, r.source, r.episode_id, r.strm_path) for r in cards.best_locations(works).collect())
    assert where == [(1, 0, "local", "e2", "/a"), (1, 1, "openlist", "e5", "/o"), (1, 2, "zoo", "e9", "/z")]
    sources = {r.work_id: r.sources for r in cards.all_sources(works).collect()}
    assert sources == {1: ["pan115", "baidu", "local", "openlist", "zoo"], 2: ["local"], 3: ["local"]}


def test_exceptions(spark):
    bindings = spark.createDataFrame([("b1", "waiting_review", 0), ("b2", None, 2), ("b3", "none", None), ("b4", "source_unavailable", None), (None, "waiting_review", 1), ("", "waiting_review", 1)], "work_id string, attention_state string, failed int")
    reviews = spark.createDataFrame([("p", "t1", "pending"), ("p", "t1", "pending"), ("p", "t2", "done"), (None, "t1", "pending"), ("p", "gone", "pending")], "plan_id string, target_id string, status string")
    failures = spark.createDataFrame([("p", "t3", "old3"), ("q", "t1", "lost"), ("p", None, "keyless"), ("q", "t9", None)], "plan_id string, target_id string, work_id string")
    targets = spark.createDataFrame([("p", "t1", 1), ("p", "t1", 2), ("p", "t1", 5), ("p", "t2", 3), ("p", "t3", 4)], "plan_id string, target_id string, item_id int")
    shown = spark.createDataFrame([("p", 1, "w1"), ("p", 2, "w2"), ("p", 3, "w3"), ("p", 4, "w4"), ("q", 5, "w5")], "plan_id string, item_id int, work_id string")
    got = sorted(r.work_id for r in cards.exception_ids(bindings, reviews, failures, targets, shown).collect())
    assert got == ["b1", "b2", "b4", "keyless", "lost", "w1", "w2", "w4"]
