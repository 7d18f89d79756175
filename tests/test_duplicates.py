"""Files of one episode, variants and titles of split works, over odd rows."""

from tallgrass.operators import duplicates
from tallgrass.operators.preview import DUPLICATE_MARK

COLUMNS = "plan string, item_id int, position int, card string, resource_type string, action string, group_type string, season_number int, episode_number int, special_number int, needs_review boolean, title string, warnings array<string>, is_extra boolean, work_title string, original_title string, series_group string, real_path string, relative_path string, _best int"
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]
BASE = dict.fromkeys(NAMES) | {"plan": "p", "card": "c", "resource_type": "video", "action": "generate_strm", "group_type": "season", "season_number": 1, "episode_number": 1, "special_number": 5, "needs_review": True}


def _items(spark, *changes):
    rows = [BASE | {"item_id": i, "position": i} | c for i, c in enumerate(changes)]
    return spark.createDataFrame([tuple(r[n] for n in NAMES) for r in rows], COLUMNS)


def _kept(spark, *changes):
    return [r.item_id for r in duplicates.resolved(_items(spark, *changes)).where("action = 'generate_strm'").orderBy("item_id").collect()]


def test_order_of_scores(spark):
    at = lambda path, **more: {"relative_path": path} | more
    assert _kept(spark, at("a/1080p.mkv", is_extra=True), at("a/x.mkv")) == [1]
    assert _kept(spark, at("a/720P x265.mkv"), at("a/x 1080p.mkv"), at("2160p/720p.mkv")) == [2]
    assert _kept(spark, at("480p/2160p.mkv"), at("a/720p.mkv")) == [1]  # the first size in the path counts
    assert _kept(spark, at("a/x.FLAC"), at("a/H265.mkv"), at("a/hevc flac.mkv")) == [2]
    assert _kept(spark, at("a/My Show 1.mkv", original_title="my show"), at("a/the SHOW 1.mkv", work_title="The  Show"), at("a/s.mkv")) == [1]
    assert _kept(spark, at("the show/1.mkv", work_title="The Show"), at("a/1.mkv")) == [1]  # only the name may hold the title
    assert _kept(spark, at("a/1.mkv"), at("b/1.mkv"), at("a/long 1.mkv")) == [1]
    assert _kept(spark, at("a/1.mkv", position=9), at("a/1.mkv", position=2), at(None)) == [2]  # an empty path is the shortest
    assert _kept(spark, at("a/1.mkv", position=9), at("a/1.mkv", position=2)) == [1]
    assert _kept(spark, at("a/1.mkv", position=2), at("a/1.mkv", position=2)) in ([0], [1])


def test_what_changes(spark):
    kept, skipped = f"{DUPLICATE_MARK}（2 个），已自动保留此版本", f"{DUPLICATE_MARK}（2 个），已自动跳过重复版本"
    items = _items(
        spark,
        {"relative_path": "a/1080p", "warnings": [kept]},
        {"relative_path": "a/480p", "warnings": ["w"], "title": ""},
        {"relative_path": "b", "card": None, "season_number": 10, "episode_number": 123, "title": "T"},
        {"relative_path": "bb", "card": "", "season_number": 10, "episode_number": 123, "title": "T"},
        {"plan": "q"},
        {"episode_number": None},
        {"group_type": "special"},
        {"action": "ignore"},
        {"resource_type": None, "group_type": None},
    )
    done = duplicates.resolved(items)
    assert done.columns == items.columns
    got = {r.item_id: r for r in done.collect()}
    before = {r.item_id: r for r in items.collect()}
    assert len(got) == 9 and all(got[i] == before[i] for i in (0, 4, 5, 6, 7, 8))
    gone = got[1]
    assert (gone.action, gone.group_type, gone.season_number, gone.episode_number, gone.special_number, gone.needs_review) == ("ignore", "ignored", None, None, None, False)
    assert gone.title == "S01E01 重复版本" and gone.warnings == ["w", skipped]
    assert got[2].action == "generate_strm" and got[2].warnings == [kept] and got[3].title == "T" and got[3].warnings == [skipped]
    assert duplicates.resolved(items.limit(0)).count() == 0


def test_variants(spark):
    items = _items(
        spark,
        {"work_title": "Show (2)", "real_path": "/a"},
        {"work_title": "Show", "real_path": "/Z//b"},
        {"work_title": "", "series_group": "Show", "real_path": "/z/a"},
        {"work_title": "Show（3） ", "real_path": None},
        {"plan": "q", "work_title": "(1)", "real_path": "/x"},
        {"plan": "q", "work_title": "(1)", "real_path": "/x"},
    )
    got = {r.plan: (r.item_id, r.variants) for r in duplicates.shown_variants(items, ["plan", "season_number", "episode_number"]).collect()}
    assert got == {"p": (2, 4), "q": (4, 2)}


def test_split_titles(spark):
    schema = "work_id int, title string, source string, card_type string, media_type string, seasons array<struct<group_type:string,label:string,season_number:int>>, _cards int"
    main = lambda n, label=None: ("season", label, n)
    rows = [
        ("A b", [main(2)], "A b 第2季"),
        ("a  B", [("sps", None, 0), None], "a  B 特别篇"),
        ("AB", [main(1), main(2)], "AB"),
        ("ab", None, "ab"),
        ("ab", [main(3, "Final"), ("special", None, 0)], "ab Final"),
        ("Alone", [main(1)], "Alone"),
        ("C S02", [main(2)], "C S02"),
        ("CS02", [main(1)], "CS02 第1季"),
        ("D Season 1", [main(1)], "D Season 1"),
        ("d season 1", [main(10)], "d season 1 第10季"),
        ("E final", [main(1, "FINAL")], "E final"),
        ("e FINAL", [main(None)], "e FINAL"),
        ("", [main(1)], ""),
        (None, [main(1)], None),
        (None, None, None),
    ]
    works = spark.createDataFrame([(i, t, "local", "main_series", "tv", s, 7) for i, (t, s, _) in enumerate(rows)] + [(90, "ab", "baidu", "main_series", "tv", [main(1)], 7), (91, "ab", "local", "standalone", "tv", [main(1)], 7), (92, "ab", "local", "main_series", None, [main(1)], 7)], schema)
    done = duplicates.split_titles(works)
    got = {r.work_id: r.title for r in done.collect()}
    assert done.columns == works.columns and len(got) == len(rows) + 3
    assert [got[i] for i in range(len(rows))] == [want for _, _, want in rows]
    assert got[90] == got[91] == got[92] == "ab"
    assert duplicates.split_titles(works.limit(0)).count() == 0
