"""Previews and targets over odd rows: nulls, empty plans, films beside specials, warnings of one kind, years in names."""

import re

from tallgrass.operators import preview

COLUMNS = "plan string, item_id int, position int, resource_type string, action string, group_type string, season_number int, episode_number int, special_number int, work_id string, canonical_work_id string, work_title string, original_title string, series_group string, card_type string, media_type string, show_type string, relative_path string, year int, confidence string, user_override_id string, needs_review boolean, warnings array<string>, source string, card string, local_title string, subwork string, file_year int, own_year int, _same int, twice int"
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]
BASE = dict.fromkeys(NAMES) | {"plan": "p", "resource_type": "video", "action": "generate_strm", "group_type": "season", "season_number": 1, "episode_number": 1, "work_id": "w", "work_title": "T", "card_type": "main_series", "local_title": "T", "card": "c", "source": "s", "own_year": 2001}


def _items(spark, *changes):
    rows = [BASE | {"item_id": i, "position": i} | c for i, c in enumerate(changes)]
    return spark.createDataFrame([tuple(r[n] for n in NAMES) for r in rows], COLUMNS)


def _marked(items, flag):
    return sorted(r.item_id for r in preview.flagged(items).where(flag).collect())


def test_duplicates_by_work_edition_and_number(spark):
    items = _items(
        spark,
        {"work_title": " the  Show "},
        {"work_title": "THE show"},
        {"work_title": "The Show", "year": 1999},  # another version
        {"work_title": "The Show", "year": 0},
        {"work_title": "The Show", "relative_path": "x/REMAKE/1"},
        {"work_title": "The Show", "episode_number": None},
        {"work_title": "The Show", "group_type": "special"},
        {"work_title": "The Show", "action": "ignore"},
        {"work_title": "The Show", "plan": "q"},
        {"work_title": "", "series_group": "The Show", "work_id": "z"},  # the series stands in
        {"canonical_work_id": "K", "work_title": "a"},
        {"canonical_work_id": "K", "work_title": "b"},
        {"work_title": None, "series_group": None, "work_id": "v", "season_number": 2},
        {"work_title": None, "series_group": " ", "work_id": "v", "season_number": 2},
    )
    assert _marked(items, "duplicate_episode") == [0, 1, 3, 9, 10, 11, 12, 13]
    assert _marked(items, "needs_review") == [0, 1, 3, 9, 10, 11, 12, 13]
    rows = preview.issues(preview.flagged(items)).where("code = 'duplicate_episode'").collect()
    assert {r.level for r in rows} == {"error"} and len({(r.plan, r.episode_of, r.season_number, r.episode_number) for r in rows}) == 3


def test_reviews_and_other_issues(spark):
    mark = f"A {preview.DUPLICATE_MARK} B"
    apart = lambda i: {"episode_number": 100 + i}
    items = _items(
        spark,
        apart(0) | {"needs_review": True},
        apart(1) | {"needs_review": True, "warnings": [mark]},
        apart(2) | {"needs_review": True, "warnings": [mark, "other"]},
        apart(3) | {"needs_review": True, "warnings": [None]},
        apart(4) | {"needs_review": None, "warnings": ["other"]},
        apart(5) | {"needs_review": True, "resource_type": None},
        apart(6) | {"confidence": "low"},
        apart(7) | {"confidence": "low", "user_override_id": "u"},
        {"group_type": None, "work_title": ""},
        {"season_number": None},
    )
    assert _marked(items, "needs_review") == [0, 2, 3]
    got = sorted((r.code, r.item_id) for r in preview.issues(preview.flagged(items)).collect())
    assert got == [("low_confidence", 6), ("missing_group_type", 8), ("missing_work_title", 8), ("needs_review", 0), ("needs_review", 2), ("needs_review", 3), ("season_incomplete", 9), ("ungrouped_video", 8)]
    one = preview.counts(preview.flagged(items)).collect()[0]
    assert (one.total_items, one.video_count, one.needs_review_count, one.said_review_count, one.low_confidence_count, one.work_count) == (10, 9, 3, 5, 1, 1)


def test_works_groups_and_kinds(spark):
    items = _items(
        spark,
        {"position": 5, "work_title": "late"},
        {"position": 1, "work_title": None, "year": 2000},
        {"season_number": None},
        {"group_type": "op_ed", "work_id": "gone"},
        {"work_id": None, "series_group": "S", "card_type": None},
        {"work_id": "", "series_group": "S", "card_type": ""},
        {"work_id": "", "work_title": "S", "card_type": "", "year": 1},
        {"resource_type": None, "action": None},
    )
    assert preview.counts(preview.flagged(items)).collect()[0].work_count == 3
    groups = {(r.work_id, r.card_type, r.group_type, r.season_number): r for r in preview.groups(items).collect()}
    assert len(groups) == 5
    first = groups["w", "main_series", "season", 1]
    assert (first.item_count, first.work_title, first.year) == (2, None, 2000)
    kinds = preview.kinds(items).collect()[0]
    assert kinds.by_resource_type == {"video": 7, "": 1} and kinds.by_action == {"generate_strm": 7, "": 1}
    assert preview.counts(preview.flagged(items.limit(0))).count() == preview.groups(items.limit(0)).count() == preview.kinds(items.limit(0)).count() == 0


def test_targets(spark):
    items = _items(
        spark,
        {"file_year": 2015, "subwork": "x"},
        {"file_year": 2012, "episode_number": 1, "subwork": ""},
        {"episode_number": None, "special_number": 3},
        {"episode_number": None},
        {"group_type": "special", "season_number": None, "own_year": None, "subwork": "x"},
        {"group_type": "special", "season_number": 0, "subwork": "y"},
        {"group_type": "movie", "season_number": 4, "card": "f"},
        {"group_type": "movie", "season_number": None, "card": "f", "needs_review": True},
        {"group_type": "special", "media_type": "movie", "card": "f", "season_number": 9},  # its card has a film
        {"group_type": "special", "media_type": "movie", "card": "g", "season_number": 9},
        {"group_type": "special", "media_type": "tv", "card": "f", "season_number": 8},
        {"group_type": "op_ed"},
        {"canonical_work_id": "K"},
        {"card": None},
    )
    got = {(r.group_type, r.season_number, r.card, r.canonical_work_id): r for r in preview.targets(items).collect()}
    assert set(got) == {("season", 1, "c", ""), ("special", 0, "c", ""), ("movie", None, "f", ""), ("special", 9, "g", ""), ("special", 8, "f", ""), ("season", 1, "c", "K"), ("season", 1, "", "")}
    main = got["season", 1, "c", ""]
    assert (main.item_count, main.episode_count, main.scrape_year, main.subwork, main.needs_review, main.group_place, main.season_place) == (4, 2, 2012, "x", False, 0, 1)
    special = got["special", 0, "c", ""]
    assert (special.item_count, special.episode_count, special.scrape_year, special.subwork, special.needs_review, special.season_place) == (2, 1, None, "", True, 999)
    film = got["movie", None, "f", ""]
    assert (film.scrape_type, film.item_count, film.needs_review, film.scrape_year) == ("movie", 2, True, 2001)
    assert len({r.target_id for r in got.values()}) == 7 and all(len(r.target_id) == 16 for r in got.values())
    assert preview.targets(items.limit(0)).count() == 0


def test_subwork_and_years(spark):
    names = ["Show.2014.1080p", "Show (2013) 2015", "Show 1899 2001 x", "a.2150.2003-b", "（1999）", "2020", "S01E01.1080", "x_2001_y", "", None]
    rows = [(i, f"d.1950/{a}" if a is not None else None, b, None, 1987 if i % 2 else None, "movie" if i % 3 else "season", "Film.2005" if i % 4 == 0 else None) for i, (a, b) in enumerate((a, b) for a in names for b in names)]
    got = spark.createDataFrame(rows, "id int, relative_path string, title string, original_title string, year int, group_type string, subwork string").withColumns({"f": preview.file_year(), "o": preview.own_year()}).collect()

    def in_range(years):
        return next((y for y in map(int, years) if 1900 <= y <= 2099), None)

    for r in got:
        texts = [(r.relative_path or "").split("/")[-1], r.title]
        assert r.f == next((y for t in texts if t for p in preview.FILE_YEARS if (y := in_range(re.findall(p, t))) is not None), None), r
        texts = ([r.subwork, r.title, r.relative_path] if r.group_type == "movie" else []) + [r.year, r.subwork]
        assert r.o == next((y for t in texts if t for p in preview.TEXT_YEARS if (m := re.search(p, str(t))) and (y := in_range([m[1]])) is not None), None), r
    mark = preview.SUBWORK_MARK
    said = spark.createDataFrame([(["a", None, f"{mark} x "], [f"{mark}y"]), (None, [f"{mark}y"]), (["a"], None), (None, None)], "reasons array<string>, warnings array<string>")
    assert [r[0] for r in said.select(preview.subwork()).collect()] == ["x", "y", "", ""]
