"""Columns against cases worked out by hand, nulls and odd values among them."""

import pytest
from pyspark.sql import functions as F

from tallgrass.functions import media, paths, resource, score, text


def values(spark, column, rows):
    """The column's value for each row of columns a, b, c ..."""
    names = [chr(97 + i) for i in range(len(rows[0]))]
    ddl = []
    for i, n in enumerate(names):
        some = next((r[i] for r in rows if r[i] is not None), "")
        ddl.append(f"{n} {'boolean' if isinstance(some, bool) else 'double' if isinstance(some, float) else 'bigint' if isinstance(some, int) else 'array<string>' if isinstance(some, list) else 'string'}")
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n int, " + ", ".join(ddl))
    return [r.v for r in df.select("n", column.alias("v")).orderBy("n").collect()]


def test_paths(spark):
    rows = [("/a/b/c.tar.gz", "/a"), ("/a", "/a"), ("/ab", "/a"), ("", "/"), (None, "/a"), (".hidden", None)]
    assert values(spark, paths.basename("a"), rows) == ["c.tar.gz", "a", "ab", "", None, ".hidden"]
    assert values(spark, paths.stem(paths.basename("a")), rows) == ["c.tar", "a", "ab", "", None, ".hidden"]
    assert values(spark, paths.extension(paths.basename("a")), rows) == [".gz", "", "", "", None, ""]
    assert values(spark, paths.is_within("a", F.col("b")), rows) == [True, True, False, True, None, None]
    assert values(spark, paths.parent("a"), rows) == ["/a/b", "/", "/", "/", None, "/"]
    assert values(spark, paths.common_ancestor("a", "b"), [("/a/b/c", "/a/b/d"), ("/a", "/b"), ("/a/b", "/a/b"), ("/", "/a"), (None, "/a")]) == ["/a/b", "/", "/a/b", "/", None]


def test_locators(spark):
    assert values(spark, paths.locator("a"), [(" K:\\Media\\X\\ ",), ("/a/b/",), ("/",), ("",), (None,)]) == ["k:/media/x", "/a/b", "/", "", ""]
    assert values(spark, paths.remote_path("a"), [("a//b/./c/",), ("/a/../b",), ("",), (None,)]) == ["/a/b/c", None, "/", "/"]
    assert values(spark, paths.rebased("a", F.lit("K:\\M"), F.lit("/r/")), [("k:/m/x/y",), ("K:\\M",), ("K:\\Mx\\y",), (None,)]) == ["/r/x/y", None, None, None]
    assert values(spark, paths.normal_extension("a"), [(" .MKV ",), ("mp4",), ("",), (None,)]) == [".mkv", ".mp4", "", ""]


def test_resources(spark):
    rows = [("a.MKV", "", ""), ("a.mkv", ".srt", ""), ("a", "", "Video "), ("a.xyz", "", "subtitle"), (".nfo", "", ""), (None, None, None), ("a.ts", None, "text")]
    assert values(spark, resource.kind("a", "b", "c"), rows) == ["video", "subtitle", "video", "subtitle", "other", "other", "video"]
    assert values(spark, resource.action(F.col("a")), [("video",), ("subtitle",), ("nfo",), (None,)]) == ["generate_strm", "attach_only", "ignore", "ignore"]
    assert values(spark, resource.is_system("a"), [("Thumbs.DB",), ("x",)]) == [True, False]


@pytest.mark.parametrize(
    ("name", "title"),
    [
        ("CLANNAD.S1-S2+SP+OVA", "CLANNAD"), ("B 86-不存在的战区", "86-不存在的战区"), ("A Channel", "A Channel"), ("[VCB-Studio] Show [1080p]", "Show"), ("[BeanSub&FZSD][1080p][Some Title]", "Some Title"), ("[1080p]", "1080p"), ("Show {tmdb-12}", "Show"),
        ("Film.2005", "Film"), ("Film（2005）", "Film"), ("Show.TV版+OVA", "Show"), ("Show 内封中字", "Show"), ("  a   b ", "a b"), ("[Mai-HiME][Sub]", "Mai-HiME"), ("", ""), (None, ""),
    ],
)
def test_titles(spark, name, title):
    assert values(spark, text.cleaned("a"), [(name,)]) == [title]


def test_texts(spark):
    assert values(spark, text.normalised("a"), [("A-b_c . D：。",), (None,)]) == ["abcd", ""]
    assert values(spark, text.id_hint("a"), [("x {tmdb-123}",), ("[TMDBID=7] y",), ("tmdb 5",), (None,)]) == [123, 7, None, None]
    assert values(spark, text.xml_escaped("a"), [("<a & 'b'>\"",), (None,)]) == ["&lt;a &amp; &apos;b&apos;&gt;&quot;", ""]
    assert values(spark, text.without_tags("a"), [(" <b>x</b> y<br/> ",), (None,)]) == ["x y", ""]
    assert values(spark, text.names("a"), [('[{"name":" a "},{"name":""},{"other":1}]',), ("no json",), (None,)]) == [["a"], [], []]
    assert values(spark, text.cast_names("a", 2), [('[{"name":"a"},{"name":" "},{"name":"c"}]',)]) == [["a"]]
    assert values(spark, text.is_team("a"), [("VCB-Studio",), ("A&Sub",), ("Sweet Home",), ("Mai-HiME",)]) == [True, True, False, False]


@pytest.mark.parametrize(
    ("name", "path", "guess"),
    [
        ("NCOP01.mkv", "a/x", ("opening", "op_ed", None, None)), ("Show ED - Title.mkv", "a/x", ("opening", "op_ed", None, None)), ("Mode.mkv", "a/x", ("none", "unknown", None, None)), ("Trailer.mkv", "x", ("auxiliary", "auxiliary", None, None)),
        ("AIR.S01E00.mkv", "AIR/x", ("season_episode", "season", 1, 0)), ("A S00E02.mkv", "A/x", ("season_episode", "special", 0, 2)), ("Show S01E02.mkv", "A/S3/x", ("season_episode", "season", 3, 2)), ("[SP2] Show.mkv", "x", ("special", "special", 0, 2)),
        ("Show 第2季 05.5.mkv", "x", ("numbered", "special", 2, 5)), ("Show 第12集.mkv", "Season 4/x", ("numbered", "season", 4, 12)), ("[T][03v2].mkv", "x", ("bracketed", "season", 1, 3)), ("00.mkv", "S2/x", ("bare", "special", 2, 0)),
        ("115.mkv", "Season 2/x", ("bare", "season", 2, 115)), ("Film.2001.mkv", "x", ("movie_by_year", "movie", None, None)), ("", "", ("none", "unknown", None, None)), (None, None, ("none", "unknown", None, None)),
    ],
)
def test_recognised(spark, name, path, guess):
    g = spark.createDataFrame([(name, path)], "a string, b string").select(media.recognised("a", "b").alias("g")).first().g
    assert (g.rule, g.group_type, g.season, g.episode) == guess


def test_years_and_seasons(spark):
    assert values(spark, media.year("a"), [("Film.2005",), ("Film (1899) x",), ("1984 film",), ("x",), (None,)]) == [2005, None, 1984, None, None]
    assert values(spark, media.season_of_path("a"), [("Show/Season 2/Disc/x.mkv",), ("第3季/S4/x",), ("S5",), (None,)]) == [2, 4, None, None]
    assert values(spark, media.is_structure("a"), [("Season 2",), ("SPs",), ("OP_ED",), ("Show S2",)]) == [True, True, True, False]


def test_scores(spark):
    assert values(spark, score.poster("a", "b", "c", "d", "e"), [("zh", 0.66, 8.0, 30, 2000), (None, None, None, None, None)]) == [50 + 20 + 24 + 20 + 10, 35.0]
    assert values(spark, score.logo("a", F.lit(".svg"), "b", "c"), [("ja", 1.0, 5), (None, None, None)]) == [35 + 20 + 3 + 5, 40.0]
    assert values(spark, score.count_severity("a", "b", "c"), [(10, 12, "season"), (5, 12, "season"), (11, 12, "season"), (1, 4, "special"), (0, 4, "season"), (None, 1, "season")]) == ["", "warn", "", "warn", "", ""]
    assert values(spark, score.progress_ratio("a", "b"), [(950.0, 1000.0), (5.0, 0.0), (float("nan"), 3.0), (9.0, 3.0), (-1.0, 3.0), (None, 3.0)]) == [0.95, 0.0, 0.0, 1.0, 0.0, 0.0]
    assert values(spark, score.progress_percent("a", "b"), [(0.001, False), (0.999, False), (0.5, True), (None, None)]) == [1, 99, 0, 0]
    assert values(spark, score.least_confidence("a", "b"), [("high", "medium"), ("high", "high"), ("medium", None)]) == ["medium", "high", "low"]
    assert values(spark, score.likeness("a", "b", "c"), [("x", "x", 2), ("", "", None), (None, "x", 1)]) == [8, 0, 3]


def test_pipeline_states(spark):
    rows = [("draft", None, None, None), ("a", None, None, None), ("a", "failed", None, None), ("a", "queued", None, None), ("a", "succeeded", None, None), ("a", "succeeded", "running", None), ("a", "succeeded", "succeeded", None), ("a", "succeeded", "succeeded", "queued"), ("a", "succeeded", "succeeded", "cancelled")]
    assert values(spark, score.pipeline_state("a", "b", "c", "d"), rows) == ["needs_review", "queued", "failed", "mirroring", "mirrored", "scraping", "completed", "updating_library", "cancelled"]


def test_likeness_of_titles(spark):
    assert values(spark, text.block_ratio("a", "b"), [("tide", "diet"), ("diet", "tide"), ("abc", "abc"), (None, "a"), (None, None)]) == [0.25, 0.5, 1.0, 0.0, 1.0]
    assert values(spark, text.identity("a"), [("ＡＢＣ the Movie!",), ("剧场版 名",), (None,)]) == ["abcmovie", "movie名", ""]
    assert values(spark, text.same_title("a", "b"), [("A-B c", "abc"), ("abcdefghi", "abcdefghij"), ("abc", "abcd"), ("", ""), (None, "a")]) == [True, True, False, False, False]
    assert [tuple(r) for r in values(spark, text.display_titles("a", "b"), [("Name", "名字"), ("名字", "なまえ"), ("Name", "なまえ"), (None, "x"), ("x", "x")])] == [("名字", "Name"), ("名字", "なまえ"), ("Name", "なまえ"), ("x", ""), ("x", "")]
    assert values(spark, text.is_noise("a"), [("1080p",), ("12",), ("VCB-Studio",), ("Season 2",), ("Show",), (None,)]) == [True, True, True, True, False, True]
    assert values(spark, text.variants("a"), [("Some.Show [x] Season 2",), ("1",), (None,)]) == [["Some.Show [x] Season 2", "Some.Show Season 2", "Some Show Season 2", "Some Show"], [], []]
