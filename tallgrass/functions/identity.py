"""What makes two files or titles the same: cards, versions, kinds, parts, anchors. Nulls count as empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .media import is_structure
from .paths import extension, segments, stem

# Words that name an edition, by precedence; suffixes that hide a shared title.
EDITIONS = ["新编撰版", "新編集版", "导演剪辑版", "导演版", "特别编辑版", "总集篇", "合集版", "remake", "re-edit", "reedit", "director"]
SUFFIXES = [
    r"\s*[\[(（【][^\])）】]*[\])）】]\s*$",
    r"(?i)\s*(?:剧场版|电影版|电影|動畫电影|动画电影|movie|film|ova|oad|oav|特别篇|番外篇|总集篇|前篇|后篇|上篇|下篇|sp|specials?)\s*$",
    r"(?i)\s*(?:第\s*\d+\s*季|season\s*\d+|s\d{1,2})\s*$",
]
# What names the halves of a film in two, in order of trust; the last two are held against the title without separators at its end, in lower case.
HALVES = [(r"(?i)前篇|前編|part\s*1|part\s*i\b", "front"), (r"(?i)后篇|後篇|后编|後編|part\s*2|part\s*ii\b", "back")]
ENDINGS = [(r"re\s*:\s*re\s*:?$", "back"), (r"re\s*:?$", "front")]
ANIME, LIVE = ["动画", "新番", "刮削好的动画", "番剧", "TV", "TV动画"], ["剧集"]


def _t(x) -> Column:
    return F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(""))


def version_bucket(text, year) -> Column:
    """The first edition word in a text, else the year, else empty."""
    low, found = F.lower(_t(text)), F.coalesce((F.col(year) if isinstance(year, str) else year).cast("string"), F.lit(""))
    for word in reversed(EDITIONS):
        found = F.when(low.contains(word), word).otherwise(found)
    return found


def related_title(title) -> Column:
    """A title without brackets at its end, film and special suffixes and a season number."""
    x = _t(title)
    for pattern in SUFFIXES:
        x = F.regexp_replace(x, pattern, "")
    return F.btrim(F.regexp_replace(x, r"\s+", " "))


def part_marker(title) -> Column:
    """front or back for the parts of a film in two, else empty."""
    name = _t(title)
    bare_end = F.lower(F.regexp_replace(name, r"[\s._-]+$", ""))
    tests = [(name.rlike(p), part) for p, part in HALVES] + [(bare_end.rlike(p), part) for p, part in ENDINGS]
    return F.coalesce(*[F.when(fits, part) for fits, part in tests], F.lit(""))


def kind(group, text) -> Column:
    """main, ncop, nced, pv, sp or extra by group and name; empty for other groups."""
    x, g = _t(text), _t(group)
    marked = F.when(x.rlike("(?i)NCOP"), "ncop").when(x.rlike("(?i)NCED"), "nced").when(x.rlike(r"(?i)(?:^|[^A-Za-z])PV\d+"), "pv")
    return F.when(g.isin("season", "movie", "main"), "main").when(g.isin("special", "sps"), F.coalesce(marked, F.lit("sp"))).when(g == "auxiliary", F.coalesce(marked, F.lit("extra"))).otherwise("")


def show_type(category, family, media_type, source) -> Column:
    """anime or live, series or movie: by the folder's category, the import's family, the source."""
    c, f = _t(category), F.lower(F.trim(_t(family)))
    movie = F.when(c.isin("动画电影", "电影"), True).when(_t(media_type) == "movie", True).otherwise(False)
    anime = F.when(f == "anime", True).when(f == "live", False).when(c.isin("动画电影", *ANIME), True).when(c.isin("电影", *LIVE), False).otherwise(_t(source).isin("local", "baidu"))
    return F.concat(F.when(anime, "anime_").otherwise("live_"), F.when(movie, "movie").otherwise("series"))


def anchor(name) -> Column:
    """A listing's name without extension, date suffix and separators, in lower case."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.lower(stem(_t(name)))), r"(?:[_\-\s]*(?:文件目录|目录树))?[_\-\s]*\d{8,14}$", ""), r"[_\-\s]+", "")


def card(source, path, standalone, work) -> Column:
    """One identity for each work's root in a source: its first two folders, or the work where these are a season or a file."""
    parts, s, w = segments(_t(path)), _t(source), F.lower(_t(work))
    first, second = F.coalesce(F.get(parts, F.lit(0)), F.lit("")), F.coalesce(F.get(parts, F.lit(1)), F.lit(""))
    odd = (extension(second) != "") | is_structure(first)
    by_work = F.when(w != "", F.concat_ws(":", F.lit("source"), s, w))
    by_path = F.when(F.size(parts) >= 2, F.concat_ws(":", F.lit("source"), s, F.lower(F.concat_ws("/", first, second))))
    fallback = F.when(w != "", F.concat_ws(":", F.lit("fallback"), s, w)).otherwise("")
    return F.when(standalone, fallback).otherwise(F.coalesce(F.when(odd, by_work), by_path, fallback))
