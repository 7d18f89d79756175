"""What a video file's name tells: a cascade of rules, the first that fits wins, as structs of columns.

Every rule is a column of type GUESS, null where it doesn't fit; the cascade is
their coalesce. Names without any mark, and nulls, give group 'unknown'.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import basename, stem

GUESS = "struct<rule:string,group_type:string,season:int,episode:int,confidence:string>"

# Marks of openings, auxiliary videos, specials and own cards.
OPENING = r"(?i)NCOP|NCED|NON[-\s]?CREDIT\s+(?:OP|ED)|无字幕\s*(?:OP|ED)|OPENING|ENDING|[\[【](?:OP|ED)(?:\d+|\s+[^\]】]+)?[\]】]|(?:^|[^A-Za-z0-9])(?:OP|ED)\d*(?:$|[^A-Za-z0-9])"
AUXILIARY = r"(?i)TV\s*SPOT|TRAILER|EYECATCH|PREVIEW\s*\d+(?:\.\d+)?|NON[-\s]?TELOP|[\[【]PV\d*[\]】]|(?:^|[^A-Za-z])PV(?:\d+|\s|$|[(\[])|[\[【]MV(?:\s+[^\]】]+)?[\]】]|(?:^|[^A-Za-z])CM\d+|\[CM\d*\]|(?:^|[^A-Za-z0-9])MENU\d*(?:$|[^A-Za-z0-9])|菜单|预告|花絮"
SPECIAL = r"(?i)(?<![A-Za-z])(?:OVA|OAD|SPECIALS?)(?![A-Za-z])|\bS00(?:E\d+)?\b|番外|短篇|小剧场|BD\s*特典|[\[【](?:SP\d*|LITE)[\]】]|(?:^|[^A-Za-z])SP\d+"
MOVIE = r"(?i)剧场版|劇場版|(?<![A-Za-z])(?:MOVIE|THE\s+MOVIE)(?![A-Za-z])"
SEASON_DIR = r"(?i)^(?:Season\s*(\d+)|第\s*(\d+)\s*季|S(\d+))$"
STRUCTURE_DIR = r"(?i)^(?:Season\s*\d+|第\s*\d+\s*季|S\d+|Specials?|SPs?|OP[＆&_-]?ED)$"
YEARS = [r"[.．](\d{4})", r"[(（](\d{4})[)）]", r"(?:^|\s)(\d{4})(?:\s|$)"]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _n(x: Column, pattern: str, group: int = 1) -> Column:
    """A group of a pattern as a number, null if it doesn't fit."""
    return F.expr("NULL").cast("int") if pattern is None else F.nullif(F.regexp_extract(x, pattern, group), F.lit("")).cast("int")


def _guess(when: Column, rule: str, group: Column | str, season: Column | None, episode: Column | None, confidence: str) -> Column:
    none = F.lit(None).cast("int")
    group = F.lit(group) if isinstance(group, str) else group
    return F.when(when, F.struct(F.lit(rule).alias("rule"), group.alias("group_type"), (none if season is None else season).cast("int").alias("season"), (none if episode is None else episode).cast("int").alias("episode"), F.lit(confidence).alias("confidence")))


def season_of_path(path) -> Column:
    """The season that the nearest folder names, such as 'Season 2', '第2季' or 'S2'; null if none does."""
    folders = F.reverse(F.slice(F.split(_c(path), "/"), F.lit(1), F.greatest(F.size(F.split(_c(path), "/")) - 1, F.lit(0))))
    number = lambda x: F.coalesce(*(_n(x, SEASON_DIR, i) for i in (1, 2, 3)))
    return F.get(F.filter(F.transform(folders, number), lambda n: n.isNotNull()), F.lit(0))


def is_structure(folder) -> Column:
    """Whether a folder's name is one of structure (a season, specials), not a title."""
    return F.trim(_c(folder)).rlike(STRUCTURE_DIR)


def year(x) -> Column:
    """The first year between 1900 and 2099 of a name: after a dot, in parentheses, or alone; null if none."""
    fit = lambda n: F.when(n.between(1900, 2099), n)
    return F.coalesce(*(fit(_n(_c(x), p)) for p in YEARS))


def season_episode(name: Column, season: Column) -> Column:
    """SxxExx; a folder's season overrides the first season of the name."""
    s, e = _n(name, r"(?i)S(\d+)\s*E(\d+)"), _n(name, r"(?i)S(\d+)\s*E(\d+)", 2)
    return _guess(s.isNotNull(), "season_episode", F.when(s == 0, "special").otherwise("season"), F.when(s == 1, F.coalesce(season, s)).otherwise(s), e, "high")


def numbered(name: Column, season: Column) -> Column:
    """'第2季 05', '第05话' with the folder's season, or the first; x.5 and 0 are specials."""
    s = _n(name, r"第\s*(\d+)\s*季")
    e = F.coalesce(_n(name, r"第\s*\d+\s*季[^\d]{0,3}(\d{1,3})(?!\d)"), _n(name, r"第\s*(\d{1,3})\s*[话話集]"))
    half = name.rlike(r"第\s*\d+\s*季[^\d]{0,3}\d{1,3}\.5")
    return _guess(e.isNotNull(), "numbered", F.when(half | (e == 0), "special").otherwise("season"), F.coalesce(s, season, F.lit(1)), e, "high")


def bracketed(name: Column, season: Column) -> Column:
    """[05] or 【05v2】."""
    e = _n(name, r"[\[【]\s*(\d{1,3})(?:v\d)?\s*[\]】]")
    return _guess(e.isNotNull(), "bracketed", F.when(e == 0, "special").otherwise("season"), F.coalesce(season, F.lit(1)), e, "medium")


def bare(name: Column, season: Column) -> Column:
    """A name of digits only, or one that ends in ' - 05', ' 05' or ' EP05'; three digits such as 203 are season 2 episode 3 where no folder names a season."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    e = F.coalesce(_n(stem, r"^(\d{1,3})$"), _n(stem, r"\s[-–—]\s*(\d{1,3})$"), _n(stem, r"(?i)\s(?:EP?)?(\d{1,3})$"))
    half = stem.rlike(r"\d{1,3}\.5$")
    coded = (e >= 101) & (e % 100 > 0) & season.isNull() & stem.rlike(r"^\d{3}$")
    return _guess(e.isNotNull() & ~half, "bare", F.when(e == 0, "special").otherwise("season"), F.when(coded, F.floor(e / 100)).otherwise(F.coalesce(season, F.lit(1))), F.when(coded, e % 100).otherwise(e), "medium")


def attached(name: Column, season: Column) -> Column:
    """A title in Han or kana characters with digits right after it."""
    e = _n(F.regexp_replace(name, r"\.[^.]*$", ""), r"[\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}](\d{1,3})$")
    return _guess(e.isNotNull(), "attached", "season", F.coalesce(season, F.lit(1)), e, "low")


def recognised(name, path) -> Column:
    """The GUESS of a file: openings and auxiliary videos, specials, numbered episodes, movies, bare numbers, a movie by its year, unknown."""
    file, season = F.coalesce(_c(name), F.lit("")), season_of_path(F.coalesce(_c(path), F.lit("")))
    special_no = F.coalesce(_n(file, r"(?i)(?:SP|OVA|OAD|S00E)\s*(\d{1,3})"), _n(file, r"[\[【]\s*(\d{1,3})\s*[\]】]"))
    rules = [
        _guess(file.rlike(OPENING), "opening", "op_ed", None, None, "high"),
        _guess(file.rlike(AUXILIARY), "auxiliary", "auxiliary", None, None, "high"),
        season_episode(file, season),
        _guess(file.rlike(SPECIAL), "special", "special", F.lit(0), special_no, "high"),
        _guess(file.rlike(MOVIE), "movie", "movie", None, None, "medium"),
        numbered(file, season),
        bracketed(file, season),
        bare(file, season),
        attached(file, season),
        _guess(year(file).isNotNull() | year(_c(path)).isNotNull(), "movie_by_year", "movie", None, None, "low"),
        _guess(F.lit(True), "none", "unknown", None, None, "low"),
    ]
    return F.coalesce(*rules).cast(GUESS)


def evidence(guess: Column) -> Column:
    """What a guess rests on, as flags."""
    return F.struct(guess["episode"].isNotNull().alias("has_episode"), (guess["confidence"] == "high").alias("is_sure"), guess["group_type"].isin("op_ed", "auxiliary").alias("is_extra"), (guess["group_type"] == "unknown").alias("needs_review"))


def keep_score(path="relative_path", title="work_title", original="original_title", extra="is_extra") -> Column:
    """Struct whose maximum is the copy to keep: no extra, then resolution, codecs, a name that holds the title (or else the original one), a short path, a great path. Nulls count as '' and as no extra."""
    full = lambda x: F.coalesce(_c(x), F.lit(""))
    tight = lambda x: F.lower(F.regexp_replace(x, r"\s+", ""))
    name = tight(stem(basename(F.replace(full(path), F.lit("\\"), F.lit("/")))))
    low = F.lower(full(path))
    size = F.regexp_extract(low, "(2160|1080|720|480)p", 1)
    resolution = F.when(size == "2160", 4).when(size == "1080", 3).when(size == "720", 2).when(size == "480", 1).otherwise(0)
    codec = F.when(low.rlike("hevc|x265|h265"), 2).otherwise(0) + F.when(low.contains("flac"), 1).otherwise(0)
    held = lambda x: (tight(full(x)) != "") & F.contains(name, tight(full(x)))
    match = F.when(held(title), 2).when(held(original), 1).otherwise(0)
    main = F.when(F.coalesce(_c(extra), F.lit(False)), 0).otherwise(1)
    return F.struct(main.alias("main"), resolution.alias("resolution"), codec.alias("codec"), match.alias("title"), (-F.length(full(path))).alias("short"), full(path).alias("path"))
