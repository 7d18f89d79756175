"""Titles and texts as columns; a null gives a null unless said otherwise."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

# Words and patterns of release names.
STATUS_WORDS = ["[完结]", "【完结】", "(完结)", "（完结）", "[连载中]", "【连载中】"]
ID_HINT = r"(?i)[\[{]\s*tmdb(?:id)?\s*[-=:]\s*(\d+)\s*[\]}]"
LETTER_PREFIX = r"^[A-Za-z]\s+(?=\d)"
SEASON_RANGE = r"(?i)[.．]?S\d+\s*[-~]\s*S\d+(?:\+(?:SP|OVA|OAD|剧场版|外传|Movie))*"
CATALOG_SUFFIX = r"(?i)\.(?:TV(?:版)?|动画版)(?:\s*\+\s*(?:外传|剧场版|电影|OVA|OAD|SP|特别篇))*$"
LANGUAGE_SUFFIX = r"\s+(?:内封中字|内封简繁|简繁内封|中字内封)$"
TECH_WORDS = ["bdrip", "webrip", "web-dl", "bdmv", "remux", "hevc", "hevc-10bit", "h264", "h265", "x264", "x265", "avc", "10bit", "8bit", "hi10p", "ma10p", "1080p", "2160p", "720p", "480p", "4k", "chs", "cht", "chsjp", "chttp", "chi_jpn", "scjp", "tcjp", "jpn", "eng", "mp4", "mkv", "flac", "aac", "ac3", "truehd", "dts", "e-ac3", "fin", "movie", "v2", "v3"]
TECH_PATTERN = r"(?i)^(?:Ma\d+p.*|\d+[-~]\d+.*|\d+bit|\d+p|[A-Z]{2,3}_\d+[pi]|[A-Z]+-[A-Z]+-\d+)$"
TEAM_WORDS = ["sub", "raw", "raws", "studio", "vcb", "vcb-studio", "lolihouse", "sakurato", "sweetsub", "dmg", "haruhana", "nekomoe", "kissaten", "nekomoe kissaten", "beansub", "fzsd", "cz", "mai", "t.h.x", "lp-raws", "airota", "ktxp", "thx", "sweet", "loli", "as", "nw", "ea"]
YEAR_SUFFIX = r"(?:[.．]\d{4}|[(（]\d{4}[)）]|\s\d{4})$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def one_spaced(x) -> Column:
    """White space as single blanks, none at the ends."""
    return F.btrim(F.regexp_replace(_c(x), r"\s+", " "))


def normalised(x) -> Column:
    """Lower case without white space and - _ . : and their wide forms, as titles are compared; null gives empty."""
    return F.regexp_replace(F.lower(F.coalesce(_c(x), F.lit(""))), r"[\s\-_.:：。·]+", "")


def without_tags(x) -> Column:
    """Text without <...> tags, trimmed; null gives empty."""
    return F.btrim(F.regexp_replace(F.coalesce(_c(x), F.lit("")), r"<[^>]+>", ""))


def xml_escaped(x) -> Column:
    """&, <, > and both quotes as entities; null gives empty."""
    out = F.coalesce(_c(x), F.lit(""))
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(plain), F.lit(entity))
    return out


def id_hint(x) -> Column:
    """The number of an id mark such as {tmdb-123} or [tmdbid=123]; null if there is none."""
    return F.nullif(F.regexp_extract(_c(x), ID_HINT, 1), F.lit("")).cast("long")


def is_tech(token) -> Column:
    """Whether a bracketed token names a format."""
    return F.lower(F.trim(_c(token))).isin(*TECH_WORDS) | F.trim(_c(token)).rlike(TECH_PATTERN)


def is_team(token) -> Column:
    """Whether a token names a release team: the whole token, or one of the parts that & or + join."""
    low = F.lower(F.trim(_c(token)))
    return low.isin(*TEAM_WORDS) | (low.rlike("[&+]") & F.exists(F.split(low, "[&+]"), lambda x: F.trim(x).isin(*TEAM_WORDS)))


def best_token(tokens) -> Column:
    """Of bracketed tokens the only one, or the longest that is neither a format nor a team, or the longest; the first of equal ones. Null if none."""
    every = _c(tokens)
    some = F.filter(every, lambda x: ~is_tech(x) & ~is_team(x))
    longest = lambda xs: F.get(F.filter(xs, lambda x: F.length(x) == F.array_max(F.transform(xs, F.length))), F.lit(0))
    return F.when(F.size(every) == 1, F.get(every, F.lit(0))).when(F.size(some) > 0, longest(some)).when(F.size(every) > 0, longest(every))


def cleaned(container) -> Column:
    """The title in a container's name, by rules in order; the name itself where they leave nothing; null gives empty."""
    raw = F.coalesce(_c(container), F.lit(""))
    x = raw
    for word in STATUS_WORDS:
        x = F.replace(x, F.lit(word), F.lit(""))
    x = F.when(x.rlike(ID_HINT), one_spaced(F.regexp_replace(x, ID_HINT, ""))).otherwise(x)
    x = F.regexp_replace(F.btrim(F.regexp_replace(x, LETTER_PREFIX, "")), SEASON_RANGE, "")
    x = F.btrim(F.regexp_replace(F.btrim(F.regexp_replace(x, CATALOG_SUFFIX, "")), LANGUAGE_SUFFIX, ""))
    tokens = F.regexp_extract_all(x, F.lit(r"\[([^\]]*)\]"), 1)
    outside = one_spaced(F.regexp_replace(x, r"\[[^\]]*\]", ""))
    x = F.when(F.size(tokens) == 0, x).when(outside != "", outside).otherwise(F.coalesce(F.nullif(best_token(tokens), F.lit("")), x))
    x = one_spaced(F.btrim(F.regexp_replace(x, YEAR_SUFFIX, "")))
    return F.when(x == "", raw).otherwise(x)


def names(x) -> Column:
    """The names of a JSON list of objects, blanks left out; text that isn't such a list gives an empty array."""
    rows = F.from_json(_c(x), "array<struct<name:string>>")
    return F.coalesce(F.filter(F.transform(rows, lambda r: F.trim(r["name"])), lambda n: n != ""), F.array().cast("array<string>"))


def cast_names(x, most: int = 14) -> Column:
    """Names among the first `most` entries of a JSON list; blanks are left out after the cut."""
    rows = F.slice(F.coalesce(F.from_json(_c(x), "array<struct<name:string>>"), F.array().cast("array<struct<name:string>>")), 1, most)
    return F.filter(F.transform(rows, lambda r: F.trim(r["name"])), lambda n: n != "")


@F.pandas_udf(DoubleType())
def block_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the characters in matching blocks over all characters, longest block first; the order of arguments matters. Null counts as empty."""
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(StringType())
def folded(x: pd.Series) -> pd.Series:
    """Compatibility form without case, as titles are compared across widths and scripts; null gives empty."""
    from unicodedata import normalize

    return pd.Series([normalize("NFKC", v or "").casefold() for v in x])


def identity(title) -> Column:
    """A title as an identity: compatibility form without case, words for films as 'movie', only letters a-z, digits, Han and kana."""
    x = folded(_c(title))
    x = F.regexp_replace(x, "剧场版|劇場版|电影版|電影版|the movie|gekijouban", "movie")
    return F.regexp_replace(x, r"[^0-9a-z\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}]", "")


def same_title(a, b, least: int = 5, share: float = 0.82) -> Column:
    """Whether two titles are one: equal as identities, or one holds the other, which has `least` characters and that share of its length."""
    x, y = identity(a), identity(b)
    short, long = F.when(F.length(x) <= F.length(y), x).otherwise(y), F.when(F.length(x) <= F.length(y), y).otherwise(x)
    holds = F.contains(long, short) & (F.length(short) >= least) & (F.length(short) >= share * F.length(long))
    return (x != "") & ((x == y) | holds)


def display_titles(name, original) -> Column:
    """(primary, secondary): a name in Han characters without kana goes first, else the original if that is so, else the name; the secondary is empty where equal."""
    n, o = F.coalesce(_c(name), F.lit("")), F.coalesce(_c(original), F.lit(""))
    han = lambda x: x.rlike(r"[\x{4E00}-\x{9FFF}]") & ~x.rlike(r"[\x{3040}-\x{30FF}]")
    first = F.when(han(n), n).when(han(o), o).when(n != "", n).otherwise(o)
    second = F.when(first == n, o).otherwise(n)
    return F.struct(first.alias("primary"), F.when(second == first, "").otherwise(second).alias("secondary"))


def is_noise(query) -> Column:
    """Whether a text is no use as a search query: too short, only digits and signs, a format or a team."""
    q = one_spaced(F.coalesce(_c(query), F.lit("")))
    core = F.regexp_replace(q, r"[\s\p{Punct}]+", "")
    return (F.length(core) < 2) | core.rlike(r"^\d+$") | is_tech(q) | is_team(q) | q.rlike(r"(?i)^(?:season|s|第)\s*\d+\s*季?$")


def variants(title, most: int = 12) -> Column:
    """Distinct search forms of a title in order: itself, without brackets, dots as blanks, without film words, without a sequel's number; noise left out."""
    t = one_spaced(F.coalesce(_c(title), F.lit("")))
    plain = one_spaced(F.regexp_replace(t, r"[\[(（【][^\])）】]*[\])）】]", " "))
    dots = one_spaced(F.regexp_replace(plain, r"[._·・]+", " "))
    film = one_spaced(F.regexp_replace(dots, r"(?i)剧场版|劇場版|电影版|(?<![A-Za-z])the movie(?![A-Za-z])", " "))
    sequel = one_spaced(F.regexp_replace(film, r"(?i)\s*(?:第\s*\d+\s*季|season\s*\d+|s\d{1,2}|\s[2-9]|[ⅡⅢⅣⅤ])$", ""))
    half = one_spaced(F.regexp_extract(film, r"^([^:：~～\-]{2,})[:：~～\-]", 1))
    return F.slice(F.array_distinct(F.filter(F.array(t, plain, dots, film, sequel, half), lambda x: ~is_noise(x))), 1, most)
