"""Scores and states as columns. Fixed values are those that results must equal; a null measure counts as 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _z(x) -> Column:
    return F.coalesce(_c(x).cast("double"), F.lit(0.0))


# Points by language; None is an image without one.
POSTER_LANGUAGES = {"zh": 50, "zh-CN": 50, "zh-TW": 50, None: 35, "ja": 25, "en": 20}
BACKDROP_LANGUAGES = {None: 50, "zh": 10, "en": 10, "ja": 10}
LOGO_LANGUAGES = {"zh": 50, "zh-CN": 50, "zh-TW": 50, "ja": 35, "en": 25, None: 20}


def _language(lang, points: dict) -> Column:
    found = F.when(_c(lang).isNull(), F.lit(float(points[None])))
    for name, n in points.items():
        if name is not None:
            found = found.when(_c(lang) == name, F.lit(float(n)))
    return found.otherwise(0.0)


def _votes(average, count) -> Column:
    return F.least(_z(average) * 3, F.lit(30.0)) + F.least(_z(count), F.lit(20.0))


def _between(x, low: float, high: float) -> Column:
    return F.when(_z(x).between(low, high), 20.0).otherwise(0.0)


def poster(lang, aspect, average, count, width) -> Column:
    return _language(lang, POSTER_LANGUAGES) + _between(aspect, 0.62, 0.72) + _votes(average, count) + F.least(_z(width) / 100, F.lit(10.0))


def backdrop(lang, aspect, average, count, width) -> Column:
    return _language(lang, BACKDROP_LANGUAGES) + _between(aspect, 1.70, 1.90) + _votes(average, count) + F.least(_z(width) / 200, F.lit(10.0))


def logo(lang, kind, average, count) -> Column:
    return _language(lang, LOGO_LANGUAGES) + F.when(_c(kind) == ".svg", 20.0).otherwise(0.0) + _votes(average, count)


def still(lang, average, count, width) -> Column:
    return _language(lang, BACKDROP_LANGUAGES) + _votes(average, count) + F.least(_z(width) / 100, F.lit(10.0))


def count_severity(local, remote, group_type) -> Column:
    """'warn' or '': whether a local episode count departs from the remote one. Specials bear more."""
    a, b = _z(local), _z(remote)
    apart, ratio = F.abs(a - b), a / F.nullif(b, F.lit(0.0))
    special = (apart >= 3) & ((ratio < 0.5) | (ratio > 1.8))
    plain = (apart >= 2) & ((ratio < 0.8) | (ratio > 1.2))
    return F.when((a <= 0) | (b <= 0), "").when(F.when(_c(group_type) == "special", special).otherwise(plain), "warn").otherwise("")


def progress_ratio(position, duration) -> Column:
    """position / duration within 0 and 1, 4 places; 0 where either is null, not finite or the duration not positive."""
    p, d = (F.when(F.isnan(_c(x).cast("double")) | (F.abs(_c(x).cast("double")) == float("inf")), None).otherwise(_c(x).cast("double")) for x in (position, duration))
    return F.round(F.when((d > 0) & p.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), p / d))).otherwise(0.0), 4)


def progress_percent(ratio, completed) -> Column:
    """0 if completed or not begun, else 1 to 99."""
    r = _z(ratio)
    return F.when(F.coalesce(_c(completed), F.lit(False)) | (r <= 0), 0).otherwise(F.least(F.greatest(F.round(r * 100), F.lit(1)), F.lit(99))).cast("int")


def least_confidence(*levels) -> Column:
    """The lowest of low < medium < high; other values and nulls count as low."""
    rank = lambda x: F.when(_c(x) == "high", 2).when(_c(x) == "medium", 1).otherwise(0)
    return F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), F.array_min(F.array(*map(rank, levels))) + 1)


def pipeline_state(revision, mirror, scrape, library) -> Column:
    """State of a revision from the states of its jobs; null for a job that isn't there."""
    ended = lambda x: F.when(_c(x).isin("failed", "cancelled"), _c(x))
    after = lambda x, name: F.when(_c(x).isin("queued", "running"), name)
    other = lambda x: F.when(_c(x) != "succeeded", _c(x))
    first = F.coalesce(ended(mirror), after(mirror, "mirroring"), other(mirror))
    second = F.coalesce(F.when(_c(scrape).isNull(), "mirrored"), ended(scrape), after(scrape, "scraping"), other(scrape))
    third = F.coalesce(ended(library), after(library, "updating_library"), other(library), F.lit("completed"))
    return F.when(_c(revision) == "draft", "needs_review").when(_c(mirror).isNull(), "queued").otherwise(F.coalesce(first, second, third))


def likeness(show_a, show_b, shared) -> Column:
    """Likeness of two works: 2 for the same kind of show (a null or empty one is none), 3 for each tag that both have."""
    same = (_c(show_a) == _c(show_b)) & (_c(show_a) != "")
    return F.when(same, 2).otherwise(0) + 3 * F.coalesce(_c(shared), F.lit(0))


def candidate(search, title, original, movie, hint_hit, similarity, search_year, year, same_type, popularity, vote) -> Column:
    """Score of a search result for a work, to one place. Titles are normalised texts (`text.normalised`); part markers are not scored here."""
    s, t, o = (F.coalesce(_c(x), F.lit("")) for x in (search, title, original))
    has = lambda x: x != ""
    long_prefix = lambda x: has(x) & F.startswith(s, x) & (F.length(x) >= 3)
    broad = lambda x: has(x) & F.contains(s, x)
    by_title = F.when((s == t) | (has(o) & (s == o)), 40).when((has(t) & F.contains(t, s)) | (has(o) & F.contains(o, s)), 25)
    by_title = by_title.when(long_prefix(t) | long_prefix(o), F.when(_c(movie), 12).otherwise(34)).when(broad(t) | broad(o), 12).otherwise(0)
    likely = F.when(_c(similarity) >= 0.58, 24).when(_c(similarity) >= 0.42, 16).when(_c(similarity) >= 0.30, 8).otherwise(0)
    apart = F.abs(_c(search_year) - _c(year))
    by_year = F.when(apart == 0, 30).when(apart <= 1, 15).when(apart <= 3, 5).otherwise(0)
    famous = F.when(_z(popularity) > 0, F.least(F.lit(10.0), F.log10(F.greatest(F.lit(1.0), _z(popularity))) * 3)).otherwise(0.0)
    titled = F.when(s != "", by_title + likely).otherwise(0)
    return F.round(F.when(_c(hint_hit), 120.0).otherwise(0.0) + titled + by_year + F.when(_c(same_type), 10).otherwise(0) + famous + F.when(_z(vote) >= 7, 5).otherwise(0), 1)


def is_fresh(cached_at, now, seconds) -> Column:
    """Whether less than `seconds` have gone since; a null time is stale."""
    return F.coalesce(F.unix_timestamp(_c(now)) - F.unix_timestamp(_c(cached_at)) < F.lit(seconds), F.lit(False))


def due_at(now, path) -> Column:
    """A day after `now`, and as many seconds more, below a day, as the path's MD5 tells."""
    digest = F.md5(_c(path))
    # The digest is longer than any number type: its remainder follows from pieces of 7 hex digits.
    part = lambda i: F.conv(F.substring(digest, 1 + 7 * i, 7 if i < 4 else 4), 16, 10).cast("long")
    rest = part(0)
    for i in range(1, 5):
        rest = (rest % 86400 * (1 << (28 if i < 4 else 16)) + part(i))
    return F.timestamp_seconds(F.unix_timestamp(_c(now)) + 86400 + rest % 86400)
