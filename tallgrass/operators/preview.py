"""Previews of import plans, many plans at once: flags of items, issues, groups, counts, and the targets that metadata is fetched for.

Items have plan and item_id (together their key), position (their order in the
plan), resource_type, action, group_type, season_number, episode_number,
special_number, work_id, canonical_work_id, work_title, original_title,
series_group, card_type, media_type, show_type, relative_path, year, confidence,
user_override_id, needs_review and warnings (array); other columns pass through.
Null texts and arrays count as empty. Groups and issues are rows with counts,
their items rows that carry the group's or issue's columns, so that none is
gathered whatever its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallgrass.functions import identity, text

# Mark of a warning about two files of one episode, mark of the folder of a work in a series, groups without works of their own.
DUPLICATE_MARK = "同一季集存在多个来源文件"
SUBWORK_MARK = "子作品目录:"
NO_WORK = ["ignored", "op_ed"]
# Groups that have targets, in their order.
TARGET_GROUPS = {"season": 0, "special": 1, "movie": 2}
# How file names and other texts write a year, in order of trust.
FILE_YEARS = [r"[.．](\d{4})(?=[.．\s_-])", r"[(\（](\d{4})[)\）]", r"\b(\d{4})\b"]
TEXT_YEARS = [r"[.．](\d{4})", r"[(\（](\d{4})[)\）]", r"\s(\d{4})(?:\s|$)", r"^(\d{4})$"]
# Issues and their levels.
ISSUES = {
    "low_confidence": "warning",
    "needs_review": "warning",
    "ungrouped_video": "warning",
    "duplicate_episode": "error",
    "missing_work_title": "error",
    "missing_group_type": "error",
    "season_incomplete": "error",
}

GROUP = ["plan", "work_id", "card_type", "group_type", "season_number"]
TARGET = ["plan", "source", "canonical_work_id", "series_group", "local_title", "group_type", "season_number", "card"]


def _t(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _year() -> Column:
    return F.coalesce(F.nullif(F.col("year"), F.lit(0)).cast("string"), F.lit(""))


def unused(rows: DataFrame, *names: str) -> list[str]:
    """The names behind as many underscores as make them new to the rows."""
    most = max((len(c) - len(c.lstrip("_")) for c in rows.columns), default=0)
    return ["_" * (most + 1) + name for name in names]


def taken() -> Column:
    """Whether an item is a video that gets a file."""
    return F.coalesce((F.col("resource_type") == "video") & (F.col("action") == "generate_strm"), F.lit(False))


def episode_identity() -> Column:
    """The work within which an item's episode must be alone: the canonical work, else its title or series with the edition, else its work."""
    full = lambda c: F.nullif(_t(c), F.lit(""))
    bucket = identity.version_bucket(F.concat_ws(" ", full("relative_path"), full("work_title"), full("original_title")), _year())
    named = lambda c: F.when(text.one_spaced(_t(c)) != "", F.concat_ws("|", F.lower(text.one_spaced(_t(c))), bucket))
    return F.coalesce(full("canonical_work_id"), named("work_title"), named("series_group"), _t("work_id"))


def work_identity() -> Column:
    """The work that an item counts for: its id, else its card type, series or title and year."""
    title = F.coalesce(F.nullif(_t("series_group"), F.lit("")), _t("work_title"))
    return F.when(_t("work_id") != "", F.concat(F.lit("id|"), "work_id")).otherwise(F.concat_ws("|", F.lit("fallback"), _t("card_type"), title, _year()))


def flagged(items: DataFrame) -> DataFrame:
    """Items with taken and a column for each of ISSUES, which only taken items have.

    duplicate_episode marks season items with both numbers whose number another
    item of the plan has in the same work; they need review, too. Other items
    need it if they say so, unless all their warnings are about duplicates.
    Episodes are counted before they meet their items, and only those that
    several items have come back.
    """
    same, twice_name = unused(items, "same", "twice")
    key = ["plan", same, "season_number", "episode_number"]
    main = taken() & (_t("group_type") == "season")
    numbered = main & F.col("season_number").isNotNull() & F.col("episode_number").isNotNull()
    rows = items.withColumn(same, F.when(numbered, episode_identity()))
    twice = rows.where(F.col(same).isNotNull()).groupBy(*key).agg(F.count("*").alias(twice_name)).where(F.col(twice_name) > 1)
    rows = rows.join(twice, key, "left")
    said = F.filter(F.coalesce("warnings", F.array().cast("array<string>")), lambda w: w.isNotNull())
    about = lambda w: w.contains(DUPLICATE_MARK)
    only_duplicates = F.exists(said, about) & F.forall(said, about)
    twice_ = F.col(twice_name).isNotNull()
    flags = {
        "low_confidence": (_t("confidence") == "low") & (_t("user_override_id") == ""),
        "needs_review": twice_ | (F.coalesce("needs_review", F.lit(False)) & ~only_duplicates),
        "ungrouped_video": _t("group_type") == "",
        "duplicate_episode": twice_,
        "missing_work_title": _t("work_title") == "",
        "missing_group_type": _t("group_type") == "",
        "season_incomplete": (_t("group_type") == "season") & (F.col("season_number").isNull() | F.col("episode_number").isNull()),
    }
    rows = rows.withColumns({"said_review": F.coalesce("needs_review", F.lit(False)), "taken": taken(), "episode_of": F.when(twice_, F.col(same))})
    return rows.withColumns({c: taken() & v for c, v in flags.items()}).drop(same, twice_name)


def issues(flags: DataFrame) -> DataFrame:
    """plan, code, level, episode_of, season_number, episode_number, item_id, position: an issue's items, one row each.

    duplicate_episode is one issue for each work (episode_of) and number, every other code one a plan, where these columns are null.
    """
    codes = F.array(*[F.when(F.col(c), F.struct(F.lit(c).alias("code"), F.lit(level).alias("level"))) for c, level in ISSUES.items()])
    rows = flags.select("plan", "item_id", "position", "episode_of", "season_number", "episode_number", F.inline(F.filter(codes, lambda x: x.isNotNull())))
    own = lambda c: F.when(F.col("code") == "duplicate_episode", F.col(c)).alias(c)
    return rows.select("plan", "code", "level", own("episode_of"), own("season_number"), own("episode_number"), "item_id", "position")


def groups(items: DataFrame) -> DataFrame:
    """GROUP, item_count, and work_title, year, media_type, show_type and series_group of the first item: groups of taken items."""
    first = F.min_by(F.struct("work_title", "year", "media_type", "show_type", "series_group"), F.struct("position", "item_id")).alias("_first")
    return items.where(taken()).groupBy(*GROUP).agg(F.count("*").alias("item_count"), first).select(*GROUP, "item_count", "_first.*")


def counts(flags: DataFrame) -> DataFrame:
    """One row a plan: items by kind and flag, and works. Works are counted in two steps, so that no plan is one task's."""
    n = lambda c, name: F.count_if(c).alias(name)
    action = lambda a: F.col("action") == a
    return flags.groupBy("plan").agg(
        F.count("*").alias("total_items"),
        n(F.col("resource_type") == "video", "video_count"),
        n(action("generate_strm"), "generate_strm_count"),
        n(action("ignore"), "ignored_count"),
        n(action("attach_only"), "attach_only_count"),
        n(F.col("low_confidence"), "low_confidence_count"),
        n(F.col("needs_review"), "needs_review_count"),
        n(F.col("ungrouped_video"), "ungrouped_video_count"),
        n(F.col("duplicate_episode"), "duplicate_episode_count"),
        n(F.col("said_review"), "said_review_count"),
        F.count_distinct(F.when(F.col("taken") & ~_t("group_type").isin(NO_WORK), work_identity())).alias("work_count"),
    )


def kinds(items: DataFrame) -> DataFrame:
    """plan, by_resource_type, by_action: maps of counts, a null kind counting as ''."""
    def by(column: str, name: str) -> DataFrame:  # kinds are few
        some = items.groupBy("plan", _t(column).alias("_k")).agg(F.count("*").alias("_n"))
        return some.groupBy("plan").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_k", "_n")))).alias(name))

    return by("resource_type", "by_resource_type").join(by("action", "by_action"), "plan")


def subwork(reasons: str = "reasons", warnings: str = "warnings") -> Column:
    """The folder of a work in a series that the first marked reason or warning names, else ''."""
    nothing = F.array().cast("array<string>")
    marked = F.filter(F.concat(F.coalesce(F.col(reasons), nothing), F.coalesce(F.col(warnings), nothing)), lambda x: x.contains(SUBWORK_MARK))
    return F.coalesce(F.trim(F.replace(F.get(marked, F.lit(0)), F.lit(SUBWORK_MARK), F.lit(""))), F.lit(""))


def _plausible(n: Column) -> Column:
    return n.between(1900, 2099)


def file_year(path="relative_path", title="title", original="original_title") -> Column:
    """The first year from 1900 to 2099 in a file's name, else its title, else its original title, by FILE_YEARS; null if none."""
    name = F.regexp_extract(F.replace(_t(path), F.lit("\\"), F.lit("/")), "([^/]*)$", 1)
    every = lambda x, p: F.get(F.filter(F.transform(F.regexp_extract_all(x, F.lit(p), F.lit(1)), lambda y: y.cast("int")), _plausible), F.lit(0))
    return F.coalesce(*[every(x, p) for x in (name, _t(title), _t(original)) for p in FILE_YEARS])


def own_year(folder="subwork", title="title", path="relative_path", original="original_title", year="year", group="group_type") -> Column:
    """An item's year by TEXT_YEARS, each looked for once in a text: of a film first from its folder, title, path and original title, then the item's year, then the folder."""
    first = lambda x, p: F.regexp_extract(x, p, 1).try_cast("int")
    found = lambda x: [F.when(_plausible(first(x, p)), first(x, p)) for p in TEXT_YEARS]
    of_film = F.coalesce(*[y for c in (folder, title, path, original) for y in found(_t(c))])
    return F.coalesce(F.when(F.col(group) == "movie", of_film), F.when(_plausible(F.col(year)), F.col(year)), *found(_t(folder)))


def scrapable(items: DataFrame) -> DataFrame:
    """Taken items of TARGET_GROUPS, but for specials of films whose card has a film of its own. Needs card; a null card is ''."""
    some = items.where(taken() & F.col("group_type").isin(list(TARGET_GROUPS))).withColumn("card", _t("card"))
    extra = (F.col("group_type") == "special") & (_t("media_type") == "movie")
    films = some.where("group_type = 'movie'").select("plan", "card").distinct()
    return some.where(~extra).unionByName(some.where(extra).join(films, ["plan", "card"], "left_anti"))  # only extras are shuffled


def targets(items: DataFrame) -> DataFrame:
    """TARGET, target_id, scrape_type, place columns and what a target's items say together, one row a target.

    Needs besides the items' columns source, card, local_title, subwork (the
    folder of a work in a series or ''), file_year and own_year. Seasons and
    specials are apart by season number (a special's null is 0), films are not.
    work_id, first_year, card_type, media_type and show_type are the first item's.
    subwork is that of all items which have one, if it is the same, else ''.
    scrape_year is the smallest file_year of a season's items, else the first
    item's own_year; without one the target needs review. episode_count counts
    distinct (season, episode or special number) of items with a number.
    group_place and season_place order targets within a series.
    """
    film = F.col("group_type") == "movie"
    season = F.when(film, None).when(F.col("group_type") == "special", F.coalesce("season_number", F.lit(0))).otherwise(F.col("season_number"))
    number = F.coalesce("episode_number", "special_number")
    rows = scrapable(items).withColumns({"_number": F.when(number.isNotNull(), F.struct(F.coalesce("season_number", season).alias("s"), number.alias("n"))), "_sub": F.nullif(_t("subwork"), F.lit(""))})
    rows = rows.withColumns({"season_number": season, **{c: _t(c) for c in ("source", "canonical_work_id", "series_group", "local_title")}})
    first = F.min_by(F.struct("work_id", F.col("year").alias("first_year"), "card_type", "media_type", "show_type", "own_year"), F.struct("position", "item_id")).alias("_first")
    made = rows.groupBy(*TARGET).agg(
        first,
        F.count("*").alias("item_count"),
        F.count_distinct("_number").alias("episode_count"),
        F.when(F.min("_sub") == F.max("_sub"), F.min("_sub")).alias("_sub"),
        F.min("file_year").alias("_file_year"),
        F.bool_or(F.coalesce("needs_review", F.lit(False))).alias("_review"),
    )
    kind = F.when(film, "movie").otherwise("tv")
    year = F.coalesce(F.when(F.col("group_type") == "season", F.col("_file_year")), F.col("_first.own_year"))
    shown = F.coalesce(F.nullif(F.col("season_number"), F.lit(0)).cast("string"), F.lit(""))
    digest = F.sha1(F.concat_ws(":", "source", "canonical_work_id", "series_group", "local_title", "group_type", shown, kind, "card"))
    place = F.create_map(*[F.lit(x) for pair in TARGET_GROUPS.items() for x in pair])[F.col("group_type")]
    return made.select(
        F.substring(digest, 1, 16).alias("target_id"),
        *TARGET,
        kind.alias("scrape_type"),
        *[F.col(f"_first.{c}").alias(c) for c in ("work_id", "first_year", "card_type", "media_type", "show_type")],
        F.coalesce("_sub", F.lit("")).alias("subwork"),
        year.alias("scrape_year"),
        (F.col("_review") | year.isNull()).alias("needs_review"),
        "item_count",
        "episode_count",
        place.alias("group_place"),
        F.coalesce(F.nullif(F.col("season_number"), F.lit(0)), F.lit(999)).alias("season_place"),
    )
