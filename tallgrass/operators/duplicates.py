"""Several files of one episode, several cards of one title: which file stays, which variant is shown, how titles are told apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallgrass.functions import media, text

from .preview import DUPLICATE_MARK, taken, unused

# What is said of the file that stays, of the others, in their titles, and of works without a season.
KEPT, SKIPPED, VERSION, SPECIALS = "已自动保留此版本", "已自动跳过重复版本", "重复版本", "特别篇"


def _t(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def resolved(items: DataFrame, score: Column | None = None) -> DataFrame:
    """Items of which, of several with one episode of a card, only the best stays; the others are ignored, without numbers.

    items: plan and item_id (their key), position, card, resource_type, action,
    group_type, season_number, episode_number, special_number, needs_review,
    title, warnings, and what media.keep_score reads (relative_path, work_title,
    original_title, is_extra); other columns pass through. Null cards are one
    card, null texts ''. Equal scores keep the first by position, then
    the greatest item_id. A
    warning says how many files there were, once. Items that are no numbered
    season episodes are never shuffled; the others are counted by episode first,
    and only episodes with several files come back.
    """
    numbered = taken() & (_t("group_type") == "season") & F.col("season_number").isNotNull() & F.col("episode_number").isNotNull()
    inside, card, files, best, drop = unused(items, "inside", "card", "files", "best", "drop")
    key = ["plan", card, "season_number", "episode_number"]
    rows = items.withColumns({inside: numbered, card: _t("card")})
    rank = F.struct((media.keep_score() if score is None else score).alias("score"), (-F.col("position")).alias("p"), F.struct(F.col("item_id")).alias("i"))
    some = rows.where(F.col(inside))
    several = some.groupBy(*key).agg(F.count("*").alias(files), F.max_by("item_id", rank).alias(best)).where(F.col(files) > 1)
    met = some.join(several, key, "left").withColumn(drop, F.coalesce(F.col("item_id") != F.col(best), F.lit(False)))
    said = F.concat(F.lit(f"{DUPLICATE_MARK}（"), F.col(files).cast("string"), F.lit(" 个），"), F.when(F.col(drop), SKIPPED).otherwise(KEPT))
    before = F.coalesce("warnings", F.array().cast("array<string>"))
    number = lambda c: F.format_string("%02d", F.col(c))
    name = F.concat(F.lit("S"), number("season_number"), F.lit("E"), number("episode_number"), F.lit(f" {VERSION}"))
    changed = {
        "warnings": F.when(F.col(files).isNull() | F.array_contains(before, said), F.col("warnings")).otherwise(F.array_append(before, said)),
        "title": F.when(F.col(drop) & (_t("title") == ""), name).otherwise(F.col("title")),
        "action": F.when(F.col(drop), "ignore").otherwise(F.col("action")),
        "group_type": F.when(F.col(drop), "ignored").otherwise(F.col("group_type")),
        "needs_review": F.when(F.col(drop), False).otherwise(F.col("needs_review")),
    } | {c: F.when(~F.col(drop), F.col(c)) for c in ("season_number", "episode_number", "special_number")}
    return met.withColumns(changed).select(items.columns).unionByName(rows.where(~F.col(inside)).select(items.columns))


def variant_order() -> Column:
    """Struct whose minimum is the variant of an episode to show: one from a folder that is no numbered copy, then by path without case or doubled slashes."""
    label = text.one_spaced(F.coalesce(F.nullif(_t("work_title"), F.lit("")), _t("series_group")))
    return F.struct(label.rlike(r"[（(]\d+[)）]\s*$").alias("copy"), F.lower(F.regexp_replace(_t("real_path"), "/+", "/")).alias("path"))


def shown_variants(items: DataFrame, keys: list[str]) -> DataFrame:
    """keys, item_id, variants: each episode's variant to show and how many it has; equal paths by item_id."""
    return items.groupBy(*keys).agg(F.min_by("item_id", F.struct(variant_order().alias("o"), F.struct(F.col("item_id")).alias("i"))).alias("item_id"), F.count("*").alias("variants"))


def _compact(x: Column) -> Column:
    return F.lower(F.regexp_replace(x, r"\s+", ""))


def split_label() -> Column:
    """How a work is told from others of its title: the label of its only season (its number without one), specials without any season, else ''."""
    listed = F.filter(F.coalesce("seasons", F.array()), lambda s: s.isNotNull())
    main = F.filter(listed, lambda s: s["group_type"] == "season")
    only = F.get(main, F.lit(0))
    named = F.coalesce(F.nullif(only["label"], F.lit("")), F.concat(F.lit("第"), only["season_number"].cast("string"), F.lit("季")), F.lit(""))
    special = F.exists(listed, lambda s: F.coalesce(s["group_type"].isin("special", "sps"), F.lit(False)))
    return F.when(F.size(main) == 1, named).when((F.size(main) == 0) & special, SPECIALS).otherwise("")


def split_titles(works: DataFrame) -> DataFrame:
    """Works whose titles say which season they are, where several local series in seasons have one title (without case and white space).

    works: work_id, title, source, card_type, media_type, seasons (array of
    structs with group_type, label, season_number); other columns pass through.
    A title that already names its season stays, so do empty ones. Titles are
    counted first; other works than local series are never shuffled.
    """
    local = F.coalesce((F.col("source") == "local") & (F.col("card_type") == "main_series") & (F.col("media_type") == "tv"), F.lit(False)) & (_t("title") != "")
    same, cards = unused(works, "same", "cards")
    rows = works.withColumn(same, F.when(local, _compact(_t("title"))))
    some = rows.where(F.col(same).isNotNull())
    several = some.groupBy(same).agg(F.count("*").alias(cards)).where(F.col(cards) > 1)
    label = split_label()
    season = F.regexp_extract(label, r"^第(\d+)季", 1)
    pattern = F.concat(F.lit(r"(?iU)(?:S0*"), season, F.lit(r"\b|Season\s*0*"), season, F.lit(r"\b|第\s*"), season, F.lit(r"\s*季)"))
    says = F.contains(F.col(same), _compact(label)) | ((season != "") & F.regexp_like("title", pattern))
    met = some.join(several, same, "left")
    titled = met.withColumn("title", F.when(F.col(cards).isNotNull() & (label != "") & ~says, F.concat_ws(" ", F.col("title"), label)).otherwise(F.col("title")))
    return titled.select(works.columns).unionByName(rows.where(F.col(same).isNull()).select(works.columns))
