"""Merge of nested works: cards of several sources that are one series become one card.

A work holds WORK's columns and may hold more, which go. Null arrays and maps
count as empty, null texts as ''. A work's key is its seasonal identity (the
smallest (type, id) of its seasons, else its work_id), else for the parts of a
mirrored series its source and the folder above its season's folder, else its
source and work_id. A work that is alone in its key keeps its episodes and
seasons as they are.

Merging is an aggregate: each field takes its first non-empty value by (source
preference, work_id), nested rows are unions by their own keys. So any order of
the works, and any split of them over tasks, gives one result; folding works two
by two in the order of arrival does not, as a field once filled hides better
ones. Only the choice among works of equal (source, work_id) goes by `position`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.operators.library import STATES, ordered_sources, source_rank

EPISODE = "struct<episode_id:string,group_type:string,season_number:int,episode_number:int,kind:string,title:string,source:string,strm_path:string>"
SEASON = "struct<group_type:string,season_number:int,title:string,scraped:boolean,tmdb_id:string,tmdb_type:string,episode_count:int>"
PLACE = "struct<episode_id:string,strm_path:string>"
TEXTS = ["title", "original_title", "plot", "poster_path", "fanart_path", "clearlogo_path", "dir_path"]
LISTS = ["genres", "studios", "cast", "tags", "related_works"]
OWN = ["source", "card_type", "media_type", "import_scope"]
WORK = {
    "work_id": "string",
    **dict.fromkeys(OWN + TEXTS, "string"),
    **dict.fromkeys(LISTS, "array<string>"),
    "rating": "double",
    "last_played": "string",
    "metadata_state": "string",
    "sources": "array<string>",
    "source_locations": f"map<string,{PLACE}>",
    "source_episode_counts": "map<string,int>",
    "episodes": f"array<{EPISODE}>",
    "seasons": f"array<{SEASON}>",
}

# Fixed value: names of folders that hold one season.
SEASON_FOLDER = r"(?i)^(?:Season\s*\d+|S\d+|SPs)$"


def _some(x: Column) -> Column:
    return F.coalesce(x, F.lit("")) != ""


def _read(works: DataFrame, *more: Column) -> DataFrame:
    """WORK's columns in their types, without nulls where an empty value says the same; absent ones are empty. `more` columns stay beside them."""

    def one(name: str, kind: str) -> Column:
        value = F.col(name).cast(kind) if name in works.columns else F.lit(None).cast(kind)
        if kind == "string":
            return F.coalesce(value, F.lit(""))
        if kind.startswith("array"):
            return F.coalesce(value, F.array().cast(kind))
        return F.coalesce(value, F.from_json(F.lit("{}"), kind)) if kind.startswith("map") else value

    return works.select(*(one(n, k).alias(n) for n, k in WORK.items()), *more)


def _joined(*parts) -> Column:
    return F.concat_ws("\x1f", *(F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("")) for p in parts))


def seasonal_identity() -> Column:
    """The key of a seasonal work; null for others, and for those with neither an id of a season nor a work_id."""
    named = F.filter("seasons", lambda s: _some(s["tmdb_id"]))
    kind = lambda s: F.when(_some(s["tmdb_type"]), s["tmdb_type"]).when(F.col("media_type") != "", F.col("media_type")).otherwise("tv")
    first = F.array_min(F.transform(named, lambda s: F.struct(kind(s).alias("t"), s["tmdb_id"].alias("id"))))
    key = F.when(first.isNotNull(), _joined("seasonal", "tmdb", first["t"], first["id"])).when(F.col("work_id") != "", _joined("seasonal", "canonical", F.col("work_id")))
    return F.when(F.col("import_scope") == "seasonal", key)


def mirror_identity() -> Column:
    """The key of a mirrored series' season; null for others."""
    path = F.regexp_replace("dir_path", "/+$", "")
    above = F.regexp_replace(path, "/*[^/]*$", "")
    above = F.when(above != "", F.lower(above)).otherwise(F.when(path.startswith("/"), "/").otherwise("."))
    series = (F.col("source") != "local") & (F.col("card_type") == "main_series") & F.col("media_type").isin("", "tv") & F.regexp_extract(path, "([^/]*)$", 1).rlike(SEASON_FOLDER)
    return F.when(series, _joined("mirror-series", F.col("source"), above))


def identity() -> Column:
    return F.coalesce(seasonal_identity(), mirror_identity(), _joined("directory", F.col("source"), F.col("work_id")))


def _parts() -> Column:
    """What a work says of each of its sources, by preference: (source, named, place, n)."""
    at = lambda e: F.when(_some(e["source"]), e["source"]).otherwise(F.col("source"))
    place = lambda x: F.when(_some(x["episode_id"]) & _some(x["strm_path"]), F.struct(x["episode_id"].alias("episode_id"), F.lower(x["strm_path"]).alias("low"), x["strm_path"].alias("strm_path")))
    named = F.concat(F.when(F.size(F.filter("sources", _some)) > 0, F.col("sources")).otherwise(F.array("source")), F.transform("episodes", lambda e: e["source"]))
    places = F.concat(
        F.transform(F.map_entries("source_locations"), lambda x: F.struct(x["key"].alias("s"), place(x["value"]).alias("p"))),
        F.transform("episodes", lambda e: F.struct(e["source"].alias("s"), place(e).alias("p"))),
    )
    held = F.struct(named.alias("named"), places.alias("places"), F.transform("episodes", at).alias("seen"))

    def parts(held: Column) -> Column:
        named, places, seen = held["named"], held["places"], held["seen"]
        every = ordered_sources(F.concat(named, F.transform(places, lambda x: F.when(x["p"].isNotNull(), x["s"])), F.map_keys("source_episode_counts"), seen))

        def part(s: Column) -> Column:
            counted, visible = F.element_at("source_episode_counts", s), F.size(F.filter(seen, lambda x: x == s))
            n = F.when(F.map_contains_key("source_episode_counts", s) | (visible > 0), F.greatest(F.lit(0), F.coalesce(counted, F.lit(0)), visible))
            own = F.array_min(F.transform(F.filter(places, lambda x: (x["s"] == s) & x["p"].isNotNull()), lambda x: x["p"]))
            return F.struct(source_rank(s).alias("r"), s.alias("source"), F.array_contains(F.filter(named, lambda x: x.isNotNull()), s).alias("named"), own.alias("place"), n.alias("n"))

        return F.transform(F.filter(every, lambda s: s.isNotNull()), part)

    # A work's lists are built once and not anew for each of its sources.
    return F.transform(F.array(held), parts)[0]


def _of_parts(parts: str) -> dict[str, Column]:
    where = F.filter(parts, lambda p: p["place"].isNotNull())
    counted = F.filter(parts, lambda p: p["n"].isNotNull())
    return {
        "sources": F.transform(F.filter(parts, lambda p: p["named"]), lambda p: p["source"]),
        "source_locations": F.map_from_entries(F.transform(where, lambda p: F.struct(p["source"], F.struct(p["place"]["episode_id"].alias("episode_id"), p["place"]["strm_path"].alias("strm_path"))))),
        "source_episode_counts": F.map_from_entries(F.transform(counted, lambda p: F.struct(p["source"], p["n"].cast("int")))),
    }


def _recounted(seasons: Column, episodes: str) -> Column:
    """Seasons with their number of episodes: of group 'special' for 'special' and 'sps', of group 'season' for others."""

    def one(s: Column) -> Column:
        group = F.when(s["group_type"].isin("special", "sps"), "special").otherwise("season")
        return s.withField("episode_count", F.size(F.filter(episodes, lambda e: (e["group_type"] == group) & e["season_number"].eqNullSafe(s["season_number"]))))

    return F.transform(seasons, one)


def _other_group(x: Column) -> Column:
    return ~F.coalesce(x["group_type"].isin("season", "special"), F.lit(False))


def deduplicated(works: DataFrame, position: Column, cut: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """kind ('seasonal', 'mirror-series' or 'directory') and WORK's columns, one row of each key.

    Seasonal works and parts of mirrored series are merged. Of works of equal
    (source, work_id) the most complete one counts (episodes, the seasons'
    counts, seasons), the last of equal ones; where it was never played, the
    last played one of those that it took over from tells. A mirrored series
    takes work_id, texts and rating from its first part with a numbered season.
    Sources, places and counts of every work are told anew from what it holds.
    An empty table gives an empty one. The works with their keys and parts are
    read several times; `cut` can end their lineage there, so that they are made once.
    """
    rows = _read(works, position.alias("_at")).withColumn("key", identity())
    rows = rows.withColumn("kind", F.substring_index("key", "\x1f", 1))
    group = Window.partitionBy("key")
    # Both windows and the split below share one shuffle of the works.
    sizes = F.struct(F.size("episodes"), F.aggregate("seasons", F.lit(0), lambda n, s: n + F.coalesce(s["episode_count"], F.lit(0))), F.size("seasons"))
    rows = rows.withColumn("_size", sizes)
    rows = rows.withColumns({"_of": F.count("*").over(group), "_most": F.max("_size").over(group.orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))})
    took = F.when(F.col("_size") == F.col("_most"), F.col("_at"))
    rows = rows.withColumns({"_last": F.max(took).over(group), "_played": F.max_by("last_played", F.when(F.col("last_played") != "", took)).over(group)})
    rows = rows.withColumn("parts", _parts())
    rows = cut(rows) if cut else rows
    merges = (F.col("kind") != "directory") & (F.col("_of") > 1)
    alone = rows.where(~merges & ((F.col("kind") != "directory") | (F.col("_at") == F.col("_last"))))
    alone = alone.withColumns({"last_played": F.when(F.col("kind") == "directory", F.coalesce("_played", F.lit(""))).otherwise(F.col("last_played"))})
    columns = ["kind", *WORK]
    return alone.withColumns(_of_parts("parts")).select(*columns).unionByName(_merged(rows.where(merges)).select(*columns))


def _merged(rows: DataFrame) -> DataFrame:
    """One work of each key of rows (kind, key, parts, _at, WORK), every step an aggregate that tasks begin before the shuffle."""
    numbered = F.exists("seasons", lambda s: (s["group_type"] == "season") & (s["season_number"] > 0))
    rows = rows.withColumn("order", F.struct(source_rank("source").alias("r"), "work_id", "_at"))
    rows = rows.withColumn("lead", F.when(F.col("kind") == "seasonal", F.col("order")).otherwise(F.struct(F.when(numbered, 0).otherwise(1).alias("r"), "work_id", "_at")))
    rank = F.lit(len(STATES) - 1)
    for i, s in enumerate(STATES):
        rank = F.when(F.col("metadata_state") == s, i).otherwise(rank)
    rated = F.when(F.col("rating") != 0, F.col("order"))
    heads = rows.groupBy("kind", "key").agg(
        F.min_by(F.struct(*OWN), "order").alias("own"),
        F.min_by(F.struct("work_id", "rating", *TEXTS), "lead").alias("first"),
        *(F.min_by(c, F.when(F.col(c) != "", F.col("order"))).alias(c) for c in TEXTS),
        *(F.min_by(c, F.when(F.size(c) > 0, F.col("order"))).alias(c) for c in LISTS),
        F.min_by("rating", rated).alias("rating"),
        F.max("last_played").alias("last_played"),
        F.element_at(F.array(*map(F.lit, STATES)), F.min(rank) + 1).alias("metadata_state"),
    )
    parts = rows.select("key", F.explode("parts").alias("p")).groupBy("key", "p.r", "p.source").agg(F.bool_or("p.named").alias("named"), F.min("p.place").alias("place"), F.max("p.n").alias("n"))
    parts = parts.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("r", "source", "named", "place", "n"))).alias("parts"))

    e = rows.select("key", "order", F.explode("episodes").alias("e"))
    loose = F.when(F.coalesce("e.episode_number", F.lit(0)) <= 0, F.struct("e.kind", "e.title", "e.episode_id"))
    chosen = F.struct(source_rank("e.source").alias("r"), F.coalesce("e.episode_id", F.lit("")).alias("id"), "order")
    e = e.groupBy("key", "e.group_type", "e.season_number", "e.episode_number", loose.alias("loose")).agg(F.min_by("e", chosen).alias("e"))
    place = F.struct(_other_group(F.col("e")).alias("g"), F.col("e.season_number").alias("s"), F.col("e.episode_number").alias("n"), F.col("e.title").alias("t"), F.col("e.episode_id").alias("i"), F.col("e"))
    e = e.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(place)), lambda x: x["e"]).alias("episodes"))

    s = rows.select("key", "order", F.posexplode("seasons").alias("i", "s"))
    fuller = F.struct(~F.coalesce("s.scraped", F.lit(False)), ~_some(F.col("s.tmdb_id")), -F.coalesce("s.episode_count", F.lit(0)), "order", "i")
    s = s.groupBy("key", "s.group_type", "s.season_number").agg(F.min_by(F.struct("order", "i", "s"), fuller).alias("x"), F.min(F.struct("order", "i")).alias("seen"))
    place = F.struct(_other_group(F.col("x.s")).alias("g"), F.col("x.s.season_number").alias("n"), F.col("seen"), F.col("x.s").alias("s"))
    s = s.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(place)), lambda x: x["s"]).alias("seasons"))

    whole = heads.join(parts, "key", "left").join(e, "key", "left").join(s, "key", "left")
    empty = lambda c: F.coalesce(c, F.array().cast(WORK[c])).alias(c)
    text = lambda c: F.when(F.col("kind") == "seasonal", F.coalesce(c, F.lit(""))).otherwise(F.coalesce(F.when(F.col(f"first.{c}") != "", F.col(f"first.{c}")), c, F.lit(""))).alias(c)
    rating = F.coalesce(F.when((F.col("kind") != "seasonal") & (F.col("first.rating") != 0), F.col("first.rating")), "rating")
    whole = whole.select("key", "kind", F.col("first.work_id").alias("work_id"), "own.*", *map(text, TEXTS), *map(empty, LISTS), rating.alias("rating"), "last_played", "metadata_state", "parts", empty("episodes"), empty("seasons"))
    return whole.withColumn("seasons", _recounted(F.col("seasons"), "episodes")).withColumns(_of_parts("parts"))


def without(works: DataFrame, source: str) -> DataFrame:
    """WORK's columns without what one source gave. Works that it has no part in stay as they are; of others its episodes, place and count go and seasons without an episode left; works without episodes and places left go themselves. Columns that WORK doesn't know stay."""
    more = [F.col(c) for c in works.columns if c not in WORK]
    rows = _read(works, *more)
    of = lambda e: F.when(_some(e["source"]), e["source"]).otherwise(F.col("source"))
    named = F.when(F.size("sources") > 0, F.col("sources")).otherwise(F.array("source"))
    part = F.array_contains(named, source) | F.exists("episodes", lambda e: of(e) == source)
    rows = rows.withColumns({"_part": part, "_kept": F.filter("episodes", lambda e: of(e) != source), "_all": _parts()})
    other = lambda x: x != source
    places = F.map_filter("source_locations", lambda k, _: k != source)
    left = F.filter(ordered_sources(F.concat(named, F.transform("_kept", lambda e: e["source"]))), other)
    left = ordered_sources(F.concat(left, F.map_keys(places)))
    counted = F.filter(F.filter("_all", lambda p: p["n"].isNotNull()), lambda p: p["source"] != source)
    counts = F.map_from_entries(F.transform(counted, lambda p: F.struct(p["source"], p["n"].cast("int"))))
    seasons = F.filter(_recounted(F.col("seasons"), "_kept"), lambda s: s["episode_count"] > 0)
    changed = {"source": F.when((F.col("source") == source) & (F.size(left) > 0), left[0]).otherwise(F.col("source")), "sources": left, "source_locations": places, "source_episode_counts": counts, "episodes": F.col("_kept"), "seasons": seasons}
    rows = rows.where(~F.col("_part") | (F.size("_kept") > 0) | (F.size(places) > 0))
    names = [*WORK, *(c for c in works.columns if c not in WORK)]
    return rows.select(*(F.when(F.col("_part"), changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in names))


def replaced_source(existing: DataFrame, rebuilt: DataFrame, source: str, position: str) -> DataFrame:
    """A library in which a source is built anew: what it gave goes, its new works come in, and its seasonal works that were not built again stay. Columns as `deduplicated` gives them."""
    kept = without(existing, source).select(*WORK, F.struct(F.lit(0).alias("part"), F.col(position).alias("at")).alias("_p"))
    new = _read(rebuilt, F.struct(F.lit(1).alias("part"), F.col(position).alias("at")).alias("_p"))
    seasonal = existing.where((F.col("import_scope") == "seasonal") & (F.col("source") == source))
    seasonal = _read(seasonal, F.struct(F.lit(2).alias("part"), F.col(position).alias("at")).alias("_p"))
    stay = seasonal.join(new.select("source", "work_id").distinct(), ["source", "work_id"], "left_anti")
    return deduplicated(kept.unionByName(new).unionByName(stay), F.col("_p"))
