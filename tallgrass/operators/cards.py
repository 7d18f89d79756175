"""Cards of works: the summary that lists show, with artwork from the work, its seasons or the files in its folder, and exception ids.

Works have work_id (their key, not null), source, sources, dir_path, the artwork
fields poster_path, fanart_path and clearlogo_path, source_locations (a map from
source to episode_id and strm_path), and the arrays of structs seasons (the
artwork fields) and episodes (source, episode_id, strm_path, group_type,
episode_number). Null arrays and maps count as empty, null texts as ''. Other
columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallgrass.functions import paths

from .library import ordered_sources, source_rank

# File names of each kind of artwork, in order of preference.
ARTWORK = {
    "poster_path": ["poster.jpg", "poster.png", "poster.webp"],
    "fanart_path": ["fanart.jpg", "fanart.png", "fanart.webp", "backdrop.jpg", "backdrop.png", "backdrop.webp"],
    "clearlogo_path": ["clearlogo.png", "clearlogo.jpg", "clearlogo.webp", "logo.png", "logo.jpg", "logo.webp"],
}
# Fixed value: names of folders inside a work's own, whose artwork lies one folder up.
INNER = r"^(season .*|sps|sp|special|specials|op-ed|op_ed|s\d+)$"

_NAMES = [name for names in ARTWORK.values() for name in names]
_ENDS = ["\n", "\r\n", "\r", "\u0085", "\u2028", "\u2029"]  # line ends, before which a pattern's $ matches, too
_FOLDER = 1_000_000  # places of files in folders come after all of the work and its seasons


def _text(x) -> Column:
    return F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(""))


def _list(name: str) -> Column:
    """An array column without null elements; empty where it is null."""
    return F.filter(F.coalesce(F.col(name), F.array()), lambda x: x.isNotNull())


def _plain(path) -> Column:
    """A path without doubled or last slashes; only those that have some are rewritten."""
    short = F.regexp_replace(F.regexp_replace(_text(path), "/+", "/"), "/$", "")
    short = F.when((short == "") & F.startswith(_text(path), F.lit("/")), "/").otherwise(short)
    odd = F.contains(_text(path), F.lit("//")) | paths.basename(_text(path)).isin("", *_ENDS)
    return F.when(odd, short).otherwise(_text(path))


def _parent(path: Column) -> Column:
    above = F.substring(path, F.lit(1), F.length(path) - F.length(paths.basename(path)) - 1)
    return F.when((above == "") & F.startswith(path, F.lit("/")), "/").otherwise(above)


def _in(folder: Column, name: Column) -> Column:
    return F.when(folder == "", name).when(folder == "/", F.concat(folder, name)).otherwise(F.concat_ws("/", folder, name))


def _on_disk(works: DataFrame, files: DataFrame) -> DataFrame:
    """work_id, kind, place, path of existing files: a work's and its seasons' own references, and the first known name of each kind in its folders.

    Works ask for paths (their references) and for folders (their own and, of an
    inner one, the one above) and meet, in one equi-join, one row of each key: a
    number whose lowest bit says that the key is a file, and the next ones which
    of the known names lie in it as a folder. Paths are rewritten in columns, not in
    lambdas, which Spark would run uncompiled.
    """
    at, base = F.col("path"), paths.basename("path")
    listed = files.select(_plain("path").alias("path")).where("path <> ''").withColumn("base", base)
    bit = F.element_at(F.create_map(*[F.lit(x) for i, n in enumerate(_NAMES, 1) for x in (n, 1 << i)]), F.col("base"))
    both = F.when(F.col("base").isin(_NAMES), F.array(F.struct(at.alias("key"), F.lit(1).alias("bits")), F.struct(_parent(at).alias("key"), bit.alias("bits"))))
    held = listed.select(F.inline(F.coalesce(both, F.array(F.struct(at.alias("key"), F.lit(1).alias("bits")))))).groupBy("key").agg(F.bit_or("bits").alias("bits"))

    said = F.concat(F.array(F.struct(*ARTWORK)), F.transform(F.coalesce("seasons", F.array()), lambda s: F.struct(*(s[k].alias(k) for k in ARTWORK))))
    rows = works.select("work_id", "dir_path", F.posexplode(said).alias("place", "_of"))
    one = lambda kind, path: F.struct(F.lit(kind).cast("string").alias("kind"), path.alias("said"))
    own = [one(k, F.col(f"_of.{k}")) for k in ARTWORK]
    asked = rows.select("work_id", "place", F.inline(F.array(*own, one(None, F.when(F.col("place") == 0, F.col("dir_path"))))))
    asked = asked.where((_text("said") != "") & (F.col("kind").isNull() | ~F.regexp_like("said", F.lit("(?i)^https?://"))))
    asked = asked.withColumn("key", _plain("said"))
    inner = F.col("kind").isNull() & F.regexp_like(F.lower(paths.basename("key")), F.lit(INNER))
    level = lambda n, key: F.struct((F.col("place") + n).alias("place"), F.coalesce(F.when(F.col("kind").isNull(), key), F.col("said")).alias("said"), key.alias("key"))
    asked = asked.select("work_id", "kind", F.inline(F.when(inner, F.array(level(0, F.col("key")), level(1, _parent(F.col("key"))))).otherwise(F.array(level(0, F.col("key"))))))
    met = asked.join(held, "key").where(F.col("kind").isNull() | (F.col("bits") % 2 == 1))

    def first(k: str) -> Column:
        """Path of a kind's first known name in a folder; null where it has none."""
        name = F.lit(None).cast("string")
        for n in reversed(ARTWORK[k]):
            name = F.when(F.col("bits").bitwiseAND(1 << 1 + _NAMES.index(n)) != 0, n).otherwise(name)
        return F.when(name.isNotNull(), _in(F.col("said"), name))

    def known(k: str) -> Column:
        return F.struct(F.lit(k).alias("kind"), (F.col("place") + _FOLDER).alias("place"), first(k).alias("path"))

    of_folder = F.array(*map(known, ARTWORK))
    each = met.select("work_id", F.inline(F.when(F.col("kind").isNull(), of_folder).otherwise(F.array(F.struct("kind", "place", F.col("said").alias("path"))))))
    return each.where("path IS NOT NULL")


def with_artwork(works: DataFrame, files: DataFrame) -> DataFrame:
    """Works with each artwork field filled in, and local_<field>, the artwork that lies on disk ('' where none does).

    A field is the work's own reference, else that of the first season that has
    one, else the first known name in the work's folder, else, of an inner
    folder, in the one above. local_<field> is the first of these that exists
    among files (path; nulls and repeats count for nothing); web addresses don't.
    """
    best = lambda k, among: F.min(F.when((F.col("kind") == k) & among, F.struct("place", "path")))["path"]
    found = _on_disk(works, files).groupBy("work_id")
    found = found.agg(*[best(k, F.lit(True)).alias(f"local_{k}") for k in ARTWORK], *[best(k, F.col("place") >= _FOLDER).alias(f"_in_{k}") for k in ARTWORK])
    joined = works.join(found, "work_id", "left")
    said = lambda k: F.coalesce(F.nullif(_text(k), F.lit("")), F.get(F.filter("seasons", lambda s: _text(s[k]) != ""), F.lit(0))[k], F.col(f"_in_{k}"), F.lit(""))
    return joined.withColumns({k: said(k) for k in ARTWORK} | {f"local_{k}": _text(f"local_{k}") for k in ARTWORK}).drop(*[f"_in_{k}" for k in ARTWORK])


def summaries(works: DataFrame, files: DataFrame) -> DataFrame:
    """The cards that lists show: works with their artwork, counts of episodes and ids by source in place of the episodes.

    Adds episode_count, main_episode_count (those of group 'season'),
    latest_episode_number (the largest of these, 0 where none has a number) and
    source_episode_ids; sources without any are the source itself.
    """
    main = F.filter(_list("episodes"), lambda e: e["group_type"] == "season")
    ids = F.map_filter(F.transform_values(F.coalesce("source_locations", F.create_map().cast("map<string,struct<episode_id:string,strm_path:string>>")), lambda _, at: F.coalesce(at["episode_id"], F.lit(""))), lambda _, v: v != "")
    counted = {
        "episode_count": F.array_size(_list("episodes")),
        "main_episode_count": F.array_size(main),
        "latest_episode_number": F.coalesce(F.array_max(F.transform(main, lambda e: e["episode_number"])), F.lit(0)),
        "source_episode_ids": ids,
        "sources": F.when(F.coalesce(F.size("sources"), F.lit(0)) > 0, F.col("sources")).otherwise(F.array("source")),
    }
    return with_artwork(works, files).withColumns(counted).drop("episodes")


def best_locations(works: DataFrame, key: str = "work_id") -> DataFrame:
    """key, source, episode_id, strm_path, place (from 0): each source's first location over all works of a key, sources in order of preference.

    Candidates are source_locations and the episodes; those without a source,
    an id or a path don't count. First is the smallest (episode_id, path without
    case, path). Each task keeps one candidate for each key and source before the shuffle.
    """
    of_map = F.transform(F.map_entries("source_locations"), lambda e: F.struct(e["key"].alias("source"), e["value"]["episode_id"].alias("episode_id"), e["value"]["strm_path"].alias("strm_path")))
    of_episodes = F.transform(_list("episodes"), lambda e: F.struct(e["source"].alias("source"), e["episode_id"].alias("episode_id"), e["strm_path"].alias("strm_path")))
    each = works.select(key, F.inline(F.concat(F.coalesce(of_map, F.array()), of_episodes))).where((_text("source") != "") & (_text("episode_id") != "") & (_text("strm_path") != ""))
    first = each.groupBy(key, "source").agg(F.min(F.struct("episode_id", F.lower("strm_path").alias("folded"), "strm_path")).alias("_at"))
    together = first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(source_rank("source").alias("rank"), F.col("source"), F.col("_at")))).alias("_all"))  # a row for each source of a key
    return together.select(key, F.posexplode("_all").alias("place", "_one")).select(key, F.col("_one.source").alias("source"), F.col("_one._at.episode_id").alias("episode_id"), F.col("_one._at.strm_path").alias("strm_path"), "place")


def all_sources(works: DataFrame) -> DataFrame:
    """work_id, sources: every source that a work, its locations or its episodes name, in order of preference."""
    every = F.concat(F.array(_text("source")), F.coalesce("sources", F.array().cast("array<string>")), F.coalesce(F.map_keys("source_locations"), F.array().cast("array<string>")), F.transform(_list("episodes"), lambda e: _text(e["source"])))
    return works.select("work_id", ordered_sources(F.filter(every, lambda s: s.isNotNull())).alias("sources"))


def exception_ids(bindings: DataFrame, reviews: DataFrame, failures: DataFrame, targets: DataFrame, cards: DataFrame) -> DataFrame:
    """work_id of the works that stay visible whatever their state, each once.

    bindings: work_id, attention_state, failed. Those that wait for review, whose
    source is away or of which a scrape failed name their work.
    reviews: plan_id, target_id, status. Pending ones name the cards of their target.
    failures: plan_id, target_id, work_id. They name the cards of their target;
    where it is no longer among the targets, their own work.
    targets: plan_id, target_id, item_id, one row an item; cards: plan_id,
    item_id, work_id, the work under which the library shows the item. An item without a card names none. Null keys
    match nothing.
    """
    bound = bindings.where(F.coalesce(F.col("attention_state").isin("waiting_review", "source_unavailable"), F.lit(False)) | (F.coalesce("failed", F.lit(0)) > 0)).select("work_id")
    shown = targets.join(cards, ["plan_id", "item_id"]).select("plan_id", "target_id", "work_id").distinct()
    key = ["plan_id", "target_id"]
    open_ = reviews.where("status = 'pending'").select(*key).unionByName(failures.select(*key)).distinct()
    of_target = open_.join(shown, key).select("work_id")
    lost = failures.join(targets.select(*key).distinct(), key, "left_anti").select("work_id")
    return bound.unionByName(of_target).unionByName(lost).where(F.coalesce(F.col("work_id").cast("string"), F.lit("")) != "").distinct()
