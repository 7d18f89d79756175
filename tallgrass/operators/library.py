"""Library reads: predicates, summaries, dedup with merge, likeness and showcase.

Works have work_id (their key), title, original_title, source, sources (array),
media_type, card_type, import_scope, state, complete, rating, year and more,
named where used. Null arrays count as empty, null texts as ''. Ties always end
in work_id, so results are the same at every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Sources in order of preference, the rest by name; states by rank.
SOURCES = ["pan115", "baidu", "local", "openlist"]
STATES = ["ready", "waiting_review", "source_unavailable", "waiting_metadata"]
# Related works: ids of one pack, works of one key to a slice of it, slices of one key at most, ids of one block.
PACK, SLICE, SLICES, BLOCK = 512, 4096, 16, 256


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def source_rank(source) -> Column:
    rank = F.lit(99)
    for i, s in enumerate(SOURCES):
        rank = F.when(_c(source) == s, i).otherwise(rank)
    return rank


def ordered_sources(sources) -> Column:
    """Distinct non-empty sources by preference, then by name."""
    some = F.array_distinct(F.filter(F.coalesce(_c(sources), F.array().cast("array<string>")), lambda s: s != ""))
    return F.transform(F.sort_array(F.transform(some, lambda s: F.struct(source_rank(s).alias("r"), s.alias("s")))), lambda x: x["s"])


def of_source(source, sources, wanted: str) -> Column:
    """Whether the main source or one of the sources is `wanted`; 'all' and '' take every row."""
    if wanted in ("", "all"):
        return F.lit(True)
    return F.coalesce((_c(source) == wanted) | F.array_contains(F.coalesce(_c(sources), F.array().cast("array<string>")), wanted), F.lit(False))


def is_seasonal(scope, tracking) -> Column:
    """Tracked works are seasonal until completed or archived; others by their import scope."""
    return F.when(_c(tracking).isin("completed", "archived"), False).when(_c(tracking).isin("tracking", "paused"), True).otherwise(F.coalesce(_c(scope) == "seasonal", F.lit(False)))


def in_category(show_type, seasonal: Column, view: str) -> Column:
    """The category view: 'seasonal' takes seasonal works, anime series without them, other views by show type."""
    if view == "seasonal":
        return seasonal
    same = F.coalesce(_c(show_type) == view, F.lit(False))
    return same & ~seasonal if view == "anime_series" else same


def matching(works: DataFrame, q: str = "", source: str = "all", media_type: str = "", card_type: str = "") -> DataFrame:
    """Works whose title or original title holds q (without case), of a source, media type and card type; '' takes all."""
    keep = of_source("source", "sources", source)
    if q.strip():
        word = q.strip().lower()
        keep &= F.coalesce(F.lower("title").contains(word), F.lit(False)) | F.coalesce(F.lower("original_title").contains(word), F.lit(False))
    for name, value in (("media_type", media_type), ("card_type", card_type)):
        if value:
            keep &= F.coalesce(F.col(name) == value, F.lit(False))
    return works.where(keep)


def visible(works: DataFrame, exceptions: DataFrame, version: int = 2) -> DataFrame:
    """Works that wait for review, whose source is away, that are ready, or that exceptions (work_id) name. Of an index before version 2 ready ones must be complete, too."""
    named = exceptions.select("work_id").distinct().withColumn("_named", F.lit(True))
    shown = F.col("state").isin("waiting_review", "source_unavailable") | ((F.col("state") == "ready") & (F.lit(True) if version >= 2 else F.col("complete")))
    return works.join(named, "work_id", "left").where(F.coalesce(F.col("_named"), shown, F.lit(False))).drop("_named")


def with_watch_status(works: DataFrame, statuses: DataFrame, wanted: str) -> DataFrame:
    """Works of one watch status (work_id, status); 'empty' takes those without one."""
    rows = works.join(statuses.groupBy("work_id").agg(F.max("status").alias("_s")), "work_id", "left")
    return rows.where(F.coalesce("_s", F.lit("")) == ("" if wanted == "empty" else wanted)).drop("_s")


def searched(works: DataFrame, q: str, recent: DataFrame, source: str = "all") -> DataFrame:
    """work_id, recent_rank, rating of a source's works whose title, original title and related titles (array), joined by spaces, hold q without case: recent ones (work_id, recent_rank) first, then by rating. A blank q finds nothing."""
    word = q.strip().lower()
    full = lambda c: F.nullif(F.col(c), F.lit(""))
    related = F.filter(F.coalesce("related_titles", F.array().cast("array<string>")), lambda t: t != "")
    text = F.lower(F.concat_ws(" ", full("title"), full("original_title"), F.array_join(related, " ")))
    found = works.where(of_source("source", "sources", source) & text.contains(word)) if word else works.limit(0)
    order = [F.coalesce("recent_rank", F.lit((1 << 31) - 1)).asc(), F.coalesce("rating", F.lit(0.0)).desc(), F.col("work_id").asc()]
    return found.join(recent, "work_id", "left").orderBy(*order).select("work_id", "recent_rank", "rating")


def main_episodes(direct, seasons, episodes) -> Column:
    """Main episodes of a work: its own count if positive, else the sum of episode_count over its seasons of type 'season', else the number of its episodes of that type."""
    main = lambda xs: F.filter(_c(xs), lambda s: s["group_type"] == "season")
    total = F.aggregate(main(seasons), F.lit(0).cast("long"), lambda n, s: n + F.coalesce(s["episode_count"].cast("long"), F.lit(0).cast("long")))
    return F.when(_c(direct) > 0, _c(direct).cast("long")).when(total > 0, total).otherwise(F.coalesce(F.array_size(main(episodes)), F.lit(0)).cast("long"))


def source_summary(works: DataFrame) -> DataFrame:
    """Per source: works, episodes, posters, fanarts and scraped works, a work counting for each of its sources."""
    each = works.withColumn("_source", F.explode(F.when(F.size(ordered_sources("sources")) > 0, ordered_sources("sources")).otherwise(F.array("source"))))
    has = lambda x: F.count_if(F.coalesce(x, F.lit("")) != "")
    return each.groupBy(F.col("_source").alias("source")).agg(F.count("*").alias("works"), F.sum(F.coalesce("n_episodes", F.lit(0))).alias("episodes"), has("poster").alias("posters"), has("fanart").alias("fanarts"), F.count_if(F.col("state") == "ready").alias("scraped"))


def sort_key(order: str) -> list[Column]:
    """Order by title, rating or year, either way; a null year is 9999 upwards and 0 downwards, a null rating 0. Ends in title and work_id."""
    year_up, year_down, rating = F.coalesce("year", F.lit(9999)), F.coalesce("year", F.lit(0)), F.coalesce("rating", F.lit(0.0))
    first = {"title": [], "titleDesc": [F.lower("title").desc()], "ratingDesc": [rating.desc()], "ratingAsc": [rating.asc()], "yearDesc": [year_down.desc()], "yearAsc": [year_up.asc()], "episodesDesc": [F.coalesce("n_episodes", F.lit(0)).desc()], "episodesAsc": [F.coalesce("n_episodes", F.lit(0)).asc()]}
    return [*first[order], F.lower("title").asc(), F.col("work_id").asc()]


def showcase(works: DataFrame, order: list[Column], featured: int = 5, side: int = 3) -> DataFrame:
    """work_id, part, slot: the first works are featured, the next fill the side slots, over and over where they are too few (the featured ones where none is left)."""
    top = works.orderBy(*order).limit(featured + side)
    placed = top.withColumn("_n", F.row_number().over(Window.orderBy(*order)) - 1)  # at most featured + side rows
    total = placed.agg(F.count("*").alias("_total"))
    placed = placed.crossJoin(F.broadcast(total)).withColumn("_first", F.least(F.lit(max(1, featured)), F.col("_total") - F.least(F.lit(side), F.col("_total") - 1)))
    main = placed.where("_n < _first").select("work_id", F.lit("featured").alias("part"), F.col("_n").cast("int").alias("slot"))
    pool = F.when(F.col("_total") > F.col("_first"), F.col("_total") - F.col("_first")).otherwise(F.col("_total"))
    base = F.when(F.col("_total") > F.col("_first"), F.col("_first")).otherwise(F.lit(0))
    slots = placed.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(max(side - 1, 0))))).where(F.col("_n") == base + F.col("slot") % pool)
    return main.unionByName(slots.where(F.lit(side > 0)).select("work_id", F.lit("side").alias("part"), F.col("slot").cast("int").alias("slot")))


def similar(works: DataFrame, most: int = 6) -> DataFrame:
    """work_id, other, score, place: for each work the `most` alike ones: 2 for the same show type and 3 for each shared tag.

    Columns: work_id, show_type, tags, rating. Works of equal tags and type are
    one class and score alike, so classes meet in place of works: by tag those
    that share one, by type only the best. Of a class's partners the first
    `most` + 1 by score and best work hold all that can be placed, and of each
    of these the first works.
    """
    nothing, k = F.array().cast("array<string>"), most + 1
    tags = F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce("tags", nothing), lambda t: F.lower(F.trim(t))), lambda t: t != "")))
    w = works.select("work_id", F.coalesce("show_type", F.lit("")).alias("type"), F.coalesce("rating", F.lit(0.0)).alias("rating"), tags.alias("tags"))
    w = w.withColumn("class", F.xxhash64("tags", "type"))
    in_class = F.row_number().over(Window.partitionBy("type", "tags").orderBy(F.col("rating").desc(), "work_id"))
    best = w.withColumn("_n", in_class).where(F.col("_n") <= k)
    classes = best.where("_n = 1").select("class", "type", "tags", F.col("rating").alias("top"), F.col("work_id").alias("first"))
    other = classes.select(*(F.col(c).alias(f"o_{c}") for c in ("class", "type", "top", "first")))
    each = classes.select("class", F.explode("tags").alias("tag"))
    shared = each.join(each.withColumnRenamed("class", "o_class"), "tag").groupBy("class", "o_class").agg((3 * F.count("*")).alias("points"))
    typed = classes.where("type != ''")
    first = typed.withColumn("_n", F.row_number().over(Window.partitionBy("type").orderBy(F.col("top").desc(), "first"))).where(F.col("_n") <= k)
    by_type = typed.select("class", "type").join(first.select("type", F.col("class").alias("o_class")), "type").select("class", "o_class", F.lit(0).cast("long").alias("points"))
    pairs = shared.unionByName(by_type).groupBy("class", "o_class").agg(F.max("points").alias("points")).join(classes.select("class", "type"), "class").join(other, "o_class")
    pairs = pairs.withColumn("score", F.col("points") + F.when((F.col("type") == F.col("o_type")) & (F.col("type") != ""), 2).otherwise(0)).where("score > 0")
    by_class = F.row_number().over(Window.partitionBy("class").orderBy(F.col("score").desc(), F.col("o_top").desc(), "o_first"))
    near = pairs.withColumn("_n", by_class).where(F.col("_n") <= k).select("class", "o_class", "score")
    partners = near.join(best.select(F.col("class").alias("o_class"), F.col("work_id").alias("other"), F.col("rating").alias("_r")), "o_class")
    ranked = F.row_number().over(Window.partitionBy("class").orderBy(F.col("score").desc(), F.col("_r").desc(), "other"))
    partners = partners.withColumn("_n", ranked).where(F.col("_n") <= k).groupBy("class").agg(F.sort_array(F.collect_list(F.struct("_n", "other", "score"))).alias("p"))  # at most `most` + 1 each
    own = w.join(partners, "class").select("work_id", F.slice(F.filter("p", lambda x: x["other"] != F.col("work_id")), 1, most).alias("p"))
    return own.select("work_id", F.posexplode("p").alias("i", "p")).select("work_id", "p.other", "p.score", (F.col("i") + 1).alias("place"))


def deduplicated(works: DataFrame, key: Column, completeness: list[Column], position: str) -> DataFrame:
    """The most complete work of each key; of equal ones the later by `position`. A null key is a key of its own."""
    best = Window.partitionBy(key).orderBy(*(c.desc() for c in completeness), F.col(position).desc())
    return works.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def first_non_empty(works: DataFrame, key: str, columns: list[str], order: list[Column]) -> DataFrame:
    """Per key each column's first value that is neither null nor '', in `order`."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    ranked = works.select(key, *columns, n.alias("_n"))
    pick = lambda c: F.min_by(c, F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.col("_n"))).alias(c)
    return ranked.groupBy(key).agg(*map(pick, columns))


def merged_state(works: DataFrame, key: str, state: str) -> DataFrame:
    """Per key the state of the highest rank: ready, waiting_review, source_unavailable, else waiting_metadata."""
    rank = F.lit(len(STATES) - 1)
    for i, s in enumerate(STATES):
        rank = F.when(F.col(state) == s, i).otherwise(rank)
    return works.groupBy(key).agg(F.element_at(F.array(*map(F.lit, STATES)), F.min(rank) + 1).alias(state))


def ready_works(targets: DataFrame, key: str, complete: Column) -> DataFrame:
    """Per key: whether it has targets and all are complete."""
    return targets.groupBy(key).agg(F.bool_and(F.coalesce(complete, F.lit(False))).alias("ready"), F.count("*").alias("targets"))


def merged_episodes(episodes: DataFrame) -> DataFrame:
    """One row of each (work_id, group_type, season, episode): of the preferred source, then the smallest episode_id. Episodes without a positive number stay each for itself."""
    own = F.when(F.coalesce("episode", F.lit(0)) > 0, F.lit("")).otherwise(F.col("episode_id").cast("string"))
    rank = Window.partitionBy("work_id", "group_type", "season", "episode", "_own").orderBy(source_rank("source"), "episode_id")
    return episodes.withColumn("_own", own).withColumn("_n", F.row_number().over(rank)).where("_n = 1").drop("_n", "_own")


def merged_seasons(seasons: DataFrame, episodes: DataFrame) -> DataFrame:
    """Per (work_id, group_type, season) the best row (scraped, with an id, most episodes, smallest title), its episodes counted anew: rows of group 'special' for groups 'special' and 'sps', of group 'season' for others."""
    order = F.struct(~F.coalesce("scraped", F.lit(False)), F.col("tmdb_id").isNull(), -F.coalesce("episode_count", F.lit(0)), F.col("title"))
    rows = seasons.groupBy("work_id", "group_type", "season").agg(F.min_by(F.struct("title", "scraped"), order).alias("b"))
    counted = episodes.groupBy("work_id", F.col("group_type").alias("_g"), "season").agg(F.count("*").alias("n"))
    rows = rows.withColumn("_g", F.when(F.col("group_type").isin("special", "sps"), "special").otherwise("season"))
    return rows.join(counted, ["work_id", "_g", "season"], "left").select("work_id", "group_type", "season", "b.title", "b.scraped", F.coalesce("n", F.lit(0)).alias("episode_count"))


def deduplicated_candidates(candidates: DataFrame) -> DataFrame:
    """Per (tmdb_id, tmdb_type) the candidate of the highest (score, popularity), the smallest candidate_id of equal ones, with all their titles; ids not positive stay as they are."""
    keyed = candidates.where("tmdb_id > 0")
    n = F.row_number().over(Window.partitionBy("tmdb_id", "tmdb_type").orderBy(F.col("score").desc(), F.col("popularity").desc(), "candidate_id"))
    titles = keyed.groupBy("tmdb_id", "tmdb_type").agg(F.array_sort(F.collect_set("title")).alias("titles"))
    best = keyed.withColumn("_n", n).where("_n = 1").drop("_n").join(titles, ["tmdb_id", "tmdb_type"])
    rest = candidates.where("tmdb_id IS NULL OR tmdb_id <= 0").withColumn("titles", F.array("title"))
    return best.unionByName(rest)


def best_artwork(images: DataFrame, key: str, score: Column, position: str) -> DataFrame:
    """Per key the image of the highest score, the first by position of equal ones."""
    best = Window.partitionBy(key).orderBy(F.col("_score").desc(), F.col(position).asc())
    return images.withColumn("_score", score).withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n").withColumnRenamed("_score", "score")


def without_source(works: DataFrame, source: str) -> DataFrame:
    """Works without what one source gave: its sources, episodes and counts; works of which nothing is left go. Columns: work_id, sources, episodes (structs with source), counts (map)."""
    left = works.withColumn("sources", F.filter("sources", lambda s: s != source)).withColumn("episodes", F.filter("episodes", lambda e: e["source"] != source))
    left = left.withColumn("counts", F.map_filter("counts", lambda k, v: k != source))
    return left.where((F.size("sources") > 0) | (F.size("episodes") > 0))


def with_slice(works: DataFrame, source: str, new: DataFrame) -> DataFrame:
    """A source's contribution taken out and its new works put in; new works take the place of equal work_ids."""
    return without_source(works, source).join(new.select("work_id"), "work_id", "left_anti").unionByName(new)


def best_counts(works: DataFrame, key: str, counts: str) -> DataFrame:
    """Per key a map of each source's largest count."""
    each = works.select(key, F.explode(counts).alias("s", "n")).groupBy(key, "s").agg(F.max("n").alias("n"))
    return each.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("s", "n")))).alias(counts))


def related(works: DataFrame, keys: str, cut=lambda rows: rows) -> DataFrame:
    """work_id, other, relation of works whose key arrays meet, and how many keys they share. A pair counts once, with the smallest of its relations.

    No pair is shuffled. Works of equal keys travel as packs of at most about
    PACK ids, and packs of a key lie in blocks of about BLOCK ids. A pack marks
    the blocks that hold works with which it shares a second key too; there
    packs meet one by one and give their pairs under the first shared key only.
    With every other block it shares this key alone, so ids meet at once.
    A key that many works have is dealt over up to SLICES tasks. `cut` stores
    what several readers take.
    """
    each = works.select("work_id", F.explode(keys).alias("k")).where("k.name != ''")
    own = each.groupBy("work_id").agg(F.array_sort(F.collect_set("k")).alias("keys")).where("work_id IS NOT NULL")
    sizes = own.groupBy("keys").agg(F.ceil(F.count("*") / PACK).alias("n"))
    packs = own.join(sizes, "keys").groupBy(F.xxhash64("keys").alias("hash"), F.pmod(F.xxhash64("work_id"), "n").alias("pack"), "keys").agg(F.min("work_id").alias("at"), F.collect_list("work_id").alias("ids"))
    packs = cut(packs.drop("hash", "pack"))
    n = F.sum(F.size("ids"))
    spread = packs.select(F.explode("keys").alias("k"), "ids").groupBy("k").agg(F.least(F.ceil(n / SLICE), F.lit(SLICES)).alias("slices"), F.ceil(n / BLOCK).alias("blocks"))
    met = packs.select("at", "ids", "keys", F.explode("keys").alias("k")).join(spread, "k")
    rest = F.filter("keys", lambda x: x != F.col("k"))
    met = met.select("k", "at", "ids", "keys", "slices", F.pmod(F.xxhash64("at"), "blocks").alias("block"), rest.alias("rest"))
    second = met.select("at", "k", "block", F.explode("rest").alias("second")).withColumn("hash", F.xxhash64("k", "second"))
    holding = second.groupBy("hash", "k", "second").agg(F.collect_set("block").alias("marks"))
    marks = second.join(holding, ["hash", "k", "second"]).groupBy("at", "k").agg(F.array_distinct(F.flatten(F.collect_list("marks"))).alias("marks"))
    bits = F.aggregate("rest", F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(x), F.lit(64)).cast("int"))))
    met = cut(met.withColumn("bits", bits).drop("rest").join(marks, ["at", "k"], "left"))

    parts = int(works.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one = met.select("k", F.pmod(F.xxhash64("at"), "slices").alias("slice"), "ids", "marks").repartition(parts, "k", "slice")
    blocks = met.groupBy("k", "block", "slices").agg(F.flatten(F.collect_list("ids")).alias("_ids"))
    two = blocks.select("k", "block", "_ids", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice")).repartition(parts, "k", "slice")
    alone = one.join(two, ["k", "slice"]).where(F.col("marks").isNull() | ~F.array_contains("marks", F.col("block")))
    alone = alone.select("ids", "_ids", F.col("k.rank").alias("relation"), F.lit(1).cast("long").alias("shared"))

    one = met.select("k", F.explode("marks").alias("block"), "ids", "keys", "bits").repartition(parts, "k", "block")
    two = met.select("k", "block", *(F.col(c).alias(f"_{c}") for c in ("ids", "keys", "bits"))).repartition(parts, "k", "block")
    few = F.col("bits").bitwiseAND(F.col("_bits")) == 0  # no second key for certain
    both = F.array_intersect("keys", "_keys")
    near = one.join(two, ["k", "block"]).where(few | (F.get(both, F.lit(0)) == F.col("k")))
    near = near.select("ids", "_ids", F.when(few, F.col("k.rank")).otherwise(F.array_min(both["rank"])).alias("relation"), F.when(few, 1).otherwise(F.size(both)).cast("long").alias("shared"))

    pairs = alone.unionByName(near).select(F.explode("ids").alias("work_id"), "_ids", "relation", "shared")
    return pairs.select("work_id", F.explode("_ids").alias("other"), "relation", "shared").where("work_id != other")


def watched(completed: DataFrame, synced: DataFrame, remote: DataFrame, unwatched: DataFrame) -> DataFrame:
    """Distinct episodes (work_id, episode_id) that any side has watched, without those marked as not."""
    keys = ["work_id", "episode_id"]
    return completed.select(*keys).union(synced.select(*keys)).union(remote.select(*keys)).distinct().join(unwatched.select(*keys).distinct(), keys, "left_anti")


def pruned_reviews(reviews: DataFrame, valid: DataFrame) -> DataFrame:
    """Pending reviews whose target is not valid any more become stale; the rows stay."""
    known = valid.select("target_id").distinct().withColumn("_known", F.lit(True))
    rows = reviews.join(known, "target_id", "left")
    return rows.withColumn("status", F.when((F.col("status") == "pending") & F.col("_known").isNull(), "stale").otherwise(F.col("status"))).drop("_known")
