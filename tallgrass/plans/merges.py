"""Queries of nested merges: orders stand for works, their lines for episodes, customers for series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.operators import merge
from tallgrass.session import stored, table

from .base import query

# Works as flat tables, in words that both engines read.
_ONE = """SELECT o_orderkey AS pos, CASE WHEN o_orderkey % 3 = 2 THEN concat('d', o_custkey) ELSE concat('w', o_orderkey) END AS work_id,
    CASE o_orderkey % 4 WHEN 0 THEN 'pan115' WHEN 1 THEN 'baidu' WHEN 2 THEN 'openlist' ELSE 'zdisk' END AS source, 'main_series' AS card_type, CASE WHEN o_orderkey % 2 = 0 THEN 'tv' ELSE '' END AS media_type,
    CASE WHEN o_orderkey % 3 = 0 THEN 'seasonal' ELSE '' END AS import_scope, CASE WHEN o_orderkey % 3 = 1 THEN concat(CASE WHEN o_orderkey % 2 = 0 THEN '/M/C' ELSE '/m/c' END, o_custkey, CASE WHEN o_orderkey % 5 < 3 THEN '/Season 1' ELSE '/sps' END) ELSE '/x' END AS dir_path,
    CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE concat('title ', o_orderkey) END AS title, CASE WHEN o_orderkey % 7 < 4 THEN NULL ELSE o_orderpriority END AS plot, CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN 0.0 ELSE o_totalprice END AS rating,
    CASE WHEN o_orderkey % 6 < 4 THEN '' ELSE concat('p', o_orderkey % 1000) END AS last_played, CASE o_orderkey % 7 WHEN 0 THEN 'ready' WHEN 1 THEN 'waiting_review' WHEN 2 THEN NULL ELSE 'waiting_metadata' END AS metadata_state, o_custkey AS series FROM orders"""
_LINES = """SELECT l_orderkey AS pos, l_linenumber AS i, concat('e', l_orderkey, '-', l_linenumber) AS episode_id, CASE WHEN l_linenumber > 4 THEN 'special' ELSE 'season' END AS group_type, CAST(l_suppkey % 2 AS INT) AS season_number, CAST(CASE WHEN l_linenumber = 7 THEN 0 ELSE l_linenumber % 3 END AS INT) AS episode_number,
    concat('t', l_linenumber) AS title, CASE l_returnflag WHEN 'A' THEN 'local' WHEN 'N' THEN 'pan115' ELSE '' END AS source, CASE WHEN l_linenumber = 2 THEN '' ELSE concat('P/', l_partkey) END AS strm_path FROM lineitem"""

# The rules once more, over flat tables: keys, the first non-empty value, unions by key, counts.
_RANK = "CASE {} WHEN 'pan115' THEN 0 WHEN 'baidu' THEN 1 WHEN 'local' THEN 2 WHEN 'openlist' THEN 3 ELSE 99 END"
_BASE = f"""w AS ({_ONE}), e AS (SELECT DISTINCT * FROM ({_LINES}) WHERE pos IN (SELECT pos FROM w)),
    s AS (SELECT e.pos, e.group_type, e.season_number, count(*) AS n, min(e.i) AS i, concat('s', e.pos) AS title, e.pos % 2 = 0 AS scraped, CASE WHEN e.pos % 6 < 3 AND e.group_type = 'season' THEN series END AS tmdb FROM e JOIN w USING (pos) GROUP BY e.pos, e.group_type, e.season_number, series),
    t AS (SELECT pos, min(tmdb::VARCHAR) AS tmdb, bool_or(group_type = 'season' AND season_number > 0) AS numbered FROM s GROUP BY 1), z AS (SELECT pos, sum(n) AS n, count(*) AS k FROM s GROUP BY 1),
    k AS (SELECT w.*, {_RANK.format('w.source')} AS r, coalesce(numbered, false) AS numbered, coalesce(z.n, 0) AS size, coalesce(z.k, 0) AS parts,
        CASE WHEN import_scope = 'seasonal' THEN CASE WHEN tmdb IS NOT NULL THEN 'seasonal|' || CASE WHEN media_type = '' THEN 'tv' ELSE media_type END || '|' || tmdb ELSE 'seasonal|' || work_id END
        WHEN w.pos % 3 = 1 THEN 'mirror-series|' || w.source || '|' || series ELSE 'directory|' || w.source || '|' || work_id END AS key FROM w LEFT JOIN t USING (pos) LEFT JOIN z USING (pos)),
    d AS (SELECT *, (size, size, parts) >= max((size, size, parts)) OVER (PARTITION BY key ORDER BY pos) AS took FROM k),
    g AS (SELECT key, split_part(key, '|', 1) AS kind, count(*) AS n, max(pos) FILTER (took) AS winner, arg_max(last_played, pos) FILTER (took AND last_played <> '') AS played FROM d GROUP BY 1),
    m AS (SELECT k.*, kind, g.n, g.played, kind <> 'directory' AND g.n > 1 AS merges FROM k JOIN g USING (key) WHERE kind <> 'directory' OR pos = winner),
    lead AS (SELECT key, arg_min(work_id, CASE WHEN kind = 'seasonal' THEN (r, work_id) ELSE ((NOT numbered)::INT, work_id) END) AS work_id, arg_min(pos, CASE WHEN kind = 'seasonal' THEN (r, work_id) ELSE ((NOT numbered)::INT, work_id) END) AS lead FROM m GROUP BY 1)"""
_HEADS = f"""WITH {_BASE}, f AS (SELECT key, any_value(kind) AS kind, arg_min(source, (r, work_id)) AS source, arg_min(title, (r, work_id)) FILTER (title <> '') AS title, arg_min(plot, (r, work_id)) FILTER (plot <> '') AS plot, arg_min(rating, (r, work_id)) FILTER (rating <> 0) AS rating, max(last_played) AS last_played, any_value(played) AS played,
        min(CASE metadata_state WHEN 'ready' THEN 0 WHEN 'waiting_review' THEN 1 ELSE 3 END) AS state, any_value(merges) AS merges, any_value(coalesce(metadata_state, '')) AS own FROM m GROUP BY 1),
    sources AS (SELECT key, string_agg(source, ',' ORDER BY rank, source) AS sources FROM (SELECT DISTINCT key, source, {_RANK.format('source')} AS rank FROM (SELECT key, source FROM m UNION ALL SELECT m.key, e.source FROM m JOIN e USING (pos) WHERE e.source <> '')) GROUP BY 1),
    places AS (SELECT key, string_agg(source || '=' || place[1] || ':' || place[2], ',' ORDER BY rank, source) AS places FROM (SELECT m.key, e.source, {_RANK.format('e.source')} AS rank, min([episode_id, strm_path]) AS place FROM m JOIN e USING (pos) WHERE e.source <> '' AND strm_path <> '' GROUP BY 1, 2) GROUP BY 1),
    counts AS (SELECT key, string_agg(source || '=' || n, ',' ORDER BY rank, source) AS counts FROM (SELECT key, source, {_RANK.format('source')} AS rank, max(n) AS n FROM (SELECT m.key, m.pos, CASE WHEN e.source = '' THEN m.source ELSE e.source END AS source, count(*) AS n FROM m JOIN e USING (pos) GROUP BY ALL UNION ALL SELECT key, pos, 'baidu', pos % 10 FROM m WHERE pos % 7 = 0) GROUP BY 1, 2) GROUP BY 1)
    SELECT lead.work_id, f.kind, f.source, CASE WHEN f.kind = 'mirror-series' AND l.title <> '' THEN l.title ELSE coalesce(f.title, '') END AS title, CASE WHEN f.kind = 'mirror-series' AND l.plot <> '' THEN l.plot ELSE coalesce(f.plot, '') END AS plot,
        CASE WHEN NOT f.merges THEN l.rating WHEN f.kind = 'mirror-series' AND l.rating <> 0 THEN l.rating ELSE f.rating END AS rating, CASE WHEN f.kind = 'directory' THEN coalesce(f.played, '') ELSE f.last_played END AS last_played,
        CASE WHEN NOT f.merges THEN own WHEN state = 0 THEN 'ready' WHEN state = 1 THEN 'waiting_review' ELSE 'waiting_metadata' END AS state, sources, coalesce(places, '') AS places, coalesce(counts, '') AS counts
    FROM f JOIN lead USING (key) JOIN w AS l ON l.pos = lead.lead JOIN sources USING (key) LEFT JOIN places USING (key) LEFT JOIN counts USING (key)"""
_NESTED = f"""WITH {_BASE}, x AS (SELECT m.key, m.merges, e.*, row_number() OVER (PARTITION BY m.key, m.merges, e.group_type, e.season_number, e.episode_number, CASE WHEN e.episode_number > 0 THEN '' ELSE concat(e.title, '|', e.episode_id) END, CASE WHEN m.merges THEN '' ELSE e.episode_id END ORDER BY {_RANK.format('e.source')}, e.episode_id) AS p FROM m JOIN e USING (pos)),
    y AS (SELECT * FROM x WHERE p = 1 OR NOT merges), eps AS (SELECT key, string_agg(episode_id, ',' ORDER BY CASE WHEN merges THEN 0 ELSE i END, season_number, episode_number, title, episode_id) AS episodes FROM y GROUP BY 1),
    b AS (SELECT m.key, m.merges, s.*, (r, work_id, i) AS seen, row_number() OVER (PARTITION BY m.key, s.group_type, s.season_number ORDER BY NOT scraped, tmdb IS NULL, s.n DESC, r, work_id) AS p, min((r, work_id, i)) OVER (PARTITION BY m.key, s.group_type, s.season_number) AS first FROM m JOIN s USING (pos)),
    c AS (SELECT b.key, b.group_type, b.season_number, b.title, b.merges, b.i, b.first, CASE WHEN b.merges THEN (SELECT count(*) FROM y WHERE y.key = b.key AND y.group_type = b.group_type AND y.season_number = b.season_number) ELSE b.n END AS n FROM b WHERE p = 1),
    seasons AS (SELECT key, string_agg(group_type || season_number || '/' || n || '/' || title, ',' ORDER BY CASE WHEN merges THEN 0 ELSE i END, season_number, first) AS seasons FROM c GROUP BY 1)
    SELECT lead.work_id, coalesce(episodes, '') AS episodes, coalesce(seasons, '') AS seasons FROM lead LEFT JOIN eps USING (key) LEFT JOIN seasons USING (key)"""


def _works(spark: SparkSession, d: str) -> DataFrame:
    """Orders as nested works."""
    for t in ("orders", "lineitem"):
        table(spark, d, t).createOrReplaceTempView(f"{t}_as_works")
    works, lines = (spark.sql(q.replace("FROM orders", "FROM orders_as_works").replace("FROM lineitem", "FROM lineitem_as_works")) for q in (_ONE, _LINES))
    lines = lines.repartition("pos").distinct()  # one shuffle for all that groups or joins them by work
    fields = ("episode_id", "group_type", "season_number", "episode_number", F.lit("video").alias("kind"), "title", "source", "strm_path")
    episodes = lines.groupBy("pos").agg(F.sort_array(F.collect_list(F.struct("i", F.struct(*fields).alias("e")))).alias("e"))
    n = lines.groupBy("pos", "group_type", "season_number").agg(F.count("*").cast("int").alias("n"), F.min("i").alias("i"))
    tmdb = F.when((F.col("pos") % 6 < 3) & (F.col("group_type") == "season"), F.lit("?"))
    one = F.struct("group_type", "season_number", F.concat(F.lit("s"), "pos").alias("title"), (F.col("pos") % 2 == 0).alias("scraped"), tmdb.alias("tmdb_id"), F.lit("").alias("tmdb_type"), F.col("n").alias("episode_count"))
    seasons = n.groupBy("pos").agg(F.sort_array(F.collect_list(F.struct("i", one.alias("s")))).alias("s"))
    whole = works.join(episodes, "pos", "left").join(seasons, "pos", "left")
    counts = F.when(F.col("pos") % 7 == 0, F.create_map(F.lit("baidu"), (F.col("pos") % 10).cast("int")))
    named = F.transform("s", lambda x: x["s"].withField("tmdb_id", F.when(x["s"]["tmdb_id"].isNotNull(), F.col("series").cast("string"))))
    return whole.withColumns({"episodes": F.transform("e", lambda x: x["e"]), "seasons": named, "source_episode_counts": counts}).drop("e", "s")


def _listed(entries: str, value) -> Column:
    return F.array_join(F.transform(F.map_entries(entries), lambda x: F.concat(x["key"], F.lit("="), value(x["value"]))), ",")


@query(_HEADS)
def merge_works(spark: SparkSession, d: str) -> DataFrame:
    """Fields, sources, places and counts of works merged by series, of mirrored seasons and of repeated folders."""
    m = merge.deduplicated(_works(spark, d), F.col("pos"), lambda rows: stored(rows, "merge"))
    places = _listed("source_locations", lambda v: F.concat(v["episode_id"], F.lit(":"), v["strm_path"]))
    counts = _listed("source_episode_counts", lambda v: v.cast("string"))
    return m.select("work_id", "kind", "source", "title", "plot", "rating", "last_played", F.col("metadata_state").alias("state"), F.array_join("sources", ",").alias("sources"), places.alias("places"), counts.alias("counts"))


@query(_NESTED)
def merge_works_nested(spark: SparkSession, d: str) -> DataFrame:
    """Episodes and seasons of the same works, in their order."""
    m = merge.deduplicated(_works(spark, d), F.col("pos"), lambda rows: stored(rows, "merge"))
    season = lambda s: F.concat(s["group_type"], s["season_number"].cast("string"), F.lit("/"), s["episode_count"].cast("string"), F.lit("/"), s["title"])
    return m.select("work_id", F.array_join(F.transform("episodes", lambda e: e["episode_id"]), ",").alias("episodes"), F.array_join(F.transform("seasons", season), ",").alias("seasons"))


@query(
    f"""WITH w AS ({_ONE}), e AS (SELECT DISTINCT * FROM ({_LINES})), o AS (SELECT e.*, CASE WHEN e.source = '' THEN w.source ELSE e.source END AS of FROM e JOIN w USING (pos)),
    p AS (SELECT w.pos, w.source, w.source = 'pan115' OR coalesce(bool_or(of = 'pan115'), false) AS part, count(*) FILTER (of <> 'pan115') AS kept, count(of) AS n FROM w LEFT JOIN o USING (pos) GROUP BY 1, 2),
    r AS (SELECT pos, string_agg(source, ',' ORDER BY {_RANK.format('source')}, source) AS sources, arg_min(source, ({_RANK.format('source')}, source)) AS best FROM (SELECT pos, source FROM p UNION SELECT pos, source FROM o WHERE of <> 'pan115' AND source <> '') WHERE source <> 'pan115' GROUP BY 1),
    s AS (SELECT pos, group_type, season_number, min(i) AS i, count(*) AS n, count(*) FILTER (of <> 'pan115') AS kept FROM o GROUP BY 1, 2, 3), q AS (SELECT pos, string_agg(group_type || season_number || '/' || kept, ',' ORDER BY i, season_number) FILTER (kept > 0) AS seasons, string_agg(group_type || season_number || '/' || n, ',' ORDER BY i, season_number) AS every FROM s GROUP BY 1)
    SELECT pos, CASE WHEN part AND source = 'pan115' THEN best ELSE source END AS source, CASE WHEN part THEN sources ELSE '' END AS sources, CASE WHEN part THEN kept ELSE n END AS n_episodes, coalesce(CASE WHEN part THEN seasons ELSE every END, '') AS seasons FROM p LEFT JOIN r USING (pos) LEFT JOIN q USING (pos) WHERE NOT part OR kept > 0"""
)
def source_removed_nested(spark: SparkSession, d: str) -> DataFrame:
    """Works without what one source gave: its episodes, the seasons that it alone filled, its rank as main source."""
    w = merge.without(_works(spark, d), "pan115")
    season = lambda s: F.concat(s["group_type"], s["season_number"].cast("string"), F.lit("/"), s["episode_count"].cast("string"))
    return w.select("pos", "source", F.array_join("sources", ",").alias("sources"), F.size("episodes").cast("long").alias("n_episodes"), F.array_join(F.transform("seasons", season), ",").alias("seasons"))
