"""Queries of names, paths, kinds and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.functions import media, paths, resource, score, text
from tallgrass.operators import library
from tallgrass.session import table

from .base import query

_PATH = "concat('/', trim(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/'))"


def pages(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("/"), F.btrim(F.regexp_extract("url", r"^[a-z]+://[^/?#]+([^?#]*)", 1), F.lit("/")))
    return table(spark, d, "pages").select("page_id", path.alias("path"), F.length("html").alias("n"))


@query(
    f"""WITH p AS (SELECT page_id, {_PATH} AS path FROM pages), q AS (SELECT *, regexp_extract(path, '([^/]*)$', 1) AS base FROM p)
    SELECT page_id, base, regexp_replace(base, '^(.+)\\.[^.]*$', '\\1') AS stem, regexp_extract(base, '^.+(\\.[^.]*)$', 1) AS ext, CASE WHEN length(path) - length(replace(path, '/', '')) <= 1 THEN '/' ELSE regexp_replace(path, '/[^/]*$', '') END AS parent,
    path = '/en' OR starts_with(path, '/en/') AS within, md5(concat('web:', path)) AS id FROM q"""
)
def path_parts(spark: SparkSession, d: str) -> DataFrame:
    base = paths.basename("path")
    return pages(spark, d).select("page_id", base.alias("base"), paths.stem(base).alias("stem"), paths.extension(base).alias("ext"), paths.parent("path").alias("parent"), paths.is_within("path", F.lit("/en")).alias("within"), resource.stable_id(F.lit("web"), F.col("path")).alias("id"))


@query(
    """WITH l AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN ' K:\\Media\\' || o_custkey || '\\' WHEN 1 THEN '/mnt//m/./' || o_custkey || '/' WHEN 2 THEN '/mnt/../' || o_custkey ELSE '' END AS v FROM orders)
    SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN lower(replace(rtrim(trim(v), '\\'), '\\', '/')) WHEN 3 THEN '' ELSE rtrim(v, '/') END AS locator,
    CASE o_orderkey % 4 WHEN 0 THEN '/' || trim(v) WHEN 1 THEN '/mnt/m/' || regexp_extract(v, '([0-9]+)', 1) WHEN 2 THEN NULL ELSE '/' END AS remote,
    CASE o_orderkey % 4 WHEN 0 THEN '/r/' || regexp_extract(v, '([0-9]+)', 1) END AS rebased FROM l"""
)
def locators(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    v = F.when(k == 0, F.concat(F.lit(" K:\\Media\\"), "o_custkey", F.lit("\\"))).when(k == 1, F.concat(F.lit("/mnt//m/./"), "o_custkey", F.lit("/"))).when(k == 2, F.concat(F.lit("/mnt/../"), "o_custkey")).otherwise("")
    rows = table(spark, d, "orders").select("o_orderkey", v.alias("v"))
    return rows.select("o_orderkey", paths.locator("v").alias("locator"), paths.remote_path("v").alias("remote"), paths.rebased("v", F.lit("k:/media/"), F.lit("/r")).alias("rebased"))


_EXTS = "CASE p_size % 8 WHEN 0 THEN '.MKV' WHEN 1 THEN '.srt' WHEN 2 THEN '.nfo' WHEN 3 THEN '.jpg' WHEN 4 THEN '.flac' WHEN 5 THEN '.zip' WHEN 6 THEN '.xyz' ELSE '' END"


@query(
    f"""WITH p AS (SELECT p_partkey, lower({_EXTS}) AS ext FROM part), k AS (SELECT p_partkey, CASE ext WHEN '.mkv' THEN 'video' WHEN '.srt' THEN 'subtitle' WHEN '.nfo' THEN 'nfo' WHEN '.jpg' THEN 'image' WHEN '.flac' THEN 'audio' WHEN '.zip' THEN 'archive' WHEN '' THEN 'text' ELSE 'text' END AS kind FROM p)
    SELECT kind, CASE kind WHEN 'video' THEN 'generate_strm' WHEN 'subtitle' THEN 'attach_only' ELSE 'ignore' END AS action, count(*) AS n FROM k GROUP BY 1, 2"""
)
def resource_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Kinds by the extension in the name, and by a hint where that is unknown."""
    rows = table(spark, d, "part").select(resource.kind(F.concat("p_name", F.expr(_EXTS)), hint=F.lit(" Text ")).alias("kind"))
    return rows.groupBy("kind", resource.action(F.col("kind")).alias("action")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, regexp_replace(lower(p_name), '[\\s\\-_.:：。·]+', '', 'g') AS title FROM part")
def text_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", text.normalised("p_name").alias("title"))


@query(
    """SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN p_name WHEN 1 THEN p_name WHEN 2 THEN p_name WHEN 3 THEN CASE WHEN length(p_name) = 4 THEN p_name ELSE p_name END ELSE p_name END AS title FROM part"""
)
def title_clean(spark: SparkSession, d: str) -> DataFrame:
    """Names wrapped in what containers carry (teams, status, ids, season ranges, years) come back as they were."""
    k, n = F.col("p_size") % 5, F.col("p_name")
    dressed = F.when(k == 0, F.concat(F.lit("[VCB-Studio] "), n, F.lit(" [1080p]"))).when(k == 1, F.concat(n, F.lit(".S1-S2+SP+OVA"))).when(k == 2, F.concat(n, F.lit(" {tmdb-12}[完结]")))
    dressed = dressed.when(k == 3, F.concat(F.lit("[BeanSub&FZSD][1080p]["), n, F.lit("]"))).otherwise(F.concat(n, F.lit(" (2005)")))
    return table(spark, d, "part").select("p_partkey", text.cleaned(dressed).alias("title"))


@query("SELECT page_id, trim(regexp_replace(html, '<[^>]+>', '', 'g'), E' ') AS plain, replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;') AS escaped FROM pages")
def text_of_pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.without_tags("html").alias("plain"), text.xml_escaped("url").alias("escaped"))


_GUESSES = [
    ("NCOP01.mkv", "a/NCOP01.mkv"), ("Show [PV1].mkv", "a/x.mkv"), ("AIR.S01E03.mkv", "A/AIR.2005/AIR.S01E03.mkv"), ("Show S01E02.mkv", "A/Show/Season 2/Show S01E02.mkv"),
    ("Show OVA01.mkv", "A/Show/x.mkv"), ("Show 剧场版.mkv", "A/x.mkv"), ("Show 第2季 05.mkv", "A/x.mkv"), ("Show 第07话.mkv", "A/第3季/x.mkv"), ("[Team] Show [09][1080p].mkv", "A/x.mkv"),
    ("05.mkv", "A/S2/05.mkv"), ("203.mkv", "A/203.mkv"), ("Show - 12.mkv", "A/x.mkv"), ("作品08.mkv", "A/x.mkv"), ("Film (1999).mkv", "A/Film (1999).mkv"), ("plain.mkv", "A/plain.mkv"), (None, None),
]


@query(
    """SELECT * FROM (VALUES ('05.mkv', 'bare', 'season', 2, 5), ('203.mkv', 'bare', 'season', 2, 3), ('AIR.S01E03.mkv', 'season_episode', 'season', 1, 3), ('Film (1999).mkv', 'movie_by_year', 'movie', NULL, NULL), ('NCOP01.mkv', 'opening', 'op_ed', NULL, NULL),
    ('Show - 12.mkv', 'bare', 'season', 1, 12), ('Show OVA01.mkv', 'special', 'special', 0, 1), ('Show S01E02.mkv', 'season_episode', 'season', 2, 2), ('Show [PV1].mkv', 'auxiliary', 'auxiliary', NULL, NULL), ('Show 剧场版.mkv', 'movie', 'movie', NULL, NULL),
    ('Show 第07话.mkv', 'numbered', 'season', 3, 7), ('Show 第2季 05.mkv', 'numbered', 'season', 2, 5), ('[Team] Show [09][1080p].mkv', 'bracketed', 'season', 1, 9), ('plain.mkv', 'none', 'unknown', NULL, NULL), ('作品08.mkv', 'attached', 'season', 1, 8), (NULL, 'none', 'unknown', NULL, NULL)) AS t(name, rule, group_type, season, episode)"""
)
def recognize_cascade(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame(_GUESSES, "name string, path string").withColumn("g", media.recognised("name", "path"))
    return rows.select("name", "g.rule", "g.group_type", "g.season", "g.episode")


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN 'special' WHEN l_partkey % 7 = 0 THEN 'opening' ELSE 'season_episode' END AS rule, CASE WHEN l_linenumber % 3 = 0 OR l_partkey % 7 <> 0 THEN l_linenumber END AS episode FROM lineitem"""
)
def recognize_episodes(spark: SparkSession, d: str) -> DataFrame:
    """The cascade over as many names as there are line items."""
    k = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("Show OVA"), "l_linenumber")).when(F.col("l_partkey") % 7 == 0, F.concat(F.lit("NCED "), "l_linenumber")).otherwise(F.concat(F.lit("Show.S"), F.year("l_shipdate"), F.lit("E"), "l_linenumber"))
    rows = table(spark, d, "lineitem").withColumn("g", media.recognised(F.concat(k, F.lit(".mkv")), F.concat(F.lit("A/Show/"), k, F.lit(".mkv"))))
    return rows.select("l_orderkey", "l_linenumber", "g.rule", "g.episode")


_IMAGES = "CASE p_size % 5 WHEN 0 THEN 'zh' WHEN 1 THEN NULL WHEN 2 THEN 'ja' WHEN 3 THEN 'en' ELSE 'fr' END AS lang, 0.6 + (p_partkey % 10) / 50.0::DOUBLE AS aspect, (p_partkey % 11)::DOUBLE AS average, p_partkey % 37 AS votes, p_size * 40 AS width"


@query(
    f"""WITH i AS (SELECT p_brand, p_partkey, {_IMAGES} FROM part), s AS (SELECT *, CASE WHEN lang = 'zh' THEN 50 WHEN lang IS NULL THEN 35 WHEN lang = 'ja' THEN 25 WHEN lang = 'en' THEN 20 ELSE 0 END + CASE WHEN aspect BETWEEN 0.62::DOUBLE AND 0.72::DOUBLE THEN 20 ELSE 0 END + least(average * 3, 30) + least(votes, 20) + least(width / 100.0::DOUBLE, 10) AS score FROM i)
    SELECT p_brand, p_partkey, score::DOUBLE AS score FROM s QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, p_partkey) = 1"""
)
def artwork_best(spark: SparkSession, d: str) -> DataFrame:
    images = table(spark, d, "part").selectExpr("p_brand", "p_partkey", *_IMAGES.replace("::DOUBLE", "D").replace("(p_partkey % 11)D", "cast(p_partkey % 11 AS DOUBLE)").split(", "))
    return library.best_artwork(images, "p_brand", score.poster("lang", "aspect", "average", "votes", "width"), "p_partkey").select("p_brand", "p_partkey", "score")


@query(
    f"""WITH i AS (SELECT p_partkey, {_IMAGES} FROM part)
    SELECT p_partkey, (CASE WHEN lang IS NULL THEN 50 WHEN lang IN ('zh', 'en', 'ja') THEN 10 ELSE 0 END + CASE WHEN aspect BETWEEN 1.70::DOUBLE AND 1.90::DOUBLE THEN 20 ELSE 0 END + least(average * 3, 30) + least(votes, 20) + least(width / 200.0::DOUBLE, 10))::DOUBLE AS backdrop,
    (CASE lang WHEN 'zh' THEN 50 WHEN 'ja' THEN 35 WHEN 'en' THEN 25 ELSE CASE WHEN lang IS NULL THEN 20 ELSE 0 END END + CASE WHEN p_partkey % 2 = 0 THEN 20 ELSE 0 END + least(average * 3, 30) + least(votes, 20))::DOUBLE AS logo,
    (CASE WHEN lang IS NULL THEN 50 WHEN lang IN ('zh', 'en', 'ja') THEN 10 ELSE 0 END + least(average * 3, 30) + least(votes, 20) + least(width / 100.0::DOUBLE, 10))::DOUBLE AS still FROM i"""
)
def artwork_scores(spark: SparkSession, d: str) -> DataFrame:
    images = table(spark, d, "part").selectExpr("p_partkey", *_IMAGES.replace("::DOUBLE", "D").replace("(p_partkey % 11)D", "cast(p_partkey % 11 AS DOUBLE)").split(", "))
    kind = F.when(F.col("p_partkey") % 2 == 0, ".svg").otherwise(".png")
    return images.select("p_partkey", score.backdrop("lang", "aspect", "average", "votes", "width").alias("backdrop"), score.logo("lang", kind, "average", "votes").alias("logo"), score.still("lang", "average", "votes", "width").alias("still"))


@query(
    """WITH c AS (SELECT p_partkey, lower(replace(p_name, ' ', '')) AS t, CASE p_partkey % 4 WHEN 0 THEN lower(replace(p_name, ' ', '')) WHEN 1 THEN lower(left(replace(p_name, ' ', ''), 4)) WHEN 2 THEN lower(replace(p_name, ' ', '')) || 'x' ELSE 'zzz' END AS s, p_size AS y, p_partkey % 20 / 10.0 AS v, p_retailprice AS pop FROM part)
    SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 40 WHEN 1 THEN 25 WHEN 2 THEN 34 ELSE 0 END + CASE WHEN p_partkey % 10 = 0 THEN 120 ELSE 0 END + CASE WHEN abs(25 - y) = 0 THEN 30 WHEN abs(25 - y) <= 1 THEN 15 WHEN abs(25 - y) <= 3 THEN 5 ELSE 0 END + 10 AS points FROM c"""
)
def candidate_score(spark: SparkSession, d: str) -> DataFrame:
    """Scores without popularity, which are whole numbers, and without likeness."""
    t = F.lower(F.replace("p_name", F.lit(" "), F.lit("")))
    k = F.col("p_partkey") % 4
    s = F.when(k == 0, t).when(k == 1, F.lower(F.left(F.replace("p_name", F.lit(" "), F.lit("")), F.lit(4)))).when(k == 2, F.concat(t, F.lit("x"))).otherwise("zzz")
    points = score.candidate(s, t, F.lit(None).cast("string"), F.lit(False), F.col("p_partkey") % 10 == 0, F.lit(0.0), F.lit(25), F.col("p_size"), F.lit(True), F.lit(0), F.lit(0))
    return table(spark, d, "part").select("p_partkey", points.cast("int").alias("points"))


@query(
    """WITH c AS (SELECT p_partkey AS candidate_id, p_size % 9 AS tmdb_id, CASE WHEN p_size % 2 = 0 THEN 'tv' ELSE 'movie' END AS tmdb_type, p_name AS title, (p_partkey % 13)::DOUBLE AS score, (p_partkey % 5)::DOUBLE AS popularity FROM part),
    t AS (SELECT tmdb_id, tmdb_type, count(DISTINCT title) AS n_titles FROM c WHERE tmdb_id > 0 GROUP BY 1, 2)
    SELECT candidate_id, tmdb_id, tmdb_type, n_titles FROM (SELECT * FROM c WHERE tmdb_id > 0 QUALIFY row_number() OVER (PARTITION BY tmdb_id, tmdb_type ORDER BY score DESC, popularity DESC, candidate_id) = 1) JOIN t USING (tmdb_id, tmdb_type)
    UNION ALL SELECT candidate_id, tmdb_id, tmdb_type, 1 FROM c WHERE tmdb_id = 0"""
)
def candidate_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").selectExpr("p_partkey AS candidate_id", "p_size % 9 AS tmdb_id", "if(p_size % 2 = 0, 'tv', 'movie') AS tmdb_type", "p_name AS title", "cast(p_partkey % 13 AS DOUBLE) AS score", "cast(p_partkey % 5 AS DOUBLE) AS popularity")
    return library.deduplicated_candidates(rows).select("candidate_id", "tmdb_id", "tmdb_type", F.size("titles").cast("long").alias("n_titles"))


@query(
    """SELECT o_orderkey, CASE WHEN n <= 0 OR m <= 0 THEN '' WHEN o_orderstatus = 'P' THEN CASE WHEN abs(n - m) >= 3 AND (n / m::DOUBLE < 0.5 OR n / m::DOUBLE > 1.8) THEN 'warn' ELSE '' END WHEN abs(n - m) >= 2 AND (n / m::DOUBLE < 0.8 OR n / m::DOUBLE > 1.2) THEN 'warn' ELSE '' END AS severity
    FROM (SELECT o_orderkey, o_orderstatus, o_custkey % 8 AS m, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n FROM orders)"""
)
def count_severity(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    rows = table(spark, d, "orders").join(counts, "o_orderkey", "left")
    return rows.select("o_orderkey", score.count_severity(F.coalesce("n", F.lit(0)), F.col("o_custkey") % 8, F.when(F.col("o_orderstatus") == "P", "special").otherwise("season")).alias("severity"))


@query("SELECT page_id, epoch_us(TIMESTAMP '2024-01-01 00:00:00') // 1000000 + 86400 + CAST(('0x' || md5(url))::UHUGEINT % 86400 AS BIGINT) AS due FROM pages")
def jitter_due(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.unix_timestamp(score.due_at(F.lit("2024-01-01 00:00:00").cast("timestamp"), "url")).alias("due"))


@query("SELECT event_id, round(CASE WHEN value > 0 THEN least(1.0, greatest(0.0, (event_id % 100) / value)) ELSE 0 END, 4)::DOUBLE AS ratio, CASE WHEN event_id % 3 = 0 THEN 'low' WHEN event_id % 2 = 0 THEN 'medium' ELSE 'high' END AS confidence FROM events")
def progress_ratios(spark: SparkSession, d: str) -> DataFrame:
    level = lambda n, name: F.when(F.col("event_id") % n == 0, name).otherwise("high")
    return table(spark, d, "events").select("event_id", score.progress_ratio(F.col("event_id") % 100, "value").alias("ratio"), score.least_confidence(level(2, "medium"), level(3, "low")).alias("confidence"))


@query("SELECT p_partkey, regexp_replace(lower(p_name), '[^0-9a-z]', '', 'g') AS identity, regexp_replace(lower(p_name), '[^0-9a-z]', '', 'g') = regexp_replace(lower(p_type), '[^0-9a-z]', '', 'g') AS same, 1.0::DOUBLE AS ratio, p_name AS first_form FROM part")
def title_identity(spark: SparkSession, d: str) -> DataFrame:
    wide = F.concat(F.upper("p_name"), F.lit("！"))
    return table(spark, d, "part").select("p_partkey", text.identity(wide).alias("identity"), text.same_title("p_name", "p_type").alias("same"), text.block_ratio("p_name", "p_name").alias("ratio"), F.get(text.variants("p_name"), F.lit(0)).alias("first_form"))
