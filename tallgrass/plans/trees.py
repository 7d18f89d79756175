"""Queries that write a tree of files from a driver table and scan it, and that commit listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.operators import staging
from tallgrass.session import shared_folder, table
from tallgrass.sources import folders

from .base import query


def _page_tree(spark: SparkSession, d: str) -> str:
    """All pages as files: in folders of several depths, of sizes below and above what a fingerprint reads; some in skipped folders or under system names."""
    p = table(spark, d, "pages")
    k, key = F.col("page_id") % 10, F.col("page_id").cast("string")
    name = F.when(k == 0, F.concat(F.lit(".git/"), key, F.lit(".html"))).when(k == 1, F.concat(F.lit("a/node_modules/"), key, F.lit(".html"))).when(k == 2, F.concat(F.lit("a/"), key, F.lit("/Thumbs.db")))
    name = name.when(k == 3, F.concat(F.lit("a/b/c/d/"), key, F.lit(".TXT"))).when(k == 4, F.concat(key, F.lit(".mkv"))).otherwise(F.concat(F.lit("h"), k.cast("string"), F.lit("/"), key, F.lit(".html")))
    copies = F.when(k == 5, 40).when(k == 6, 0).otherwise(1).cast("int")
    root = shared_folder(spark, "pages")
    folders.write_tree(p.select(name.alias("path"), F.encode(F.repeat(F.coalesce("html", F.lit("")), copies), "UTF-8").alias("content")), root)
    return root


_TREE = """p AS (SELECT page_id % 10 AS k, CAST(page_id AS VARCHAR) AS key, encode(repeat(coalesce(html, ''), CASE page_id % 10 WHEN 5 THEN 40 WHEN 6 THEN 0 ELSE 1 END)) AS content FROM pages),
    t AS (SELECT CASE k WHEN 0 THEN '.git/' || key || '.html' WHEN 1 THEN 'a/node_modules/' || key || '.html' WHEN 2 THEN 'a/' || key || '/Thumbs.db' WHEN 3 THEN 'a/b/c/d/' || key || '.TXT' WHEN 4 THEN key || '.mkv' ELSE 'h' || k || '/' || key || '.html' END AS path, k, key, content FROM p)"""


@query(
    f"""WITH {_TREE}
    SELECT path, CASE k WHEN 3 THEN 'a' WHEN 4 THEN '' ELSE 'h' || k END AS virtual_root, CASE k WHEN 3 THEN 5 WHEN 4 THEN 1 ELSE 2 END AS depth, CASE k WHEN 3 THEN '.TXT' WHEN 4 THEN '.mkv' ELSE '.html' END AS ext,
           CASE k WHEN 3 THEN 'text' WHEN 4 THEN 'video' ELSE 'other' END AS kind, octet_length(content) AS size, md5('local:' || path) AS id,
           left(sha256(encode(CAST(octet_length(content) AS VARCHAR)) || content[1:65536] || CASE WHEN octet_length(content) > 65536 THEN content[octet_length(content) - 65535 : octet_length(content)] ELSE ''::BLOB END), 24) AS fingerprint
    FROM t WHERE k NOT IN (0, 1, 2)"""
)
def folder_scan(spark: SparkSession, d: str) -> DataFrame:
    """Whole tree of files written from all pages: place, kind, size, id and fingerprint; skipped folders and system files stay out."""
    files = folders.listed_files(folders.nodes(spark, _page_tree(spark, d)))
    return folders.fingerprinted(files).select("path", "virtual_root", "depth", "ext", "kind", "size", "id", "fingerprint")


@query(
    f"""WITH {_TREE},
    f AS (SELECT path, regexp_replace(path, '/?[^/]*$', '') AS parent FROM t),
    d AS (SELECT DISTINCT unnest(CASE WHEN parent = '' THEN [] ELSE list_transform(range(1, len(string_split(parent, '/')) + 1), lambda i: array_to_string(string_split(parent, '/')[1:i], '/')) END) AS path FROM f),
    n AS (SELECT path, parent, 'file' AS kind FROM f UNION ALL SELECT path, regexp_replace(path, '/?[^/]*$', ''), 'dir' FROM d)
    SELECT path, parent, kind, CAST((row_number() OVER (PARTITION BY parent ORDER BY regexp_extract(path, '[^/]*$')) - 1) // 20 + 1 AS INTEGER) AS page, count(*) OVER (PARTITION BY parent) AS total FROM n"""
)
def folder_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of 20 members of every folder of that tree, nothing skipped."""
    rows = folders.paged(folders.nodes(spark, _page_tree(spark, d), skip=False), 20)
    return rows.select("path", "parent", F.when(F.col("is_dir"), "dir").otherwise("file").alias("kind"), "page", "total")


@query(
    """WITH s AS (SELECT CASE p_partkey % 4 WHEN 0 THEN '115' WHEN 1 THEN 'baidu' WHEN 2 THEN 'own' ELSE 'local' END AS namespace, p_partkey, p_name FROM part)
    SELECT namespace || '/' || p_partkey || '/' || CASE p_partkey % 5 WHEN 0 THEN 'E1.STRM' WHEN 1 THEN 'movie.nfo' WHEN 2 THEN 'Poster.jpg' ELSE 'e2.strm' END AS path, CASE namespace WHEN '115' THEN 'pan115' ELSE namespace END AS source,
           CASE p_partkey % 5 WHEN 1 THEN 'movie_nfo' WHEN 2 THEN 'poster' ELSE 'strm' END AS kind, CASE p_partkey % 5 WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE trim(p_name) END AS held, strlen(p_name) + 2 AS size FROM s WHERE p_partkey % 5 <> 4"""
)
def mirror_scan(spark: SparkSession, d: str) -> DataFrame:
    """A mirror written from all parts: stream files with what they hold, assets by kind, other files left out."""
    p = table(spark, d, "part")
    k = F.col("p_partkey") % 5
    space = F.element_at(F.array(*map(F.lit, ("115", "baidu", "own", "local"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    name = F.when(k == 0, "E1.STRM").when(k == 1, "movie.nfo").when(k == 2, "Poster.jpg").when(k == 3, "e2.strm").otherwise("else.bin")
    root = shared_folder(spark, "mirror")
    folders.write_tree(p.select(F.concat_ws("/", space, F.col("p_partkey").cast("string"), name).alias("path"), F.encode(F.concat(F.lit(" "), "p_name", F.lit("\n")), "UTF-8").alias("content")), root)
    rows = folders.mirror_files(folders.nodes(spark, root, skip=False))
    return rows.select("path", "source", "kind", F.when(F.col("kind") == "strm", F.col("real_path")).alias("held"), "size")


def _listings(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All orders as members of 50 folders: what is known of them, what a listing of each folder in pages tells (one late, some refused), and the roots' generations."""
    o = table(spark, d, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey") % 50
    folder, key = F.concat(F.lit("/f"), c.cast("string")), F.col("o_orderkey").cast("string")
    base = o.select(k.alias("k"), c.alias("c"), F.when(c % 2 == 0, "a").otherwise("b").alias("root"), folder.alias("folder"), F.concat(folder, F.lit("/"), key).alias("path"), key.alias("name"), F.when(k % 10 == 0, "dir").otherwise("file").alias("kind"), F.col("o_custkey").alias("size"), F.lit(1.0).alias("mtime"))
    known = base.where("k % 7 != 1")
    seen = F.when(F.col("k") % 11 == 0, 3).otherwise(1)
    stone = F.when(F.col("k") % 13 == 0, "old").otherwise("")
    nodes = known.select("root", "path", F.col("folder").alias("parent"), "name", "kind", "size", "mtime", F.lit(1).alias("first_seen"), seen.alias("last_seen"), stone.alias("tombstone"))
    inner = known.where("kind = 'dir'").select("root", F.concat("path", F.lit("/x")).alias("path"), F.col("path").alias("parent"), F.lit("x").alias("name"), F.lit("file").alias("kind"), "size", "mtime", F.lit(1).alias("first_seen"), F.lit(1).alias("last_seen"), F.lit("").alias("tombstone"))
    listed = base.where("k % 5 != 2").withColumn("size", F.when(F.col("k") % 3 == 0, F.col("size") + 1).otherwise(F.col("size")))
    again = listed.where("c % 10 = 4 AND k % 4 = 3")  # folders whose pages repeat paths
    rows = listed.unionByName(again)
    totals = rows.groupBy("folder").agg(F.count("*").alias("n"))
    page = (F.col("k") % 4 + 1).cast("int")
    total = F.when(F.col("c") % 10 == 6, F.col("n") + page).when(F.col("c") % 10 == 8, F.col("n") + 1).otherwise(F.col("n"))  # totals that drift, and listings that end too early
    pages = rows.join(totals, "folder").select(F.concat(F.lit("run"), "folder").alias("run"), "root", "folder", F.lit(2).alias("generation"), page.alias("page"), total.alias("total"), (page == 4).alias("last"), "path", "name", "kind", "size", "mtime")
    return nodes.unionByName(inner), pages, spark.createDataFrame([("a", 2), ("b", 3)], "root string, active int")


_LISTINGS = """o AS (SELECT o_orderkey AS k, o_custkey % 50 AS c, o_custkey AS size, '/f' || (o_custkey % 50) AS folder FROM orders),
    w AS (SELECT c, CASE WHEN c % 10 = 4 AND count(*) FILTER (k % 5 <> 2 AND k % 4 = 3) > 0 THEN 'repeated' WHEN c % 10 = 6 AND count(DISTINCT k % 4) FILTER (k % 5 <> 2) > 1 THEN 'drift'
             WHEN c % 10 IN (6, 8) THEN CASE WHEN count(DISTINCT k % 4) FILTER (k % 5 <> 2) = 4 THEN 'short' ELSE 'open' END WHEN c % 2 = 1 THEN 'stale' ELSE 'accepted' END AS verdict,
             count(*) FILTER (k % 5 <> 2) + count(*) FILTER (k % 5 <> 2 AND c % 10 = 4 AND k % 4 = 3) AS n FROM o GROUP BY c HAVING count(*) FILTER (k % 5 <> 2) > 0)"""


@query(f"WITH {_LISTINGS} SELECT 'run/f' || c AS run, n, verdict FROM w")
def staged_runs(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts of the listings of all folders: repeated paths, totals that drift, too few entries, a generation that is over."""
    _, pages, roots = _listings(spark, d)
    return staging.fenced(staging.verdicts(pages), roots).select("run", "n", "verdict")


@query(
    f"""WITH {_LISTINGS},
    m AS (SELECT o.*, verdict = 'accepted' AS ok, k % 7 <> 1 AS known, k % 5 <> 2 AS listed, CASE WHEN k % 11 = 0 THEN 3 ELSE 1 END AS seen, CASE WHEN k % 13 = 0 THEN 'old' ELSE '' END AS stone FROM o LEFT JOIN w USING (c)),
    r AS (SELECT *, CASE WHEN NOT coalesce(ok, false) THEN NULL WHEN listed AND NOT known THEN 'added' WHEN listed AND k % 3 = 0 THEN 'updated' WHEN listed THEN 'unchanged' WHEN known AND seen < 2 AND stone = '' THEN 'missing' END AS change FROM m WHERE known OR (coalesce(ok, false) AND listed))
    SELECT folder || '/' || k AS path, change, CASE WHEN change IN ('added', 'updated', 'unchanged') THEN 2 ELSE seen END AS last_seen, CASE WHEN change IN ('added', 'updated', 'unchanged') THEN '' WHEN change = 'missing' THEN 'now' ELSE stone END AS tombstone,
           size + CASE WHEN change IN ('added', 'updated') AND k % 3 = 0 THEN 1 ELSE 0 END AS size FROM r
    UNION ALL SELECT folder || '/' || k || '/x', CASE WHEN change = 'missing' THEN 'missing' END, 1, CASE WHEN change = 'missing' THEN 'now' ELSE '' END, size FROM r WHERE known AND k % 10 = 0"""
)
def fenced_commit(spark: SparkSession, d: str) -> DataFrame:
    """All nodes after the listings of all folders: new, changed, seen again and lost ones, lost folders with what they hold, and nothing from refused or late listings."""
    nodes, pages, roots = _listings(spark, d)
    runs = staging.fenced(staging.verdicts(pages), roots)
    return staging.merged(nodes, pages, runs, "now").select("path", "change", "last_seen", "tombstone", "size")
