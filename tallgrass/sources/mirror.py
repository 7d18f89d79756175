"""What is written: target paths of a mirror, XML side files, error reports; and what a cache gives up.

Items have id, source, group_type, work_title, title, season, episode, year,
path and name. Null titles count as empty, null seasons and episodes as 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.functions.paths import extension, stem
from tallgrass.functions.text import xml_escaped


def safe(name: Column) -> Column:
    """A name without the characters that file systems refuse and without dots or blanks at its ends."""
    return F.btrim(F.regexp_replace(F.coalesce(name, F.lit("")), r'[<>:"/\\|?*\x00-\x1F]', ""), F.lit(" ."))


def target_name(group: Column, work: Column, title: Column, season: Column, episode: Column, year: Column, name: Column) -> Column:
    """The pointer file of an item: 'Work - S01E02 - Title.strm', 'Work (2005).strm', or its own name for specials and auxiliary videos."""
    two = lambda n: F.when(F.coalesce(n, F.lit(1)) < 100, F.lpad(F.coalesce(n, F.lit(1)).cast("string"), 2, "0")).otherwise(n.cast("string"))
    code = F.concat(safe(work), F.lit(" - S"), two(season), F.lit("E"), two(episode))
    season_name = F.when(F.coalesce(title, F.lit("")) != "", F.concat(code, F.lit(" - "), safe(title))).otherwise(code)
    movie = F.when(F.coalesce(year, F.lit(0)) > 0, F.concat(safe(work), F.lit(" ("), year.cast("string"), F.lit(")"))).otherwise(safe(work))
    base = F.when(group == "season", season_name).when(group == "movie", movie).when(group.isin("special", "sps", "auxiliary"), safe(stem(name))).otherwise(safe(work))
    return F.concat(base, F.lit(".strm"))


def target_folder(root: Column, group: Column, work: Column, season: Column) -> Column:
    """root/Work/Season n, root/Work/SPs for specials, root/Work for the rest."""
    sub = F.when(group == "season", F.concat(F.lit("/Season "), F.coalesce(season, F.lit(1)).cast("string"))).when(group.isin("special", "sps"), F.lit("/SPs")).when(group == "auxiliary", F.lit("/Extras")).otherwise("")
    return F.concat(root, F.lit("/"), safe(work), sub)


def targets(items: DataFrame, root: Column) -> DataFrame:
    """id, target: where items of one target differ, all but the first by (path, id) get a suffix of their name and a digest of their path."""
    c = F.col
    name = target_name(c("group_type"), c("work_title"), c("title"), c("season"), c("episode"), c("year"), c("name"))
    placed = items.withColumn("_folder", target_folder(root, c("group_type"), c("work_title"), c("season"))).withColumn("_name", name)
    ranked = placed.withColumn("_n", F.row_number().over(Window.partitionBy("_folder", "_name").orderBy("path", "id")))
    digest = F.substring(F.sha1(F.coalesce("path", F.col("id").cast("string"))), 1, 8)
    suffix = F.btrim(F.substring(safe(stem(c("name"))), 1, 80), F.lit(" .-_"))
    own = F.when(c("_n") == 1, c("_name")).otherwise(F.concat(stem("_name"), F.lit(" - "), F.btrim(F.concat_ws(" ", F.nullif(suffix, F.lit("")), digest)), extension("_name")))
    return ranked.select("id", F.concat("_folder", F.lit("/"), own).alias("target"))


def sequence(items: DataFrame, group: str, keep: Column, path: str) -> DataFrame:
    """id, n: place by path among the kept items of each group. A window over one group's items."""
    return items.where(keep).select("id", F.row_number().over(Window.partitionBy(group).orderBy(path, "id")).alias("n"))


def side_file(root: str, fields: dict[str, Column], lists: dict[str, Column]) -> Column:
    """An XML side file: a line for each field that is neither null nor empty, and for each such entry of a list."""
    line = lambda tag, x: F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(f"  <{tag}>"), xml_escaped(x), F.lit(f"</{tag}>")))
    parts = [F.array(line(tag, x.cast("string"))) for tag, x in fields.items()]
    each = lambda tag, xs: F.transform(F.coalesce(xs, F.array().cast("array<string>")), lambda x: line(tag, x))
    parts += [each(tag, xs) for tag, xs in lists.items()]
    body = F.array_compact(F.concat(*parts))
    head = F.array(F.lit('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'), F.lit(f"<{root}>"))
    return F.concat(F.array_join(F.concat(head, body, F.array(F.lit(f"</{root}>"))), "\n"), F.lit("\n"))


def error_report(log: DataFrame) -> DataFrame:
    """timestamp, id, text of every entry, in lines that people read; sort by (timestamp, id) to write one."""
    head = F.concat(F.lit("["), "timestamp", F.lit("] "), F.concat_ws(" · ", F.coalesce("level", F.lit("")), "stage", "category", F.coalesce("source", F.lit("all"))), F.when(F.col("resolved"), " · resolved").otherwise(""))
    return log.select("timestamp", "id", F.concat_ws("\n    ", head, F.coalesce("message", F.lit(""))).alias("text"))


def evicted(cache: DataFrame, key: str, used: str, size: str, most_rows: int, most_bytes: int) -> DataFrame:
    """Entries that a cache gives up: the longest unused, until at most most_rows are left and at most most_bytes of sizes.

    An entry stays if it and all used after it fit. Running sums are taken over
    days first and within the one day that the bound falls into, so that no task
    sorts the whole cache.
    """
    rows = cache.select(key, F.coalesce(used, F.lit(0)).alias("_u"), F.coalesce(size, F.lit(0)).alias("_s")).withColumn("_d", F.floor(F.col("_u") / 86400))
    days = rows.groupBy("_d").agg(F.count("*").alias("_rows"), F.sum("_s").alias("_bytes"))
    later = Window.orderBy(F.col("_d").desc()).rowsBetween(Window.unboundedPreceding, -1)  # a row a day
    days = days.select("_d", F.coalesce(F.sum("_rows").over(later), F.lit(0)).alias("_r0"), F.coalesce(F.sum("_bytes").over(later), F.lit(0)).alias("_b0"))
    within = Window.partitionBy("_d").orderBy(F.col("_u").desc(), F.col(key).desc()).rowsBetween(Window.unboundedPreceding, 0)
    run = rows.join(days, "_d").withColumn("_r", F.col("_r0") + F.row_number().over(Window.partitionBy("_d").orderBy(F.col("_u").desc(), F.col(key).desc()))).withColumn("_b", F.col("_b0") + F.sum("_s").over(within))
    return run.where((F.col("_r") > most_rows) | (F.col("_b") > most_bytes)).select(key)
