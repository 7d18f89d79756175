"""Scans of catalog exports: tree listings, XML side files, JSON manifests and error logs.

Files come from `spark.read.format("binaryFile")` or as (file, content) rows, so
Spark deals them to tasks by file. A listing is decoded whole, as its encoding
can only be told from all of it; its lines are rows from then on.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from tallgrass.functions import resource
from tallgrass.functions.paths import extension

# Marks of tree listings, and their lines.
MARKS = ["|——", "|-", "├", "└", "│"]
BAR_FIRST, BAR_LINE = r"^\|——(.+)$", r"^((?:\| )*)\|-(.+)$"
BOX_LINE = r"^((?:(?:│ {2,3})|(?: {3,4}))*)(?:├──\s?|└──\s?|├─\s?|└─\s?)(.+)$"
BOX_STEP = r"(?:│ {2,3})|(?: {3,4})"


@F.pandas_udf(StructType([StructField("encoding", StringType()), StructField("text", StringType())]))
def decoded(content: pd.Series) -> pd.DataFrame:
    """Text and encoding of a listing: of those that decode and show a mark, that of the longest text, the first of equal ones; nulls where none does."""

    def one(data: bytes | None):
        found = (None, None)
        for name in (["utf-16"] if data and data[:2] in (b"\xff\xfe", b"\xfe\xff") else []) + ["utf-8-sig", "utf-8", "gbk", "utf-16"]:
            try:
                text = (data or b"").decode(name)
            except UnicodeDecodeError:
                continue
            if any(m in text for m in MARKS) and (found[1] is None or len(text) > len(found[1])):
                found = (name, text)
        return found

    return pd.DataFrame([one(x) for x in content], columns=["encoding", "text"])


def lines(files: DataFrame) -> DataFrame:
    """file, line_no (from 1), line of the listings (file, content) that can be decoded."""
    text = files.select("file", decoded("content").alias("d")).where("d.text IS NOT NULL")
    return text.select("file", F.posexplode(F.split("d.text", r"\r\n|\n|\r")).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def style(rows: DataFrame) -> DataFrame:
    """file, style ('bar' or 'box'): the one kind of line that a listing has; null where it has both or none, which no scan takes."""
    bar, box = F.count_if(F.col("line").rlike(BAR_LINE) | F.col("line").rlike(BAR_FIRST)), F.count_if(F.col("line").rlike(BOX_LINE))
    return rows.groupBy("file").agg(F.when((bar > 0) & (box == 0), "bar").when((box > 0) & (bar == 0), "box").alias("style"))


def bar_node(line: Column) -> Column:
    """(depth, name) of a line such as '| | |-name' or '|——name', depth from 1; null for others."""
    first = F.when(line.rlike(BAR_FIRST), F.struct(F.lit(1).alias("depth"), F.btrim(F.regexp_extract(line, BAR_FIRST, 1)).alias("name")))
    other = F.when(line.rlike(BAR_LINE), F.struct((F.length(F.regexp_extract(line, BAR_LINE, 1)) / 2 + 1).cast("int").alias("depth"), F.btrim(F.regexp_extract(line, BAR_LINE, 2)).alias("name")))
    return F.coalesce(first, other)


def box_node(line: Column) -> Column:
    """(depth, name) of a line such as '│   ├── name', depth from 1; null for others."""
    return F.when(line.rlike(BOX_LINE), F.struct((F.regexp_count(F.regexp_extract(line, BOX_LINE, 1), F.lit(BOX_STEP)) + 1).cast("int").alias("depth"), F.btrim(F.regexp_extract(line, BOX_LINE, 2)).alias("name")))


def tree(rows: DataFrame, node: Column, source: str, deepest: int = 128, above: int = 0) -> DataFrame:
    """file, path, name, ext, kind, id of the files in listings (file, line_no, line). above: levels at the top that are no part of paths, 1 for bar listings, whose first line is the root.

    The name above a line at each depth is the last one there that no shallower
    line has followed: a window over the file's lines per depth that occurs. Where
    a line is more than one step deeper than the last, missing folders are ''.
    Folders are names without a known extension; system files are left out. Lines
    deeper than `deepest` are left out with all that they would hold.
    """
    at = rows.select("file", "line_no", node.alias("n")).where("n IS NOT NULL").select("file", "line_no", "n.*").where(F.col("depth") <= deepest)
    levels = at.agg(F.max("depth")).first()[0] or 0
    before = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    for i in range(1, levels + 1):
        # A shallower line empties the level; its own name fills it.
        at = at.withColumn(f"_{i}", F.last(F.when(F.col("depth") == i, F.col("name")).when(F.col("depth") < i, F.lit("")), True).over(before))
    parts = F.slice(F.array(*(F.coalesce(f"_{i}", F.lit("")) for i in range(1, levels + 1))) if levels else F.array().cast("array<string>"), F.lit(1 + above), F.greatest(F.col("depth") - above, F.lit(0)))
    found = at.where(F.col("depth") > above).select("file", "line_no", F.array_join(parts, "/").alias("path"), "name", F.lower(extension("name")).alias("ext"))
    kind = resource.kind("name")
    return found.where((kind != "other") & ~resource.is_system("name")).select("file", "line_no", "path", "name", "ext", kind.alias("kind"), resource.stable_id(F.lit(source), F.col("path")).alias("id"))


def side_file(xml: Column) -> Column:
    """Fields of an XML side file as a struct; a malformed or null document gives null fields, bad numbers give null."""
    text = lambda tag: F.nullif(F.btrim(F.xpath_string(xml, F.lit(f"/*/{tag}"))), F.lit(""))
    every = lambda tag: F.filter(F.transform(F.xpath(xml, F.lit(f"/*/{tag}/text()")), lambda x: F.btrim(x)), lambda x: x != "")
    flag = F.lower(text("metadatapending")).isin("1", "true", "yes")
    return F.struct(text("title").alias("title"), text("originaltitle").alias("original_title"), F.try_to_number(text("year"), F.lit("9999")).cast("int").alias("year"), text("plot").alias("plot"), text("tmdbid").alias("tmdb_id"), text("rating").try_cast("double").alias("rating"), F.floor(text("runtime").try_cast("double")).cast("int").alias("runtime"), flag.alias("pending"), every("genre").alias("genres"), every("studio").alias("studios"), F.filter(F.transform(F.xpath(xml, F.lit("/*/actor/name/text()")), lambda x: F.btrim(x)), lambda x: x != "").alias("cast"))


def xml_files(files: DataFrame) -> DataFrame:
    """file and fields of side files (file, content); documents that aren't well-formed keep only their name.

    Many small files come in few splits, though each is parsed once a field; they are dealt out first.
    """
    files = files.select("file", "content").repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ok = F.col("x").rlike(r"^\s*<") & well_formed(F.col("x"))
    rows = files.select("file", F.decode("content", "UTF-8").alias("x")).withColumn("x", F.when(ok, F.col("x")))
    return rows.select("file", side_file(F.col("x")).alias("f")).select("file", "f.*")


@F.pandas_udf(BooleanType())
def well_formed(xml: pd.Series) -> pd.Series:
    """Whether a document parses: XPath functions raise on one that doesn't."""
    from xml.etree import ElementTree

    def one(x: str | None) -> bool:
        try:
            return x is not None and ElementTree.fromstring(x) is not None
        except ElementTree.ParseError:
            return False

    return pd.Series([one(x) for x in xml])


MANIFEST = "format string, manifest_id string, source string, source_root string, entries array<struct<name:string,is_dir:boolean,size:bigint,modified:double,remote_path:string,depth:int>>"


def manifest(files: DataFrame) -> DataFrame:
    """manifest_id, path, name, size, mtime, kind, id of the files in JSON manifests (file, content). Folders, names without a known kind and entries without a path are left out; text that is no manifest gives no row."""
    rows = files.select(F.from_json(F.decode("content", "UTF-8"), MANIFEST).alias("m")).select("m.manifest_id", "m.source", "m.source_root", F.explode("m.entries").alias("e"))
    root = F.rtrim(F.coalesce("source_root", F.lit("")), F.lit("/"))
    path = F.when(F.startswith("e.remote_path", F.concat(root, F.lit("/"))), F.substr("e.remote_path", F.length(root) + 2)).otherwise(F.ltrim("e.remote_path", F.lit("/")))
    kept = rows.where("NOT coalesce(e.is_dir, false) AND e.remote_path IS NOT NULL").select("manifest_id", "source", path.alias("path"), "e.name", "e.size", F.col("e.modified").alias("mtime"))
    kept = kept.withColumn("kind", resource.kind("name")).where(~resource.is_system("name"))
    return kept.withColumn("id", resource.stable_id(F.col("source"), F.col("path")))


LOG = "id string, timestamp string, stage string, category string, level string, message string, source string, resolved boolean"


def error_log(rows: DataFrame) -> DataFrame:
    """Entries of JSON lines (value); lines that aren't objects are left out, null stage and category are 'other' and 'unknown'."""
    e = rows.select(F.from_json("value", LOG).alias("e")).select("e.*").where("id IS NOT NULL")
    return e.withColumn("stage", F.coalesce(F.nullif("stage", F.lit("")), F.lit("other"))).withColumn("category", F.coalesce(F.nullif("category", F.lit("")), F.lit("unknown"))).withColumn("resolved", F.coalesce("resolved", F.lit(False)))


def purged(log: DataFrame, source: str = "all", stage: str = "", category: str = "", resolved: bool | None = None) -> DataFrame:
    """The log without the entries that all given conditions meet; 'all', '' and None are no condition, and no condition at all takes every entry."""
    gone = F.lit(True)
    for name, value in (("source", "" if source == "all" else source), ("stage", stage), ("category", category)):
        if value:
            gone &= F.coalesce(F.col(name) == value, F.lit(False))
    if resolved is not None:
        gone &= F.col("resolved") == resolved
    return log.where(~gone)


def valid_payload(json: Column) -> Column:
    """Whether a text is a JSON object, as payloads of jobs must be; null is not."""
    return F.coalesce(json.rlike(r"^\s*\{") & F.try_parse_json(json).isNotNull(), F.lit(False))
