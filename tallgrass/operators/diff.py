"""Snapshot diff in five passes, its safety check, plans and merges.

A snapshot is a table of files: path (its key), file_id, size, mtime, source,
content (a fingerprint) and kind; more columns are allowed. A later row of a
repeated path or file_id can't be told from an earlier one, so the one with the
greatest other columns counts. Null or empty file ids match nothing; null sizes
count as 0 in the third pass, as unknown sizes do match each other. Empty
snapshots give only added or only missing files.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tallgrass.functions.paths import basename, stem

#: Likeness of names above which a file counts as renamed.
ALIKE = 0.7
#: Shares of the old videos above which a diff is held back: missing, changed paths, change of the total.
MOST_MISSING, MOST_MOVED, MOST_CHANGED = 0.30, 0.30, 0.50
_FILE = ["path", "file_id", "size", "mtime", "source", "content", "kind"]


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common subsequence over that of the longer text: equal 1, one empty 0; null counts as empty."""

    def one(x: str | None, y: str | None) -> float:
        x, y = x or "", y or ""
        if x == y:
            return 1.0
        if not x or not y:
            return 0.0
        # Bit-parallel: a row of the table is one integer.
        places: dict[str, int] = {}
        for i, c in enumerate(x):
            places[c] = places.get(c, 0) | 1 << i
        row = full = (1 << len(x)) - 1
        for c in y:
            at = row & places.get(c, 0)
            row = (row + at | row - at) & full
        return (len(x) - row.bit_count()) / max(len(x), len(y))

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def changed(old: str, new: str) -> Column:
    """Whether a file at one path is another one, from structs of files. What is unknown is taken as unchanged: sizes first, then contents, then times; mounted sources refresh times and are left out of that."""
    o, n = F.col(old), F.col(new)
    size = o["size"].isNotNull() & n["size"].isNotNull() & (o["size"].cast("long") != n["size"].cast("long"))
    known = (F.coalesce(o["content"], F.lit("")) != "") & (F.coalesce(n["content"], F.lit("")) != "")
    mounted = o["source"].isin("baidu", "pan115", "openlist") & (o["source"] == n["source"])
    time = F.abs(o["mtime"] - n["mtime"]) > 0.001
    return F.coalesce(F.when(size, True).when(known, o["content"] != n["content"]).when(F.coalesce(mounted, F.lit(False)), False).otherwise(time), F.lit(False))


def _files(snapshot: DataFrame, name: str) -> DataFrame:
    return snapshot.where("path IS NOT NULL").groupBy("path").agg(F.max(F.struct(*_FILE[1:])).alias("f")).select(F.struct("path", "f.*").alias(name))


def compared(old: DataFrame, new: DataFrame, cut: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """change, old_path, new_path, kind, size of every file of two snapshots.

    Pass 1: equal paths are unchanged or replaced. Pass 2: of the rest, equal
    file ids are moved (same name), renamed (alike) or uncertain. Pass 3: of the
    rest, a pair that alone has its stem and size is moved, and a new file whose
    size and a name alike only one free old file has is renamed; where several
    new files want one old file, the smallest path gets it, in one round.
    Passes 4 and 5: added and missing.

    Passes 1 and 2 are one join and one window over file ids, in which settled
    files have keys of their own. `cut` can end the lineage after them (as a
    written table or checkpoint() does), as pass 3 reads what they leave several
    times and the result what they settle.
    """
    both = _files(old, "o").join(_files(new, "n"), F.col("o.path") == F.col("n.path"), "full")
    rows = both.select("o", "n", F.when(F.col("o").isNotNull() & F.col("n").isNotNull(), F.when(changed("o", "n"), "replaced").otherwise("unchanged")).alias("change"))
    file = lambda x: F.coalesce(f"n.{x}", f"o.{x}")
    name = lambda x: basename(f"{x}.path")
    own = F.concat(F.when(F.col("n").isNotNull(), "n:").otherwise("o:"), file("path"))

    free = F.col("change").isNull()
    rows = rows.withColumn("key", F.when(free & (file("file_id") != ""), F.concat(F.lit("#"), file("file_id"))).otherwise(own))
    group = Window.partitionBy("key")
    rows = rows.withColumns({"mo": F.max(F.when(free, F.col("o"))).over(group), "mn": F.max(F.when(free, F.col("n"))).over(group)})
    pair = free & F.col("mo").isNotNull() & F.col("mn").isNotNull()
    hit = pair & (F.col("n.path") == F.col("mn.path"))
    stems = [F.when(hit, stem(name(x))) for x in ("mo", "n")]
    verdict = F.when(name("mo") == name("n"), "moved").when(similarity(*stems) > ALIKE, "renamed").otherwise("uncertain")
    rows = _settled(rows, pair, hit, verdict)

    rows = cut(rows) if cut else rows
    settled, rows = rows.where(~free), rows.where(free)
    rows = _moved(rows)
    moved, rows = rows.where(~free), rows.where(free)
    gets = _alike(rows)
    gets = cut(gets) if cut else gets
    rows = rows.join(gets.select(F.col("new").alias("p"), F.col("old").alias("got")), F.col("n.path") == F.col("p"), "left")
    rows = rows.join(gets.select(F.col("old.path").alias("q")), F.col("n").isNull() & (F.col("o.path") == F.col("q")), "left_anti")
    change = F.when(F.col("got").isNotNull(), "renamed").when(F.col("n").isNotNull(), "added").otherwise("missing")
    rows = rows.select(F.coalesce("got", "o").alias("o"), "n", change.alias("change"))
    rows = settled.unionByName(moved).unionByName(rows)
    return rows.select("change", F.col("o.path").alias("old_path"), F.col("n.path").alias("new_path"), file("kind").alias("kind"), F.coalesce("n.size", "o.size", F.lit(0)).alias("size"))


def _moved(rows: DataFrame) -> DataFrame:
    """The first half of pass 3, of free rows (o, n, change): groups of one stem and size are counted before the shuffle and only the pairs come back, by path, so that a stem which very many files have costs no more than others."""
    path = F.coalesce("n.path", "o.path")
    keyed = rows.withColumns({"stem": stem(basename(path)), "bytes": F.coalesce("n.size", "o.size", F.lit(0))})
    group = keyed.groupBy("bytes", "stem").agg(F.count("o").alias("olds"), F.max("o").alias("mo"), F.min("n.path").alias("p"))
    pairs = group.where("olds = 1 AND p IS NOT NULL")
    rows = rows.join(pairs.select("p", "mo"), F.col("n.path") == F.col("p"), "left")
    rows = rows.join(pairs.select(F.col("mo.path").alias("q")), F.col("n").isNull() & (F.col("o.path") == F.col("q")), "left_anti")
    return rows.select(F.coalesce("mo", "o").alias("o"), "n", F.when(F.col("mo").isNotNull(), "moved").alias("change"))


def _settled(rows: DataFrame, pair: Column, hit: Column, verdict: Column) -> DataFrame:
    """rows (o, n, change, mo, mn): where a row is a hit, its new file and the group's old one are a pair; that old file's own row goes."""
    spent = pair & F.col("n").isNull() & (F.col("o.path") == F.col("mo.path"))
    rows = rows.where(~F.coalesce(spent, F.lit(False)))
    hit = F.coalesce(hit, F.lit(False))
    return rows.select(F.when(hit, F.col("mo")).otherwise(F.col("o")).alias("o"), "n", F.when(hit, verdict).otherwise(F.col("change")).alias("change"))


def _alike(free: DataFrame) -> DataFrame:
    """The second half of pass 3: (new, old) of new paths and the old files that they get.

    New files of one stem and size want the same old file and only the smallest
    path can get it, so one of them asks. A name's letters are a set of (letter,
    n-th time); names alike share more than ALIKE of the longer one's, hence two
    at least of the rarest letters of each (as many as its length less that
    share, and one more). Names meet on such pairs of letters, once on the first
    that they share.
    """
    olds = free.where("n IS NULL").select("o", stem(basename("o.path")).alias("stem"), F.coalesce("o.size", F.lit(0)).alias("bytes"))
    news = free.where("n IS NOT NULL").select(F.col("n.path").alias("new"), stem(basename("n.path")).alias("s"), F.coalesce("n.size", F.lit(0)).alias("b"))
    single = olds.groupBy("stem", "bytes").agg(F.max("o").alias("old"), F.count("*").alias("c")).where("c = 1").select("stem", "bytes", "old")
    asks = news.groupBy("s", "b").agg(F.min("new").alias("new"))
    single = single.join(asks.select(F.col("b").alias("bytes")).distinct(), "bytes", "left_semi")
    asks = asks.join(single.select(F.col("bytes").alias("b")).distinct(), "b", "left_semi")

    stems = single.select("stem").union(asks.select("s")).distinct().where(F.length("stem") > 1)
    sorted_letters = F.array_sort(F.filter(F.split("stem", ""), lambda c: c != ""))
    letters = stems.withColumn("l", sorted_letters).select("stem", F.explode(F.transform("l", lambda c, i: F.concat(c, (i - F.array_position("l", c)).cast("string")))).alias("t"))
    often = letters.groupBy("t").agg(F.count("*").alias("n"))  # letters times the longest name
    kept = F.length("stem") - F.floor(ALIKE * F.length("stem") - 1e-9).cast("int") + 1
    rarest = letters.join(often, "t").groupBy("stem").agg(F.array_sort(F.collect_list(F.struct("n", "t"))).alias("r"))
    rarest = rarest.select("stem", F.transform(F.slice("r", 1, kept), lambda x: x["t"]).alias("r"))
    pairs = F.flatten(F.transform("r", lambda x, i: F.transform(F.slice("r", i + 2, F.size("r")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    keys = rarest.select("stem", "r", F.explode(pairs).alias("k"))
    left = single.join(keys, "stem")
    right = asks.join(keys.select(F.col("stem").alias("s"), F.col("r").alias("x"), "k"), "s")
    shared = F.array_intersect("r", "x")
    near = (F.col("b") == F.col("bytes")) & (left["k"] == right["k"]) & (F.least(F.length("s"), F.length("stem")) > ALIKE * F.greatest(F.length("s"), F.length("stem")))
    met = left.join(right, near).where((shared[0] == left["k"]["a"]) & (shared[1] == left["k"]["b"]))
    alike = met.where(similarity(F.col("s"), F.col("stem")) > ALIKE)
    wants = alike.groupBy("new").agg(F.min(F.struct("old.path", "old")).alias("x")).select("new", "x.old")
    return wants.groupBy("old.path").agg(F.min(F.struct("new", "old")).alias("x")).select("x.new", "x.old")


def counts(diff: DataFrame) -> DataFrame:
    """One row: how many files of each change, and how many added videos."""
    kinds = ["added", "missing", "moved", "renamed", "replaced", "unchanged", "uncertain"]
    return diff.agg(*(F.count_if(F.col("change") == k).alias(k) for k in kinds), F.count_if((F.col("change") == "added") & (F.col("kind") == "video")).alias("added_videos"))


def safety(diff: DataFrame) -> DataFrame:
    """One row: old_videos, new_videos, the shares of missing, moved and changed, and blocked. Without old videos nothing is blocked and shares are 0."""
    video = F.col("kind") == "video"
    c = counts(diff).crossJoin(diff.agg(F.count_if(video & F.col("old_path").isNotNull()).alias("old_videos"), F.count_if(video & F.col("new_path").isNotNull()).alias("new_videos")))
    share = lambda x: F.coalesce(F.try_divide(x, F.col("old_videos")), F.lit(0.0))
    c = c.select("old_videos", "new_videos", share(F.col("missing")).alias("missing_share"), share(F.col("moved") + F.col("renamed") + F.col("uncertain")).alias("moved_share"), share(F.abs(F.col("new_videos") - F.col("old_videos"))).alias("changed_share"))
    return c.withColumn("blocked", (F.col("missing_share") > MOST_MISSING) | (F.col("moved_share") > MOST_MOVED) | (F.col("changed_share") > MOST_CHANGED))


def appends_only(diff: DataFrame) -> DataFrame:
    """One row: whether there are added videos and nothing else has changed."""
    other = F.count_if(~F.col("change").isin("added", "unchanged"))
    return diff.agg(((F.count_if((F.col("change") == "added") & (F.col("kind") == "video")) > 0) & (other == 0)).alias("safe"))


def incremental(diff: DataFrame) -> DataFrame:
    """Files that a plan has to take up: added and replaced videos and subtitles."""
    return diff.where(F.col("change").isin("added", "replaced") & F.col("kind").isin("video", "subtitle")).select("new_path", "change", "kind")


def same_snapshot(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row: whether two snapshots hold the same paths with the same sizes."""
    one = lambda df, side: df.groupBy("path", "size").agg(F.lit(1).alias(side))
    a, b = one(old, "a"), one(new, "b")
    odd = a.join(b, a.path.eqNullSafe(b.path) & a["size"].eqNullSafe(b["size"]), "full")
    return odd.agg((F.count_if(F.col("a").isNull() | F.col("b").isNull()) == 0).alias("same"))


def merged(base: DataFrame, diff: DataFrame) -> DataFrame:
    """A base plan (path, missing, note) with a diff folded in: moved items change path, missing ones are flagged and keep their row, ones seen again are revived, added ones come in."""
    moves = diff.where("old_path IS NOT NULL").select(F.col("old_path").alias("path"), "new_path", "change")
    kept = base.join(moves, "path", "left").select(F.coalesce("new_path", "path").alias("path"), F.when(F.col("change") == "missing", True).when(F.col("change").isNotNull(), False).otherwise(F.col("missing")).alias("missing"), "note")
    back = diff.where("change = 'added'").select(F.col("new_path").alias("path")).distinct().withColumn("back", F.lit(True))
    every = kept.join(back, "path", "full")
    return every.select("path", F.when(F.col("back"), False).otherwise(F.col("missing")).alias("missing"), F.coalesce("note", F.lit("new")).alias("note"))
