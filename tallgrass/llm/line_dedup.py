"""Removal of lines that an earlier line matches, by an exact set-similarity join, on the JVM only.

A line's set holds its distinct `gram`-word shingles (a shorter line's only one
is the whole line). Lines match when the Jaccard similarity of their sets is at
least `percent` / 100. A line goes when an earlier line matches it; lines are
judged on the input, not on what is left. Earlier means smaller in (doc_id, row,
line number), where the row is told by a hash of its text.

Lines of equal words are one from the start, the first of them, so a line that a
third of all documents repeat is one. Two matching sets share tokens in their
prefixes, in any order of all tokens. A first pass orders them by the count of
their first word, in a hashed table of fixed size, and takes every line's prefix
without making its set: the bound is a place in its sorted distinct first words,
each of which has a token at least, and only shingles up to it are hashed. Lines
of which others have as many of these tokens as a match needs are candidates.
Their sets are built, and their tokens ordered by exact count over all
candidates, then by hash; only tokens that another has can be shared. Length and
positional filters and bitmaps of the sets drop most pairs that share a prefix
token, and the others are verified on the tokens that a set shares with any
other, as the rest of its tokens can't be in common.

Lines that share a prefix token are never all paired at once: each first meets
the earliest and the most typical line of its token, and only lines that these
have not removed meet all the others.

Defined results: a line without words is kept and matches nothing; a null text
has no lines; rows with a null doc_id keep their lines and remove none; rows of
one doc_id and one text are one, whose equal lines at one place don't remove one
another; rows of one doc_id with different texts are told apart by 31 bits of
their texts' hash. Other columns pass through `deduplicated` untouched.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, partitions, release, stored

GRAM, PERCENT = 5, 80
#: Bytes of lines whose prefix tokens one partition takes, on average; there are never fewer than the shuffle's.
BUCKET_BYTES = 24 << 20
#: Slots of the rarity table, whatever the corpus.
SLOTS = 1 << 16
#: Tokens that matching lines share up to their bounds: each more costs a token a line and spares candidates.
MEETINGS = 3
_ID = ["doc_id", "line_no"]
_KEYS = ["k1", "k2"]


def _row() -> Column:
    """What tells rows of one doc_id apart: 31 bits of the text's hash, above 32 bits for a line number."""
    return F.shiftleft(F.xxhash64("text").bitwiseAND(F.lit((1 << 31) - 1)), 32)


# Outer generators here have an element for every row; of others Spark asks for a size above 0 first, which makes the array twice.


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (the row's tag and the line's number), line (its words joined by one blank), k1 and k2 (128 bits of it) of every line with a word, of documents with a doc_id."""
    each = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", _row().alias("row"), F.posexplode_outer(F.split("text", "\n")).alias("nth", "line"))
    each = each.where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    line = F.col("line")
    odd = line.rlike(r"[\x09-\x0D]") | line.contains("  ") | line.startswith(" ") | line.endswith(" ")
    line = F.when(odd, F.btrim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " "))).otherwise(line)
    each = each.select("doc_id", F.col("row").bitwiseOR(F.col("nth").cast("long")).alias("line_no"), line.alias("line"))
    return each.select("*", F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(1), "line").alias("k2"))


def _rarity(firsts: DataFrame) -> str:
    """Name of a session variable with the places of SLOTS slots of hashed words in the order of their counts in all lines.

    A variable takes the table into the plan as a constant: neither a subquery
    nor a column could be read inside a lambda without a copy for every row.
    """
    spark = firsts.sparkSession
    each = firsts.select(F.explode_outer(F.split("line", " ")).alias("w")).select(_slot(F.col("w")).alias("slot"))
    every = spark.range(SLOTS).select(F.col("id").cast("int").alias("slot"))
    rows = every.join(each.groupBy("slot").count(), "slot", "left").select(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "slot").alias("row"))
    ranks = rows.agg(F.sort_array(F.collect_list("row")).alias("rows")).select(F.posexplode("rows").alias("rank", "row"))
    table = ranks.agg(F.transform(F.sort_array(F.collect_list(F.struct("row.slot", "rank"))), lambda r: r["rank"]).alias("ranks"))
    name = f"line_rarity_{uuid.uuid4().hex}"
    spark.sql(f"DECLARE VARIABLE {name} ARRAY<INT>")
    spark.sql(f"SET VARIABLE {name} = (SELECT ranks FROM {{table}})", table=table)
    return name


def _slot(word: Column) -> Column:
    return F.hash(word).bitwiseAND(F.lit(SLOTS - 1))


def _rank(word: Column, ranks: str) -> Column:
    """Never null, so that arrays of ranks are sorted as plain integers."""
    return F.coalesce(F.get(F.expr(ranks), _slot(word)), F.lit(0))


def _least(n: Column, percent: int) -> Column:
    """ceil(n * percent / 100): of how many of its n tokens a set shares at least with one that it matches."""
    return F.floor((n * percent + 99) / 100).cast("int")


def _candidates(firsts: DataFrame, ranks: str, gram: int, percent: int, parts: int) -> DataFrame:
    """k1 of the lines that share enough tokens up to their bound with other lines, stored. Lines of fewer than gram words match equal ones only.

    Words stand for their slots here: that may share tokens that differ, never part equal ones.
    """
    rows = firsts.select("k1", F.transform(F.split("line", " "), lambda w: _rank(w, ranks)).alias("h"))
    rows = rows.select("k1", "h", F.greatest(F.size("h") - (gram - 1), F.lit(0)).alias("n"))
    rows = rows.select("k1", "h", "n", F.sort_array(F.array_distinct(F.slice("h", F.lit(1), F.col("n")))).alias("starts"))
    bound = F.get("starts", F.col("n") - _least(F.col("n"), percent) + (MEETINGS - 1))
    need = F.least(F.lit(MEETINGS), _least(F.size("starts"), percent))
    rows = rows.select("k1", "h", "n", need.alias("need"), F.coalesce(bound, F.lit(SLOTS)).alias("bound"))
    each = rows.select("k1", "h", "n", "need", "bound", F.posexplode_outer("h").alias("pos", "w")).where("pos < n AND w <= bound")
    token = F.xxhash64("w", *(F.get("h", F.col("pos") + i) for i in range(1, gram)))
    each = each.select("k1", "need", token.alias("token")).repartition(parts, "token")
    shared = each.withColumn("times", F.expr("count(1) OVER (PARTITION BY token)")).where("times > 1")
    return stored(shared.groupBy("k1").agg(F.count("*").alias("shared"), F.min("need").alias("need")).where("shared >= need").select("k1"), "candidates")


def _sets(lines: DataFrame, gram: int, percent: int) -> DataFrame:
    """Of candidates with a shared token in their prefix: doc_id, line_no, n (the set's size), typical (mean logarithm of its tokens' counts), tokens (those that other candidates have, rarest first), prefix (how many of them any match shares one of) and bits; stored."""
    rows = lines.select(*_ID, F.transform(F.split("line", " "), lambda w: F.xxhash64(w)).alias("h"))
    some = F.greatest(F.size("h") - (gram - 1), F.lit(0))
    shingles = F.arrays_zip(*(F.slice("h", F.lit(i + 1), some).alias(f"w{i}") for i in range(gram)))
    rows = rows.select(*_ID, F.array_distinct(F.transform(shingles, lambda s: F.xxhash64(s))).alias("tokens"))
    each = stored(rows.select(*_ID, F.size("tokens").alias("n"), F.explode_outer("tokens").alias("token")), "tokens")
    times = each.groupBy("token").agg(F.count("*").alias("times")).where("times > 1")
    own = each.join(times.hint("merge"), "token").groupBy(*_ID).agg(F.first("n").alias("n"), F.sum(F.log2("times")).alias("typical"), F.sort_array(F.collect_list(F.struct("times", "token"))).alias("list"))
    prefix = F.col("n") - _least(F.col("n"), percent) + 1 - (F.col("n") - F.size("list"))
    own = own.select(*_ID, "n", (F.col("typical") / F.col("n")).alias("typical"), F.least(prefix, F.size("list")).alias("prefix"), F.transform("list", lambda x: x["token"]).alias("tokens"))
    own = stored(own.where("prefix > 0"), "own")
    sets = stored(own.withColumn("bits", _bitmap()), "sets")
    release(each, own)
    return sets


def _may_match(percent: int) -> Column:
    """Length and positional filters for rows a and b that share a token at a.pos and b.pos (from 0)."""
    a, b = F.col("a.n"), F.col("b.n")
    least = F.ceil((a + b) * percent / (100 + percent))
    rest = F.least(a - F.col("a.pos"), b - F.col("b.pos"))
    return (100 * F.least(a, b) >= percent * F.greatest(a, b)) & (rest >= least)


def _bitmap() -> Column:
    """Four 64-bit words in which each of the tokens sets one bit."""
    bit = "if(((x >> 6) & 3) = {}, shiftleft(1L, cast(x & 63 AS int)), 0L)"
    return F.array(*(F.expr(f"aggregate(tokens, 0L, (bits, x) -> bits | {bit.format(i)})") for i in range(4)))


def _bits_allow(percent: int) -> Column:
    """Bits that differ, and tokens that no other set has, bound from below the tokens that differ, so from above the overlap of rows a and b."""
    differ = sum((F.bit_count(F.get("a.bits", F.lit(i)).bitwiseXOR(F.get("b.bits", F.lit(i)))) for i in range(4)), F.lit(0))
    return (100 + percent) * (differ + F.col("a.alone") + F.col("b.alone")) <= (100 - percent) * (F.col("a.n") + F.col("b.n"))


def _removed_by(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The later lines (doc_id, line_no) of pairs whose sets match; pairs: d1, l1 (earlier), doc_id, line_no."""
    one = sets.select(F.col("doc_id").alias("d1"), F.col("line_no").alias("l1"), F.col("tokens").alias("t1"), F.col("n").alias("n1"))
    both = pairs.distinct().join(sets, _ID).join(one, ["d1", "l1"])
    common = F.size(F.array_intersect("tokens", "t1"))
    return both.where(100 * common >= percent * (F.col("n") + F.col("n1") - common)).select(*_ID).distinct()


def _near(sets: DataFrame, percent: int) -> DataFrame:
    """Of first lines with their shared tokens, those (doc_id, line_no) that an earlier one matches, stored."""
    alone = F.col("n") - F.size("tokens")
    bits = sets.select(*_ID, "n", "typical", alone.alias("alone"), "bits", F.posexplode(F.slice("tokens", F.lit(1), F.col("prefix"))).alias("nth", "token"))
    # Tokens that no other line has are not listed but come first in the order: they count for the places.
    bits = bits.withColumn("pos", F.col("nth") + F.col("alone")).drop("nth")
    grouped = bits.groupBy("token").agg(F.count("*").alias("times"), F.min(F.struct(*_ID, "n", "pos", "alone", "bits")).alias("first"), F.max(F.struct("typical", -F.col("doc_id"), -F.col("line_no"), *_ID, "n", "pos", "alone", "bits")).alias("met"))
    shared = stored(bits.join(grouped.where("times > 1").drop("times"), "token"), "shared")
    pair = lambda a, b: [F.col(f"{b}.doc_id").alias("d1"), F.col(f"{b}.line_no").alias("l1"), F.col(f"{a}.doc_id").alias("doc_id"), F.col(f"{a}.line_no").alias("line_no")]
    earlier = lambda a, b: F.struct(f"{b}.doc_id", f"{b}.line_no") < F.struct(f"{a}.doc_id", f"{a}.line_no")
    may = _may_match(percent) & _bits_allow(percent)
    own = F.struct(*_ID, "n", "pos", "alone", "bits")
    of = lambda name: shared.select(own.alias("a"), F.col(name).alias("b")).where(earlier("a", "b") & may).select(*pair("a", "b"))
    removed = stored(_removed_by(of("first").union(of("met")), sets, percent), "removed")
    left = shared.drop("first", "met").join(removed, _ID, "left_anti").alias("a")
    rest = left.join(shared.drop("first", "met").alias("b"), (F.col("a.token") == F.col("b.token")) & earlier("a", "b") & may)
    near = stored(removed.unionByName(_removed_by(rest.select(*pair("a", "b")), sets, percent)).distinct(), "near")
    release(shared, removed)
    return near


def removed_lines(docs: DataFrame, gram: int = GRAM, percent: int = PERCENT, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, line_no (the row's tag and the line's number) of every line that an earlier line matches, stored."""
    spark, lines = docs.sparkSession, _lines(docs)
    firsts = lines.groupBy(*_KEYS).agg(F.min(F.struct(*_ID, "line")).alias("first"), F.count("*").alias("times"))
    firsts = stored(firsts.select(*_KEYS, "first.*", "times", F.octet_length("first.line").alias("size")), "firsts")
    parts = max(partitions(spark), 1 + (firsts.agg(F.sum("size")).first()[0] or 0) // bucket_bytes)
    ranks = _rarity(firsts)
    found = _candidates(firsts, ranks, gram, percent, parts)
    spark.sql(f"DROP TEMPORARY VARIABLE IF EXISTS {ranks}")
    # Candidates grow with the lines: a merge join at every size, in place of a broadcast at small ones.
    sets = _sets(firsts.join(found.hint("merge"), "k1", "left_semi"), gram, percent)
    near = _near(sets, percent)
    release(found, sets)
    marked = firsts.select(*_KEYS, *_ID, "times").join(near.withColumn("near", F.lit(True)), _ID, "left").where("near OR times > 1")
    # Stored, both sides of the join are plain shuffles, of which Spark splits the hot line's.
    marked = stored(marked.select(*_KEYS, F.col("doc_id").alias("d"), F.col("line_no").alias("l"), "near"), "marked")
    copy = F.struct(*_ID) > F.struct("d", "l")
    removed = stored(lines.select(*_ID, *_KEYS).join(marked, _KEYS).where(copy | F.col("near")).select(*_ID), "removed")
    release(firsts, near, marked)
    return removed


def _gone(docs: DataFrame, gram: int, percent: int) -> DataFrame:
    """doc_id, tag (of a row) and removed, the sorted numbers of its removed lines, of rows with any."""
    number = F.col("line_no").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
    gone = removed_lines(docs, gram, percent).groupBy("doc_id", F.shiftleft(F.shiftright("line_no", 32), 32).alias("tag"))
    return gone.agg(F.array_sort(F.collect_set(number)).alias("removed"))


def _tag() -> Column:
    return F.when(F.col("text").isNotNull(), _row()).alias("tag")


def summary(docs: DataFrame, gram: int = GRAM, percent: int = PERCENT) -> DataFrame:
    """Per row: doc_id, n_lines (with a word or not; null text: 0), n_removed, removed_lines (line numbers from 0)."""
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long")
    rows = docs.select("doc_id", _tag(), n_lines.alias("n_lines")).join(_gone(docs, gram, percent), ["doc_id", "tag"], "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return rows.select("doc_id", "n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed_lines"))


def deduplicated(docs: DataFrame, gram: int = GRAM, percent: int = PERCENT) -> DataFrame:
    """docs without the removed lines; n_chars, if there, follows. A document whose lines with words all go goes itself."""
    left = lambda x: F.array_except(F.sequence(F.lit(0), F.size(x) - 1), "removed")
    kept = let(F.split("row.text", "\n"), lambda x: F.array_join(F.transform(left(x), lambda i: F.get(x, i)), "\n"))
    rows = docs.select("doc_id", _tag(), F.struct("*").alias("row")).join(_gone(docs, gram, percent), ["doc_id", "tag"], "left").select("row", "removed")
    rows = rows.withColumn("kept", F.when(F.col("removed").isNotNull(), kept))
    rows = rows.where(F.col("removed").isNull() | F.col("kept").rlike(r"[^\x20\x09-\x0D]"))
    new = {"text": F.col("kept"), "n_chars": F.char_length("kept")}
    column = lambda f: F.when(F.col("removed").isNotNull(), new[f.name].cast(f.dataType)).otherwise(F.col("row")[f.name]) if f.name in new else F.col("row")[f.name]
    return rows.select(*(column(f).alias(f.name) for f in docs.schema))
