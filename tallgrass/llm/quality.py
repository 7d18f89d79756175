"""Quality rules: text statistics and a hashed n-gram log-likelihood ratio, on the JVM only.

Word unigrams and bigrams are hashed into `buckets`. Their counts over every
document (raw) and over trusted documents (target) give two multinomials; a
document's score is the mean of log(p_target / p_raw) over its n-grams, and a
document is kept when no base rule fails and its score reaches a threshold.
The target is smoothed by a constant share of the raw multinomial, so that an
n-gram that no trusted document has costs the same at every corpus size. One
trusted document in HELD_OUT is left out of the target; the threshold is a low
quantile of these documents' scores, as a document that formed the target
scores higher than an equally good one that did not.

Counting is one pass with map-side sums by bucket. The log-ratios, one double
for each bucket whatever the corpus size, reach the scoring pass as a scalar
subquery, so scoring neither joins nor shuffles documents. Texts meet the
trusted ids in a plain merge join at every size; a bitmap of the ids' hashes, of
a fixed size, spares most other texts the way there, and the join tells exactly.

Defined results: a null or wordless text has no words, zero statistics, a null
score and fails the base rules; without trusted text every score is 0; without
held-out text of LEAST words the score rejects nothing; rows
are judged one by one, so repeated rows get equal verdicts. Other columns pass
through `clean` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, split_words, stored

BUCKETS = 1 << 16
#: Of so many trusted documents one is held out of the target; the threshold is this quantile of the scores of those held out.
HELD_OUT, QUANTILE = 5, 0.02
#: Weight of the raw multinomial in the smoothed target, that of trusted text being 1.
SMOOTHING = 1.0
#: Words that a kept document has.
LEAST = 50
#: Words of 64 bits of the bitmap of trusted ids. With more ids than bits it lets nearly every text pass to the join, which costs disk and no result.
ID_WORDS = 1 << 18
_SYMBOLS = r"[#*$%&|<>]"


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id of all rows labelled of good quality and not toxic, each once."""
    return labels.where("quality = 1 AND toxic = 0 AND doc_id IS NOT NULL").select("doc_id").distinct()


def id_bits(ids: DataFrame, words: int = ID_WORDS) -> DataFrame:
    """One row, one column: a bitmap of the hashes of doc_id, as an array of `words` longs."""
    h = F.xxhash64(F.col("doc_id").cast("string"))
    some = ids.select(_bucket(F.shiftright(h, 6), words).alias("word"), h.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
    some = some.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    every = ids.sparkSession.range(words).select(F.col("id").cast("int").alias("word")).join(some, "word", "left").na.fill(0, ["bits"])
    rows = every.agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("rows"))
    return rows.select(F.transform("rows", lambda r: r["bits"]).alias("bits"))


def likely(bits: DataFrame, words: int = ID_WORDS) -> Column:
    """Whether doc_id can be among the ids of id_bits; false only where it is not."""
    h = F.xxhash64(F.col("doc_id").cast("string"))
    return F.getbit(F.get(bits.scalar(), _bucket(F.shiftright(h, 6), words)), h.bitwiseAND(F.lit(63)).cast("int")) == 1


def windows_of_three(hashes: Column) -> Column:
    """Hashes of all three consecutive words of a text, from the hashes of its words."""
    each = F.transform(hashes, lambda x, i: F.xxhash64(x, F.get(hashes, i + 1), F.get(hashes, i + 2)))
    return F.when(F.size(hashes) < 3, F.slice(each, F.lit(1), F.lit(0))).otherwise(F.slice(each, F.lit(1), F.size(hashes) - 2))


def n_repeat_words(windows: Column) -> Column:
    """Words covered by windows that occur twice or more in the text, the first included.

    Windows are compared by a 64-bit hash within one text. Only texts in which
    one repeats are sorted.
    """

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, i: F.coalesce(F.least(F.get(at, i + 1) - p, F.lit(3)), F.lit(3)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def positions(s: Column) -> Column:
        same = F.filter(s, lambda e, i: F.coalesce(e["h"] == F.get(s, i - 1)["h"], F.lit(False)) | F.coalesce(e["h"] == F.get(s, i + 1)["h"], F.lit(False)))
        return F.sort_array(F.transform(same, lambda e: e["p"]))

    by_hash = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(let(by_hash, lambda s: let(positions(s), covered)))


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line of the text."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def base_failed(n_words: Column, repeat_words: Column, least: int = LEAST, percent: int = 50) -> Column:
    return (n_words < least) | (100 * repeat_words > percent * n_words)


def word_hashes(text: Column) -> Column:
    return F.transform(split_words(text), lambda w: F.xxhash64(w))


def bigrams(hashes: Column, of) -> Column:
    """of(hash) for each two consecutive words."""
    return F.zip_with(F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - 1, F.lit(0))), F.slice(hashes, F.lit(2), F.greatest(F.size(hashes), F.lit(0))), lambda a, b: of(F.xxhash64(a, b)))


def _bucket(h: Column, buckets: int) -> Column:
    return F.pmod(h, F.lit(buckets)).cast("int")


def log_ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING, may: Column | None = None) -> DataFrame:
    """One row, one column: the array of log(p_target / p_raw) by bucket.

    trusted: distinct doc_ids, of any number; may: true for all rows of docs that have one (see `likely`). All documents count as raw.
    """
    may = F.lit(True) if may is None else may
    marked = docs.where(may).select("doc_id", "text").join(trusted.withColumn("trusted", F.lit(1)).hint("merge"), "doc_id", "left").select("trusted", "text")
    marked = marked.unionByName(docs.where(~may).select(F.lit(None).cast("int").alias("trusted"), "text"))
    hashes = marked.select("trusted", word_hashes(F.col("text")).alias("h"))
    each = hashes.select("trusted", F.explode(F.concat("h", bigrams(F.col("h"), lambda x: x))).alias("h"))
    each = each.select("trusted", _bucket(F.col("h"), buckets).alias("bucket"))
    counts = each.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("trusted").alias("target"))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    counts = every.join(counts, "bucket", "left").na.fill(0, ["raw", "target"])
    rows = counts.agg(F.sum("raw").alias("n"), F.sum("target").alias("m"), F.sort_array(F.collect_list(F.struct("bucket", "raw", "target"))).alias("rows"))
    times = lambda r: r["target"] * F.col("n") / (F.col("m") * r["raw"])
    ratio = lambda r: F.when((F.col("m") == 0) | (r["raw"] == 0), F.lit(0.0)).otherwise(F.log((times(r) + F.lit(smoothing)) / F.lit(1 + smoothing)))
    return rows.select(F.transform("rows", ratio).alias("ratios"))


def _scored(docs: DataFrame, ratios: DataFrame, buckets: int) -> tuple[DataFrame, Column, Column]:
    """docs with the columns __ratios, __words and __hashes, and from these the number of words and the score."""
    hashes = F.col("__hashes")
    ratio = lambda h: F.get(F.col("__ratios"), _bucket(h, buckets))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    rows = docs.withColumn("__ratios", ratios.scalar()).withColumn("__words", split_words(F.col("text")))
    rows = rows.withColumn("__hashes", F.transform("__words", lambda w: F.xxhash64(w)))
    n_words = F.size("__words").cast("long")
    score = (total(F.transform(hashes, ratio)) + total(bigrams(hashes, ratio))) / F.nullif(2 * n_words - 1, F.lit(-1))
    return rows, n_words, score


def held_out_threshold(docs: DataFrame, held_out: DataFrame, ratios: DataFrame, buckets: int = BUCKETS, quantile: float = QUANTILE, may: Column | None = None) -> DataFrame:
    """One row, one column: the quantile of the scores of the documents held out that have LEAST words; minus infinity if there are none. may: as in log_ratios."""
    some = docs if may is None else docs.where(may)
    rows, n_words, score = _scored(some.select("doc_id", "text").join(held_out.hint("merge"), "doc_id"), ratios, buckets)
    rows = rows.select(F.when(n_words >= LEAST, score).alias("score"))
    return rows.agg(F.coalesce(F.percentile("score", quantile), F.lit(float("-inf"))).alias("threshold"))


def judged(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, threshold: float | None = None, name: str = "quality") -> DataFrame:
    """docs with the column `name`: a struct of the statistics, base_failed, score and kept. threshold: that of the documents held out, if None.

    Intermediate arrays are columns of their own, as an expression inside a
    lambda would run for every element and outside generated code. The result
    can be filtered by the verdict at no further cost.
    """
    held = F.pmod(F.hash("doc_id"), F.lit(HELD_OUT)) == 0
    may = likely(stored(id_bits(trusted), "ids"))
    ratios = stored(log_ratios(docs, trusted.where(~held), buckets, may=may), "ratios")
    least = F.lit(threshold) if threshold is not None else stored(held_out_threshold(docs, trusted.where(held), ratios, buckets, may=may & held), "threshold").scalar()
    text, hashes, windows = F.col("text"), F.col("__hashes"), F.col("__windows")
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != name)).alias("row"), "text")
    rows, n_words, score = _scored(packed, ratios, buckets)
    words = F.col("__words")
    rows = rows.withColumn("__least", least).withColumn("__windows", windows_of_three(hashes))
    parts = F.struct(
        n_words.alias("n_words"),
        F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.coalesce(F.regexp_count(text, F.lit(_SYMBOLS)), F.lit(0)).cast("long").alias("n_symbols"),
        n_dup_lines(text).alias("n_dup_lines"),
        n_repeat_words(windows).alias("n_repeat_words"),
        score.alias("score"),
    )

    def verdict(q: Column) -> Column:
        failed = base_failed(q["n_words"], q["n_repeat_words"])
        kept = ~failed & F.coalesce(q["score"] >= F.col("__least"), F.lit(False))
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        return F.struct(*(q[n].alias(n) for n in names), failed.alias("base_failed"), q["score"].alias("score"), kept.alias("kept"))

    # A filter would be pushed below the verdict, with all expressions nested into it and run for every element; it stays above a generator.
    rows = rows.withColumn("__parts", parts).select("row", F.explode(F.array(let(F.col("__parts"), verdict))).alias("__verdict"))
    return rows.select("row.*", F.col("__verdict").alias(name))


def clean(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, threshold: float | None = None) -> DataFrame:
    """The documents that are kept, with docs' own columns."""
    packed = docs.select("doc_id", "text", F.struct("*").alias("row"))
    return judged(packed, trusted, buckets, threshold).where("quality.kept").select("row.*")
