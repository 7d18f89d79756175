"""Orders within groups: runs, offsets, samples, sessions and numbering, as windows over a group's own rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gap_free(rows: DataFrame, group: list[str], number: str) -> DataFrame:
    """Per group: n distinct numbers, least, most, and whether they run without a gap. Null numbers are left out; a group of only nulls has n 0 and is not gap-free.

    Numbers are told apart from the one before in a sort, which spills, and not in a hash table of all of them. Rows are dealt over
    all shuffle partitions: narrow rows compress well, so that AQE would pack many millions into one task.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    before = F.lag(number).over(Window.partitionBy(*group).orderBy(number))
    marked = rows.select(*group, number).repartition(parts, *group).withColumn("_new", F.when(~F.col(number).eqNullSafe(before), 1))
    g = marked.groupBy(*group).agg(F.count("_new").alias("n"), F.min(number).alias("least"), F.max(number).alias("most"))
    return g.withColumn("gap_free", F.coalesce((F.col("n") > 0) & (F.col("most") - F.col("least") + 1 == F.col("n")), F.lit(False)))


def contiguous_prefix(rows: DataFrame, group: list[str], number: str) -> DataFrame:
    """Per group: whether its distinct numbers are exactly 1 to n."""
    return gap_free(rows, group, number).withColumn("contiguous", F.col("gap_free") & (F.col("least") == 1)).select(*group, "n", "contiguous")


def normalised_runs(rows: DataFrame, group: list[str], number: str) -> DataFrame:
    """rows with number counted from 1 in groups that have two or more distinct numbers, begin at 10 or above and run without a gap."""
    runs = gap_free(rows, group, number).where("n >= 2 AND least >= 10 AND gap_free").select(*group, (F.col("least") - 1).alias("_off"))
    return rows.join(runs, group, "left").withColumn(number, F.col(number) - F.coalesce("_off", F.lit(0))).drop("_off")


def absolute_offset(parts: DataFrame, group: str, part: str, number: str) -> DataFrame:
    """Per (group, part): the sum of the largest numbers of all earlier parts, if each of these runs from 1 without a gap, else 0."""
    return offsets(gap_free(parts, [group, part], number), group, part)


def offsets(g: DataFrame, group: str, part: str) -> DataFrame:
    """absolute_offset from gap_free's row for each (group, part)."""
    before = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sound = F.coalesce(F.min((F.col("gap_free") & (F.col("least") == 1)).cast("int")).over(before), F.lit(1))
    return g.withColumn("offset", F.when(sound == 1, F.coalesce(F.sum("most").over(before), F.lit(0))).otherwise(0)).select(group, part, "offset")


def located(absolute: DataFrame, parts: DataFrame, group: str, number: str, part: str, count: str) -> DataFrame:
    """Absolute numbers as (part, place in it), from the running sum of the parts' counts; null beyond the last part."""
    upto = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, 0)
    bounds = parts.withColumn("_to", F.sum(count).over(upto)).select(group, part, F.col("_to"), (F.col("_to") - F.col(count)).alias("_from"))
    hit = absolute.select(group, number).distinct().join(bounds, group).where((F.col(number) > F.col("_from")) & (F.col(number) <= F.col("_to")))
    return absolute.join(hit.select(group, number, part, (F.col(number) - F.col("_from")).alias("place")), [group, number], "left")


def prefix_match(parts: DataFrame, group: str, part: str, count: str, local: DataFrame, local_count: str) -> DataFrame:
    """group, matched: whether a group's local count equals the running sum of its parts at some part; the parts (two or more, with a positive number and count) must be 1 to n."""
    good = parts.where((F.col(part) > 0) & (F.col(count) > 0))
    order = Window.partitionBy(group).orderBy(part)
    sums = good.withColumn("_sum", F.sum(count).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.row_number().over(order))
    found = sums.join(local.select(group, local_count), group).groupBy(group).agg((F.bool_or(F.col("_sum") == F.col(local_count)) & (F.count("*") >= 2) & F.bool_and(F.col("_n") == F.col(part))).alias("matched"))
    return local.select(group).join(found, group, "left").select(group, F.coalesce("matched", F.lit(False)).alias("matched"))


def even_sample(rows: DataFrame, group: str | None, order: list[Column], most: int) -> DataFrame:
    """`most` (two or more) rows of each group, evenly spread over it in `order`, first and last included; all rows of smaller groups.

    Places are i * (n - 1) / (most - 1), rounded to the nearest, halves to the even one.
    """
    by = [group] if group else []
    w = Window.partitionBy(*by)
    placed = rows.withColumn("_n", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_all", F.count("*").over(w))
    twice = lambda i: 2 * i * (F.col("_all") - 1)
    low = lambda i: F.floor(twice(i) / (2 * (most - 1)))
    rest = lambda i: twice(i) - low(i) * 2 * (most - 1)
    at = lambda i: low(i) + F.when((rest(i) > most - 1) | ((rest(i) == most - 1) & (low(i) % 2 == 1)), 1).otherwise(0)
    picks = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: at(i))
    return placed.where((F.col("_all") <= most) | F.array_contains(picks, F.col("_n").cast("long"))).drop("_n", "_all")


def sessions(logs: DataFrame, group: str, order: list[Column], starts: Column, attention: Column, ends: Column) -> DataFrame:
    """Per (group, session): n rows and state. A session begins at every row that `starts`; rows before the first are session 0. A row of attention marks it for good, else an end completes it, else it is active."""
    flagged = logs.select(group, starts.cast("int").alias("_s"), attention.cast("int").alias("_a"), ends.cast("int").alias("_e"), F.row_number().over(Window.partitionBy(group).orderBy(*order)).alias("_i"))
    numbered = flagged.withColumn("session", F.sum("_s").over(Window.partitionBy(group).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)))
    state = F.when(F.max("_a") == 1, "attention").when(F.max("_e") == 1, "complete").otherwise("active")
    return numbered.groupBy(group, "session").agg(F.count("*").alias("n"), state.alias("state"))


def renumbered_specials(rows: DataFrame, group: list[str], number: str, order: list[Column]) -> DataFrame:
    """rows with numbers that are null, not positive or taken by an earlier row replaced by the next ones after the group's largest."""
    keep = F.row_number().over(Window.partitionBy(*group, number).orderBy(*order)) == 1
    marked = rows.withColumn("_bad", F.coalesce(F.col(number) <= 0, F.lit(True)) | ~keep)
    top = F.coalesce(F.max(F.when(~F.col("_bad"), F.col(number))).over(Window.partitionBy(*group)), F.lit(0))
    nth = F.row_number().over(Window.partitionBy(*group, "_bad").orderBy(*order))
    return marked.withColumn(number, F.when(F.col("_bad"), top + nth).otherwise(F.col(number))).drop("_bad")


def continue_at(episodes: DataFrame, work: str, order: list[Column], last: Column, watched: Column, episode: str) -> DataFrame:
    """Per work the episode to go on with: the one of the history, else the first not watched in order, else the first."""
    n = F.row_number().over(Window.partitionBy(work).orderBy(*order))
    ranked = episodes.select(work, episode, F.coalesce(last, F.lit(False)).alias("_l"), F.coalesce(watched, F.lit(False)).alias("_w"), n.alias("_n"))
    first = F.struct((~F.col("_l")).alias("a"), F.col("_w").alias("b"), F.col("_n").alias("c"))
    return ranked.groupBy(work).agg(F.min_by(episode, first).alias(episode))


def collided(rows: DataFrame, key: list[str], folder: str, explicit: Column) -> DataFrame:
    """rows with `special`: where a key has both explicit and implicit rows, all rows of the implicit ones' folders are specials."""
    mixed = rows.withColumn("_e", explicit).groupBy(*key).agg((F.bool_or("_e") & ~F.bool_and("_e")).alias("_mixed")).where("_mixed")
    folders = rows.where(~explicit).join(mixed, key, "left_semi").select(folder).distinct().withColumn("special", F.lit(True))
    return rows.join(folders, folder, "left").withColumn("special", F.coalesce("special", F.lit(False)))
