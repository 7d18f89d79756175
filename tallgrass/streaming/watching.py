"""Watch states of episodes from their actions, as a stream with state and timers, and as a table.

Actions: work_id, episode_id, at (timestamp), seq (tells equal times apart),
action, position, duration. 'play' tells a position, and completes an episode
from 95% on, for good; 'watch' and 'unwatch' are a user's marks; 'import' says
that a remote site has it as watched, which doesn't count while the user's last
word is 'unwatch'. Other and null actions, and rows without work_id, episode_id
or at, are left out; null or not finite positions and durations count as 0. A
row that comes twice counts once more, which changes nothing. An episode
without actions has no row.

A state is STATE: position, duration, ratio (4 places), completed, synced (the
remote side has it), unwatched (the user's last word), updated_at; live tells
whether a play came within LIVE before the last known time.

`streamed` folds actions as they come; within a micro-batch they are put in the
order (at, seq). `latest` gives the same for a table in two aggregates, without
sorting or gathering an episode's actions, so that one episode may hold most of
them. Where an action arrives in a batch after later ones, the stream takes it
as the newest, as a player's server does; the table puts it in its place.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallgrass.functions import score
from tallgrass.streaming.progress import COMPLETE

#: How long a session lives without a play.
LIVE = timedelta(minutes=30)
KEY = ["work_id", "episode_id"]
STATE = "position double, duration double, ratio double, completed boolean, synced boolean, unwatched boolean, updated_at timestamp"
RESULT = f"work_id string, episode_id string, {STATE}, live boolean"
#: The stream keeps times as microseconds, which don't hang on a worker's time zone.
_KEPT = STATE.replace("timestamp", "long")
_FOLDED = Row(*KEY, *(c.split()[0] for c in STATE.split(", ")), "live")
ACTIONS = ["play", "watch", "unwatch", "import"]


def _actions(rows: DataFrame) -> DataFrame:
    known = F.col("action").isin(*ACTIONS) & F.col("work_id").isNotNull() & F.col("episode_id").isNotNull() & F.col("at").isNotNull()
    number = lambda c: F.when(F.isnan(F.col(c)) | (F.abs(c) == float("inf")), 0.0).otherwise(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(c)
    return rows.where(known).select(*(F.col(c).cast("string").alias(c) for c in KEY), F.col("at").cast("timestamp").alias("at"), F.col("seq").cast("long").alias("seq"), "action", number("position"), number("duration"))


def folded(state: tuple | None, action: str, position: float, duration: float, at: datetime | int) -> tuple:
    """The state (as STATE has it, or None) after one action; its time is `at` as given."""
    p, d, ratio, completed, synced, unwatched, since = state or (0.0, 0.0, 0.0, False, False, False, None)
    if action == "play":
        share = max(0.0, min(1.0, position / duration)) if duration > 0 else 0.0
        done = duration > 0 and share >= COMPLETE
        # Half away from zero, as the columns round.
        return (position, duration, math.floor(share * 10_000 + 0.5) / 10_000, completed or done, synced, unwatched and not done, at)
    if action == "watch":
        return (1.0, 1.0, 1.0, True, synced, False, at)
    if action == "unwatch":
        return (0.0, 0.0, 0.0, False, False, True, at)
    if unwatched:
        return (p, d, ratio, completed, synced, unwatched, since)
    if completed:
        return (p, d, ratio, True, True, False, at)
    return (p or 1.0, d or 1.0, 1.0, True, True, False, at)


class Watching(StatefulProcessor):
    """Keeps an episode's state, and a timer that ends its session LIVE after the last play, by event time.

    All of it is one value, read and written once for each episode of a batch:
    the state, `until` (the session's end) and `timer` (the one registered, at
    `until` or before it; one that comes too early is set anew). Times are
    microseconds, those of timers milliseconds.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", f"{_KEPT}, until long, timer long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        kept = self.kept.get()
        state, until, timer = (None, None, None) if kept is None else (tuple(kept[:-2]), kept[-2], kept[-1])
        for r in sorted(rows, key=lambda r: (r.micros, r.seq is None, r.seq or 0)):
            state = folded(state, r.action, r.position, r.duration, r.micros)
            if r.action == "play":
                until = (r.micros + LIVE // timedelta(microseconds=1)) // 1000
        if until is not None and until <= timerValues.getCurrentWatermarkInMs():
            until = None
        if timer is not None and (until is None or until < timer):
            self.handle.deleteTimer(timer)
            timer = None
        if until is not None and timer is None:
            self.handle.registerTimer(until)
            timer = until
        self.kept.update((*state, until, timer))
        yield _FOLDED(*key, *state, until is not None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        kept = self.kept.get()
        state, until = tuple(kept[:-2]), kept[-2]
        if until > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(until)
            self.kept.update((*state, until, until))
            return
        self.kept.update((*state, None, None))
        yield _FOLDED(*key, *state, False)

    def close(self) -> None:
        pass


def streamed(actions: DataFrame, late: str = "1 hour") -> DataFrame:
    """RESULT of each episode that a micro-batch has actions of, and once more when its session ends. Output mode 'update'; the state store must be RocksDB. Rows later than `late` behind the newest are dropped."""
    rows = _actions(actions).withColumn("micros", F.unix_micros("at")).withWatermark("at", late)
    out = rows.groupBy(*KEY).transformWithState(statefulProcessor=Watching(), outputStructType=f"work_id string, episode_id string, {_KEPT}, live boolean", outputMode="Update", timeMode="EventTime")
    return out.withColumn("updated_at", F.timestamp_micros("updated_at"))


def latest(actions: DataFrame, now: Column | None = None) -> DataFrame:
    """RESULT of a table of actions, live as of `now` (the newest action's time if none is given)."""
    rows = _actions(actions).withColumn("o", F.struct("at", "seq"))
    end = rows.agg(F.max("at").alias("now")) if now is None else None
    done = F.when((F.col("duration") > 0) & (F.col("position") / F.col("duration") >= COMPLETE), True).otherwise(False)
    is_ = lambda a: F.col("action") == a
    rows = rows.withColumn("strong", is_("watch") | (is_("play") & done))
    taken = rows.where(is_("unwatch")).groupBy(*KEY).agg(F.max("o").alias("u"))
    rows = rows.join(taken, KEY, "left")
    of = lambda f, on, x="o": f(F.when(on, F.col(x)))
    after = F.col("u").isNull() | (F.col("o") > F.col("u"))
    told = F.when(~is_("import"), F.col("o"))
    e = rows.groupBy(*KEY).agg(
        F.max("u").alias("u"),
        of(F.min, F.col("strong") & after).alias("strong"),
        of(F.min, is_("import")).alias("first_import"),
        of(F.max, is_("import")).alias("last_import"),
        F.max(told).alias("told_at"),
        F.max_by(F.struct("action", "position", "duration"), told).alias("told"),
        of(F.max, is_("play"), "at").alias("played"),
    )
    free, strong, told, imported = F.col("u").isNull(), F.col("strong").isNotNull(), F.col("told"), F.col("last_import")
    # An import counts unless the user's last word stands; it moves the position only of an episode that wasn't completed before.
    counts = F.coalesce(F.when(free, imported.isNotNull()).otherwise(imported > F.col("strong")), F.lit(False))
    moves = free & ~strong & F.col("first_import").isNotNull() & (told.isNull() | (F.col("first_import") > F.col("told_at")))
    marked = F.when(told["action"] == "watch", 1.0).when(told["action"] == "unwatch", 0.0)
    position, duration = (F.coalesce(marked, told[c], F.lit(0.0)) for c in ("position", "duration"))
    ratio = F.coalesce(marked, score.progress_ratio(told["position"], told["duration"]))
    filled = lambda x: F.when(moves & (x == 0), 1.0).otherwise(x)
    updated = F.greatest(F.coalesce(F.col("told_at"), imported), F.when(counts, imported))
    if end is not None:
        e = e.crossJoin(F.broadcast(end))  # one row
    live = F.coalesce(F.col("played") + F.expr(f"INTERVAL {int(LIVE.total_seconds())} SECONDS") > (F.col("now") if now is None else now), F.lit(False))
    return e.select(
        *KEY,
        filled(position).alias("position"),
        filled(duration).alias("duration"),
        F.when(moves, 1.0).otherwise(ratio).alias("ratio"),
        (strong | (free & F.col("last_import").isNotNull())).alias("completed"),
        counts.alias("synced"),
        (~free & ~strong).alias("unwatched"),
        updated["at"].alias("updated_at"),
        live.alias("live"),
    )


def overlaid(states: DataFrame, sessions: DataFrame) -> DataFrame:
    """States with the positions of running sessions over them.

    Sessions: work_id, episode_id, position, duration, status, started_at. Only
    those 'playing' with a position of 0 or more and a positive duration, both
    finite, count, of several of one episode the last begun (then the farthest). They change position, duration
    and ratio, never marks; an episode without a state gets one that is not
    completed.
    """
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    runs = sessions.where((F.col("status") == "playing") & (F.coalesce("episode_id", F.lit("")) != "") & finite("position") & finite("duration") & (F.col("position") >= 0) & (F.col("duration") > 0))
    best = runs.groupBy(*KEY).agg(F.max(F.struct("started_at", "position", "duration")).alias("s"))
    both = states.join(best, KEY, "full")
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    pick = lambda c: F.coalesce(f"s.{c}", c).alias(c)
    ratio = F.when(F.col("s").isNotNull(), score.progress_ratio("s.position", "s.duration")).otherwise(F.col("ratio")).alias("ratio")
    return both.select(*KEY, pick("position"), pick("duration"), ratio, no("completed"), no("synced"), no("unwatched"), F.coalesce("updated_at", "s.started_at").alias("updated_at"), F.coalesce(F.col("s").isNotNull() | F.col("live"), F.lit(False)).alias("live"))
