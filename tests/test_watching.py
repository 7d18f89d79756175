"""Watch states: the table's two aggregates, the fold of one action after another, and the stream agree."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Row

from tallgrass.streaming import watching

ROW = "work_id string, episode_id string, at timestamp, seq long, action string, position double, duration double"
START = datetime(2024, 1, 1)
STORE = "spark.sql.streaming.stateStore.providerClass"


def actions(seed, episodes=40, most=9):
    r = random.Random(seed)
    rows = [("w", f"e{e}", r.choice(watching.ACTIONS), r.choice([0.0, 10.0, 50.5, 96.0, 200.0]), r.choice([0.0, 100.0, 100.0])) for e in range(episodes) for _ in range(r.randint(1, most))]
    r.shuffle(rows)
    return [(w, e, START + timedelta(minutes=i // 3), i, a, p, d) for i, (w, e, a, p, d) in enumerate(rows)]


def by_fold(rows):
    states = {}
    for w, e, at, _, action, position, duration in sorted(rows, key=lambda x: (x[2], x[3])):
        states[w, e] = watching.folded(states.get((w, e)), action, position, duration, at)
    return states


def plain(rows):
    return {(r.work_id, r.episode_id): tuple(r)[2:9] for r in rows}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_table_is_the_fold(spark, seed):
    rows = actions(seed, 200)
    df = spark.createDataFrame(rows, ROW).repartition(5)
    got = plain(watching.latest(df.union(df.limit(300))).collect()) if seed == 1 else plain(watching.latest(df).collect())
    assert got == by_fold(rows)


def test_odd_rows(spark):
    odd = [(None, "e", START, 1, "play", 1.0, 2.0), ("w", None, START, 1, "play", 1.0, 2.0), ("w", "e", None, 1, "watch", None, None), ("w", "e", START, 1, "other", 1.0, 2.0), ("w", "e", START, 1, None, 1.0, 2.0)]
    kept = [("w", "f", START, None, "play", None, 5.0), ("w", "g", START, 1, "play", float("nan"), 5.0), ("w", "h", START, 1, "play", 1.0, float("inf")), ("w", "i", START, 1, "play", -1.0, 4.0)]
    got = plain(watching.latest(spark.createDataFrame(odd + kept, ROW)).collect())
    assert got == {("w", e): (p, d, 0.0, False, False, False, START) for e, p, d in (("f", 0.0, 5.0), ("g", 0.0, 5.0), ("h", 1.0, 0.0), ("i", -1.0, 4.0))}
    assert watching.latest(spark.createDataFrame([], ROW)).count() == 0


def test_stream_over_three_batches_and_a_restart(spark, tmp_path):
    """After each batch, and over a restart from the checkpoint, the stream's last rows are the table's; a session ends by its timer."""
    rows = actions(7)
    thirds = [rows[: len(rows) // 3], rows[len(rows) // 3 : 2 * len(rows) // 3], rows[2 * len(rows) // 3 :]]
    later = [("w", "last", START + timedelta(days=1), 10**6, "watch", 0.0, 0.0)]
    seen, live = {}, {}

    def keep(batch, _):
        for r in batch.collect():
            seen[r.work_id, r.episode_id] = tuple(r)[2:9]
            live[r.work_id, r.episode_id] = r.live

    old = spark.conf.get(STORE)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for n, part in enumerate([*thirds, later]):
            spark.createDataFrame(part, ROW).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
            stream = spark.readStream.schema(ROW).parquet(f"{tmp_path}/in/*")
            query = watching.streamed(stream).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start()
            assert query.awaitTermination(200)
            done = [r for p in [*thirds, later][: n + 1] for r in p]
            assert seen == by_fold(done)
            if n == 2:
                assert any(live.values())
        assert not any(live.values())
    finally:
        spark.conf.set(STORE, old)
    table = plain(watching.latest(spark.createDataFrame(rows + later, ROW)).collect())
    assert table == seen


class _Handle:
    """Counts what the processor asks of the state store."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), []

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def registerTimer(self, at):
        self.calls.append("register")
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls.append("delete")
        self.timers.remove(at)

    def getCurrentWatermarkInMs(self):
        return self.now


def test_one_read_and_one_write_an_episode(spark):
    """A play after a play asks for the value once and writes it once; its timer is set anew when the old one comes."""
    h, w, row, minute = _Handle(), watching.Watching(), Row("micros", "seq", "action", "position", "duration"), 60_000_000
    w.init(h)
    h.now = 0
    play = lambda at: [tuple(r) for r in w.handleInputRows(("w", "e"), iter([row(at * minute, 1, "play", 10.0, 100.0)]), h)]
    assert play(0)[0][-1] and h.calls == ["get", "register", "update"] and h.timers == {30 * 60_000}
    h.calls.clear()
    assert play(20)[0][-1] and h.calls == ["get", "update"]
    h.now, h.timers = 40 * 60_000, set()
    assert list(w.handleExpiredTimer(("w", "e"), h, None)) == [] and h.timers == {50 * 60_000}
    play(5)  # late: its session is over
    assert h.timers == set()
    play(30)
    h.now, h.timers = 60 * 60_000, set()
    assert [tuple(r)[-1] for r in w.handleExpiredTimer(("w", "e"), h, None)] == [False] and h.timers == set()


def test_sessions_over_states(spark):
    states = watching.latest(spark.createDataFrame([("w", "a", START, 1, "watch", None, None), ("w", "b", START, 1, "play", 1.0, 4.0)], ROW))
    row = "work_id string, episode_id string, position double, duration double, status string, started_at timestamp"
    soon = START + timedelta(hours=1)
    sessions = [("w", "a", 1.0, 3.0, "playing", START), ("w", "a", 2.0, 3.0, "playing", soon), ("w", "b", 3.0, 4.0, "paused", soon), ("w", "c", 9.0, 8.0, "playing", soon), ("w", "d", 1.0, 0.0, "playing", soon), ("w", "e", float("nan"), 1.0, "playing", soon), ("w", "", 1.0, 2.0, "playing", soon)]
    got = plain(watching.overlaid(states, spark.createDataFrame(sessions, row)).collect())
    assert got == {("w", "a"): (2.0, 3.0, 0.6667, True, False, False, START), ("w", "b"): (1.0, 4.0, 0.25, False, False, False, START), ("w", "c"): (9.0, 8.0, 1.0, False, False, False, soon)}
