"""Queries of watch states: users stand for works, kinds of events for episodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallgrass.session import shared_folder, table
from tallgrass.streaming import watching

from .base import query

_ACTION = "CASE event_id % 10 WHEN 0 THEN 'unwatch' WHEN 1 THEN 'watch' WHEN 2 THEN 'import' ELSE 'play' END"
_DURATION = "CASE WHEN event_id % 7 = 0 THEN 0.0 ELSE 100.0 END"
_KNOWN = "user_id IS NOT NULL AND event_type IS NOT NULL AND ts IS NOT NULL"
# One action after another, as a server folds them.
_FOLD = f"""a AS (SELECT user_id::VARCHAR AS work_id, event_type AS episode_id, ts, {_ACTION} AS action, coalesce(value, 0) AS p, {_DURATION}::DOUBLE AS d, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events WHERE {_KNOWN}),
    f AS (SELECT DISTINCT work_id, episode_id, 0::BIGINT AS n, 0.0::DOUBLE AS position, 0.0::DOUBLE AS duration, 0.0::DOUBLE AS ratio, false AS completed, false AS synced, false AS unwatched, NULL::TIMESTAMP AS updated_at FROM a
    UNION ALL SELECT f.work_id, f.episode_id, a.n,
        CASE action WHEN 'play' THEN p WHEN 'watch' THEN 1 WHEN 'unwatch' THEN 0 ELSE CASE WHEN unwatched OR completed OR position <> 0 THEN position ELSE 1 END END,
        CASE action WHEN 'play' THEN d WHEN 'watch' THEN 1 WHEN 'unwatch' THEN 0 ELSE CASE WHEN unwatched OR completed OR duration <> 0 THEN duration ELSE 1 END END,
        CASE action WHEN 'play' THEN CASE WHEN d > 0 THEN round(least(1, greatest(0, p / d)), 4) ELSE 0 END WHEN 'watch' THEN 1 WHEN 'unwatch' THEN 0 ELSE CASE WHEN unwatched OR completed THEN ratio ELSE 1 END END,
        CASE action WHEN 'play' THEN completed OR (d > 0 AND p / d >= 0.95) WHEN 'watch' THEN true WHEN 'unwatch' THEN false ELSE completed OR NOT unwatched END,
        CASE action WHEN 'unwatch' THEN false WHEN 'import' THEN synced OR NOT unwatched ELSE synced END,
        CASE action WHEN 'play' THEN unwatched AND NOT (d > 0 AND p / d >= 0.95) WHEN 'watch' THEN false WHEN 'unwatch' THEN true ELSE unwatched END,
        CASE WHEN action = 'import' AND unwatched THEN updated_at ELSE ts END
    FROM f JOIN a ON a.work_id = f.work_id AND a.episode_id = f.episode_id AND a.n = f.n + 1),
    s AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY work_id, episode_id ORDER BY n DESC) = 1)"""
_STATES = f"WITH RECURSIVE {_FOLD} SELECT work_id, episode_id, position, duration, ratio, completed, synced, unwatched, epoch_us(updated_at) AS updated_at"


def _actions(spark: SparkSession, d: str) -> DataFrame:
    action, duration = F.expr(_ACTION), F.expr(_DURATION).cast("double")
    return table(spark, d, "events").select(F.col("user_id").cast("string").alias("work_id"), F.col("event_type").alias("episode_id"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), action.alias("action"), F.col("value").alias("position"), duration.alias("duration"))


def _plain(states: DataFrame) -> DataFrame:
    return states.withColumn("updated_at", F.unix_micros("updated_at"))


@query(f"{_STATES}, coalesce((SELECT max(ts) FROM a WHERE a.work_id = s.work_id AND a.episode_id = s.episode_id AND action = 'play') + INTERVAL 30 MINUTES > (SELECT max(ts) FROM a), false) AS live FROM s")
def watch_states(spark: SparkSession, d: str) -> DataFrame:
    return _plain(watching.latest(_actions(spark, d)))


@query(f"{_STATES} FROM s")
def watch_states_streamed(spark: SparkSession, d: str) -> DataFrame:
    """The same states by the stream: the events come in three parts by time, each after a restart from the checkpoint."""
    at = shared_folder(spark, "watching")
    rows = _actions(spark, d)
    first, last = rows.agg(F.min("at"), F.max("at")).first()
    # Without any event there is nothing to fold.
    if first is None:
        return _plain(watching.latest(rows)).drop("live")
    cuts = [first + (last - first) * n / 3 for n in range(1, 3)]
    part = F.when(F.col("at") < cuts[0], 0).when(F.col("at") < cuts[1], 1).otherwise(2)
    rows = rows.withColumn("part", part)
    rows.write.partitionBy("part").parquet(f"{at}/events")

    def keep(batch: DataFrame, number: int) -> None:
        # A batch that runs again writes the same folder.
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{at}/states/batch_{number}")

    store = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(store)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for n in range(3):
            spark.read.schema(rows.drop("part").schema).parquet(f"{at}/events/part={n}").write.parquet(f"{at}/in/{n}")
            stream = spark.readStream.schema(rows.drop("part").schema).parquet(f"{at}/in/*")
            watching.streamed(stream).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(store, old)
    states = spark.read.parquet(f"{at}/states/*")
    newest = F.row_number().over(Window.partitionBy(*watching.KEY).orderBy(F.col("batch").desc()))
    return _plain(states.withColumn("n", newest).where("n = 1").drop("n", "batch", "live"))
