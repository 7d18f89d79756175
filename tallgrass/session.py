"""Session and table helpers used across the library."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: What the library's results depend on; a cluster's own settings win, and memory and partitions are left to it.
DEFAULTS = {"spark.sql.session.timeZone": "UTC"}


def build(app: str = "tallgrass", master: str | None = None, **settings: str) -> SparkSession:
    """A session with `settings` (underscores stand for dots), and DEFAULTS for what neither these nor the cluster's files and submit flags set."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    session = builder.config(map={k.replace("_", "."): v for k, v in settings.items()}).getOrCreate()
    given = session.sparkContext.getConf()
    for key, value in DEFAULTS.items():
        if not given.contains(key):
            session.conf.set(key, value)
    return session


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; any path that Spark's readers open will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new path under spark.checkpoint.dir, which all executors share, deleted at the latest when the driver ends. Only a local master, as in tests, gets a folder under /tmp where that is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", at)
    path = f"{at.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(place)
    files.deleteOnExit(place)
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written once to the shared folder and read again, each reader only the columns that it needs. A checkpoint would run df's last stage twice and keep whole rows."""
    path = f"{shared_folder(df.sparkSession, label)}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpoints(spark: SparkSession) -> None:
    """checkpoint() takes its folder from spark.checkpoint.dir; a local master without one gets one under /tmp."""
    shared_folder(spark, "checkpoints")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
