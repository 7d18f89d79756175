import os
import tempfile

os.environ.setdefault("TZ", "UTC")

import pytest

from tallgrass.session import build


@pytest.fixture(scope="session")
def spark():
    session = build(
        "tests",
        "local[4]",
        spark_sql_shuffle_partitions="4",
        spark_driver_memory="4g",
        spark_ui_showConsoleProgress="false",
        spark_ui_enabled="false",
        spark_checkpoint_dir=tempfile.mkdtemp(prefix="spark-", dir="/tmp"),
        spark_sql_warehouse_dir=tempfile.mkdtemp(prefix="spark-", dir="/tmp"),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
