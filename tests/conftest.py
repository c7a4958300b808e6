from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("quire-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def hot_limits(spark):
    """Make every group of more than four rows hot, with slices of three rows."""
    from quire import runtime

    spark.conf.set(runtime.HOT_GROUP_ROWS, "4")
    spark.conf.set(runtime.SLICE_ROWS, "3")
    yield
    spark.conf.unset(runtime.HOT_GROUP_ROWS)
    spark.conf.unset(runtime.SLICE_ROWS)


@pytest.fixture
def no_broadcast(spark):
    """Treat every side as too long to broadcast."""
    from quire import runtime

    spark.conf.set(runtime.BROADCAST_ROWS, "0")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset(runtime.BROADCAST_ROWS)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
