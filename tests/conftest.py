import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
for folder in (ROOT, os.path.join(ROOT, "tools")):
    sys.path.insert(0, folder)

from ticketloom import EventLogModel  # noqa: E402
from ticketloom.schema import LOG_SCHEMA  # noqa: E402
from ticketloom.sources.event_store import dedupe_events, keyed_events  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def log_of(spark):
    return lambda *rows: dedupe_events(keyed_events(spark.createDataFrame(list(rows), LOG_SCHEMA)))


@pytest.fixture(scope="session")
def model_of(log_of):
    return lambda *rows, **kwargs: EventLogModel.over(log_of(*rows), **kwargs)
