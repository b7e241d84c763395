"""Session settings and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows, of a few hundred bytes at most, up to which a frame of known size is broadcast.
BROADCAST_ROWS = 100_000

# Event keys are hexadecimal digits, which the default codec does not make shorter: 25 bytes an event, not 45.
CODEC = "zstd"

TARGET_PARTITION_BYTES = 192 * 1024 * 1024


def settings_for(shuffled_bytes: int, cores: int) -> dict[str, str]:
    """Session settings sized so that one shuffle partition fits in an executor's working memory.

    AQE merges small partitions but never adds any, so the initial number has to fit the data.
    """
    partitions = max(cores, -(-shuffled_bytes // TARGET_PARTITION_BYTES))
    return {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(TARGET_PARTITION_BYTES),
        "spark.sql.shuffle.partitions": str(partitions),
    }


def require_utc(spark: SparkSession) -> None:
    """Event keys and calendar dates are defined in UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


# The folders that the innermost scope owns; None outside any scope.
_OWNED: ContextVar[list[str] | None] = ContextVar("scratch folders", default=None)


@contextmanager
def scratch_scope(spark: SparkSession):
    """Drops the scratch folders made inside, when it is left.

    Frames made inside are lazy and read these folders, so the scope is to enclose the write of the result.
    Until then every folder stays where all executors read it, so lost tasks are computed again. An inner scope
    drops its own folders only. Without a scope nothing is dropped.
    """
    token = _OWNED.set([])
    try:
        yield
    finally:
        owned = _OWNED.get()
        _OWNED.reset(token)
        path_of = spark._jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for folder in owned:
            path = path_of(folder)
            path.getFileSystem(conf).delete(path, True)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder name below the folder that the cluster shares through spark.checkpoint.dir.

    Only a local session without that setting falls back to a temporary folder of its machine. Inside a
    `scratch_scope` the folder is dropped at its end.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="ticketloom-")
        spark.conf.set("spark.checkpoint.dir", shared)
    folder = f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    owned = _OWNED.get()
    if owned is not None:
        owned.append(folder)
    return folder


def broadcast_up_to(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """The frame, known to have no more than `rows` narrow rows, with a hint to broadcast it if those are few."""
    return F.broadcast(df) if rows <= most else df


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame written once to the shared folder and read back: fixed rows, no lineage."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path, compression=CODEC)
    return spark.read.schema(df.schema).parquet(path)
