"""Session helpers: a builder for local runs and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import SparkSession

import csilake

#: Setting for the files that a task writes side by side, into folders or buckets, and their number here. A task with rows for more
#: sorts the rest of them.
OPEN_WRITERS, OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters", 128
#: Setting that, if false, lets rows that lie by one key of a join stay where they are.
CO_PARTITION = "spark.sql.requireAllClusterKeysForCoPartition"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Session for tests and the benchmark. A cluster brings its own settings."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("csilake")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.files.maxPartitionBytes", "1m")
        .config("spark.sql.files.openCostInBytes", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def prepare(spark: SparkSession) -> SparkSession:
    """Wall-clock columns carry no zone, so every job reads them as UTC.

    The package's Python functions travel with the tasks: workers need not have it installed.
    """
    cloudpickle.register_pickle_by_value(csilake)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


@contextmanager
def setting(spark: SparkSession, name: str, value: object) -> Iterator[None]:
    """The session's setting while something runs; afterwards it is as before."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(value))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a session whose executors are threads of the driver (tests, a laptop) may do without that setting:
    it gets one local folder. Any other raises, since its executors would not see each other's files.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not re.fullmatch(r"local(\[[^]]*\])?", context.master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {context.master} share")
        if context.applicationId not in _LOCAL:
            _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="csilake-")
        folder = _LOCAL[context.applicationId]
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """Fresh path below the shared folder, for one table or checkpoint."""
    return f"{shared_folder(spark)}/csilake/{name}-{uuid.uuid4().hex}"
