"""Session settings and the row limits that drive splitting of hot groups."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows of one series that one window task may hold.
CHUNK_ROWS = "framestride.chunkRows"
#: Rows of one group above which the group counts as hot and is split or salted.
HOT_ROWS = "framestride.hotRows"

_DEFAULTS = {CHUNK_ROWS: 65_536, HOT_ROWS: 1_000_000}


def limit(spark: SparkSession, name: str) -> int:
    """A row limit, from the session configuration or its default."""
    return int(spark.conf.get(name, str(_DEFAULTS[name])))


def chunk_rows(df) -> int:
    return limit(df.sparkSession, CHUNK_ROWS)


def hot_rows(df) -> int:
    return limit(df.sparkSession, HOT_ROWS)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster; a temporary one only in a local session that sets none."""
    current = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="framestride-checkpoint-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(current)
    return current


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """At most this many rows in an Arrow batch of the jobs that run inside, where rows are large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


_STAGES: list[str] = []


def stage(df: DataFrame, options: dict | None = None) -> DataFrame:
    """Write a frame as a table in the shared checkpoint folder and read it back.

    Used where an expensive input is needed more than once. The table is on shared storage, so a
    lost executor costs a re-read, not a re-computation; unlike an RDD checkpoint it stays columnar. ``options`` go to the writer.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/framestride-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path)
    _STAGES.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stages(spark: SparkSession) -> None:
    """Delete the tables written by :func:`stage` once their results are no longer needed."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _STAGES:
        path = jvm.org.apache.hadoop.fs.Path(_STAGES.pop())
        path.getFileSystem(conf).delete(path, True)


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("framestride")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
