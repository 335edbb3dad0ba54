"""Session settings, shared scratch tables and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession, functions as F

BROADCAST_ROWS_CONF = "spark.gridloom.broadcastMaxRows"
BROADCAST_ROWS_DEFAULT = 2_000_000
SHUFFLE_CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

RECOMMENDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A table already clustered by time may meet another one clustered by time in a join on
    # (time, latitude, longitude) without being shuffled again.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # Lanes are short lists; gather a few thousand per task in memory before sorting instead.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "4096",
    # Recording the Python call site of every column costs more than building the plan.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "gridloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RECOMMENDED, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a private one only for local runs without it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        base = tempfile.mkdtemp(prefix="gridloom-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/gridloom"


#: Folder of the current run below the scratch root.
_RUN: ContextVar[str] = ContextVar("run", default="")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}{_RUN.get()}/{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch_run(spark: SparkSession) -> Iterator[str]:
    """Staged tables of the block go to one folder, which is deleted when the block ends.

    Results that outlive the block must be written or collected inside it.
    """
    run = f"{_RUN.get()}/run-{uuid.uuid4().hex}"
    folder = f"{scratch_root(spark)}{run}"
    token = _RUN.set(run)
    try:
        yield folder
    finally:
        _RUN.reset(token)
        Files(spark).delete(folder)


class Files:
    """The few file operations that DataFrames lack, on any store Spark can reach."""

    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        where = self._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self._conf)

    def names(self, folder: str) -> list[str]:
        """Names of what a folder holds, none if it does not exist."""
        where, files = self._at(folder)
        return sorted(f.getPath().getName() for f in files.listStatus(where)) if files.exists(where) else []

    def text(self, path: str) -> str:
        where, files = self._at(path)
        stream = files.open(where)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create_once(self, path: str, text: str) -> bool:
        """Put a small file in place by one rename, unless it is there already."""
        where, files = self._at(path)
        draft = self._jvm.org.apache.hadoop.fs.Path(where.getParent(), f".{where.getName()}-{uuid.uuid4().hex}")
        stream = files.create(draft)
        stream.write(text.encode())
        stream.close()
        if not files.exists(where) and files.rename(draft, where) and self.text(path) == text:
            return True
        files.delete(draft, False)
        return False

    def delete(self, path: str) -> None:
        where, files = self._at(path)
        files.delete(where, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table to shared storage and read it back.

    Cuts the lineage in a way that survives lost executors, and gives the optimizer the real
    size of the table.  Shuffle files of the write are of no use after it and are deleted at its end.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with _shuffles_deleted(spark):
        # The setting counts when a DataFrame is made.
        df.select("*").write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def _shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Queries of the block delete their shuffle files when they end, not when the driver collects garbage."""
    before = spark.conf.get(SHUFFLE_CLEANUP_CONF, "false")
    spark.conf.set(SHUFFLE_CLEANUP_CONF, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP_CONF, before)


def clustered(df: DataFrame, *keys: str) -> DataFrame:
    """Shuffle by ``keys`` into exactly spark.sql.shuffle.partitions parts.

    For small inputs that grow in the same stage (exploded into many cells): AQE would merge
    the parts by their size before the growth and leave too few tasks for it.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *keys)


def broadcast_limit(spark: SparkSession) -> int:
    return int(spark.conf.get(BROADCAST_ROWS_CONF, str(BROADCAST_ROWS_DEFAULT)))


def broadcast_if_small(side: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast only for a counted, small side; otherwise leave the join to Catalyst."""
    return F.broadcast(side) if rows <= broadcast_limit(side.sparkSession) else side
