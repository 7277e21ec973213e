"""Session settings the operators read."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
HOT_ROWS_CONF = "colloquy.hotRows"
HOT_ROWS_DEFAULT = 1_000_000
BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"
SHUFFLE_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # from Spark 4.1; others ignore it
LARGE_ROWS_GROUP = 16 << 20  # bytes of a row group of large rows, unless a single row has more
_SIZE_CHECKS = ("parquet.page.size.row.check.min", "parquet.page.size.row.check.max")  # rows from check to check


def hot_rows(spark: SparkSession) -> int:
    """Rows of one key above which the key is split over several tasks."""
    return int(spark.conf.get(HOT_ROWS_CONF, str(HOT_ROWS_DEFAULT)))


@cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="colloquy-")


def shared_dir(spark: SparkSession) -> str:
    """Shared folder named by the cluster; a temporary one of this process only
    where the session names none and runs in local mode."""
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if not configured:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder all executors can reach")
        configured = _own_dir()
    return configured.rstrip("/")


_made: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other call has used."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether the path is a folder, on whatever store it lies."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory()


@contextmanager
def job(spark: SparkSession) -> Iterator[None]:
    """Deletes the folders that the operators wrote inside the block. Results
    that are still wanted must be written elsewhere before it ends."""
    start = len(_made)
    try:
        yield
    finally:
        ours = _made[start:]
        del _made[start:]
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for path in ours:
            folder = hadoop(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session, as long as the block runs."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def shuffles_deleted(spark: SparkSession) -> AbstractContextManager[None]:
    """Spark deletes the shuffle files of each query that runs inside the block when the query ends. A table written inside
    is whole; a frame that is run twice is shuffled twice."""
    return setting(spark, SHUFFLE_CONF, "true")


def small_batches(spark: SparkSession, rows: int) -> AbstractContextManager[None]:
    """Queries that run inside the block pass so many rows at once to Python, for rows that are large; else a task holds
    all rows of a small partition twice."""
    return setting(spark, BATCH_CONF, str(rows))


def spread(scan: DataFrame) -> DataFrame:
    """A bare scan over all cores when it has fewer splits than there are cores,
    as for one small file; larger inputs are left where they are. Counting the
    splits of anything but a scan would run it, so this is for scans alone."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def materialize(df: DataFrame, name: str, large_rows: bool = False, close: bool = False) -> DataFrame:
    """Write `df` once to the shared folder and read it back. The written
    table outlives lost executors and cuts the plan for the steps after it.

    A task holds a row group, both when it writes and when it reads one. Parquet
    looks at the size of a group every 100 rows, too late where rows have megabytes:
    with `large_rows` it looks after each row, and groups are small. `close` packs the table closer."""
    path = new_path(df.sparkSession, name)
    writer = df.write
    if large_rows:
        writer = writer.options(**{"parquet.block.size": LARGE_ROWS_GROUP} | dict.fromkeys(_SIZE_CHECKS, 1))
    if close:
        writer = writer.option("compression", "zstd")
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the folder of a table that `materialize` gave, once what was made from it has been written as well."""
    spark = df.sparkSession
    for path in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
