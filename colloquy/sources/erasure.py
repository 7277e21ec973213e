"""Erasure in a stored Parquet table: only the files that hold a requested id are
rewritten, all others stay as they are.

The rows that remain of those files are staged first, then the list of the files
they replace is written; from there on an erasure that was interrupted is finished by
the next call (or by `finish`). While files are exchanged the table should not be
read. Tables are flat folders of Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STAGE = "_erasure"  # hidden from readers of the table


def _system(spark: SparkSession, path: str):
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return make, make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def files_with(table: DataFrame, requests: DataFrame, key: str = "conversation_id") -> DataFrame:
    """(file): the files of a scanned table in which one of the requested keys occurs; only the key is read."""
    wanted = requests.select(key).distinct()
    rows = table.select(key, F.col("_metadata.file_path").alias("file"))
    return rows.join(wanted, key, "left_semi").select("file").distinct()


def finish(spark: SparkSession, path: str) -> None:
    """Completes an erasure whose replacement was staged whole; drops one that was not."""
    make, system = _system(spark, path)
    stage = f"{path}/{STAGE}"
    if not system.exists(make(stage)):
        return
    if system.exists(make(f"{stage}/old/_SUCCESS")):
        for row in spark.read.schema("file string").json(f"{stage}/old").toLocalIterator():
            system.delete(make(row.file), False)
        for status in system.listStatus(make(f"{stage}/new")):
            name = status.getPath().getName()
            if name.endswith(".parquet"):
                system.rename(status.getPath(), make(f"{path}/{name}"))
    system.delete(make(stage), True)


def erase_rows(spark: SparkSession, path: str, requests: DataFrame, key: str = "conversation_id") -> int:
    """Erases the rows of the table at `path` whose `key` is requested; the number of files replaced. A null key is never
    requested."""
    path = path.rstrip("/")
    finish(spark, path)
    table = spark.read.parquet(path)
    found = [r.file for r in files_with(table, requests, key).toLocalIterator()]  # names of files, not rows
    if not found:
        return 0
    kept = spark.read.schema(table.schema).parquet(*found).join(requests.select(key).distinct(), key, "left_anti")
    kept.select(*table.columns).write.mode("overwrite").parquet(f"{path}/{STAGE}/new")
    spark.createDataFrame([(f,) for f in found], "file string").coalesce(1).write.mode("overwrite").json(f"{path}/{STAGE}/old")
    finish(spark, path)
    return len(found)
