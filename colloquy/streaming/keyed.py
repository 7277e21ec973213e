"""State of a stream as a table: the newest row per key, kept as a base and the
changes of the batches since.

A batch reads what the batches before it left, and writes its own changes to a
folder of its own, so a batch that runs again reads and replaces the same. Every
`every` batches the state is written as a new base. The base before it and the
changes since then are kept for a batch that runs again; what is older is deleted.
So the files follow the keys and `every`, however many batches there were."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class KeyedTable:
    """Rows of `schema` by the column `key`. Of a key's rows the one with the
    greatest `order` counts, by default that of the latest batch. The rows of one
    batch hold a key once, or differ in `order`."""

    def __init__(self, path: str, key: str, schema: str | T.StructType, order: tuple[str, ...] = (), every: int = 16):
        self.path, self.key, self.order, self.every = path.rstrip("/"), key, order, every
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def _folder(self, spark: SparkSession):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _written(self, spark: SparkSession) -> dict[str, list[int]]:
        """Numbers of the complete folders, `base` and `changes`."""
        path, system = self._folder(spark)
        found: dict[str, list[int]] = {"base": [], "changes": []}
        if system.exists(path):
            for status in system.listStatus(path):
                match = re.fullmatch(r"(base|changes)=(\d+)", status.getPath().getName())
                done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
                if match and system.exists(done):
                    found[match[1]].append(int(match[2]))
        return {kind: sorted(numbers) for kind, numbers in found.items()}

    def read(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """The state after all batches, or after those before number `before`."""
        there = self._written(spark)
        bases = [b for b in there["base"] if before is None or b < before]
        base = bases[-1] if bases else -1
        changes = [c for c in there["changes"] if c > base and (before is None or c < before)]
        paths = [f"{self.path}/base={b}" for b in bases[-1:]] + [f"{self.path}/changes={c}" for c in changes]
        if not paths:
            return spark.createDataFrame([], self.schema)
        stored = T.StructType([*self.schema.fields, T.StructField("_at", T.LongType())])
        rows = spark.read.schema(stored).parquet(*paths)
        record = F.struct(*self.schema.names)
        newest = F.max_by(record, F.struct(*self.order, "_at"))
        return rows.groupBy(F.col(self.key).alias("_key")).agg(newest.alias("_r")).select("_r.*")

    def write(self, batch_id: int, rows: DataFrame) -> None:
        """The changed rows of a batch; a new base when it is due."""
        spark = rows.sparkSession
        changed = rows.select(*self.schema.names).withColumn("_at", F.lit(batch_id).cast("long"))
        changed.write.mode("overwrite").parquet(f"{self.path}/changes={batch_id}")
        if (batch_id + 1) % self.every == 0:
            whole = self.read(spark, batch_id + 1).withColumn("_at", F.lit(batch_id).cast("long"))
            whole.write.mode("overwrite").parquet(f"{self.path}/base={batch_id}")
            self._tidy(spark, batch_id)

    def _tidy(self, spark: SparkSession, batch_id: int) -> None:
        """Deletes what no batch from `batch_id` on, run again or not, will read."""
        there = self._written(spark)
        bases = [b for b in there["base"] if b < batch_id]
        if not bases:
            return
        _, system = self._folder(spark)
        old = [f"base={b}" for b in bases[:-1]] + [f"changes={c}" for c in there["changes"] if c <= bases[-1]]
        for name in old:
            system.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}"), True)
