"""The streams over tables that are folders of several files."""

import pytest
from pyspark.sql import functions as F

from colloquy.plans.catalog import QUERIES


@pytest.mark.parametrize("name, wanted", [("stream_admission", "admit_messages"), ("stream_redelivery", None)])
def test_stream_reads_a_table_of_several_files(spark, tmp_path, name, wanted):
    rows = spark.range(60).select(
        (F.col("id") / 6).cast("long").alias("conv_id"), (F.col("id") % 6).alias("turn"),
        F.when(F.col("id") % 6 == 0, "system").when(F.col("id") % 2 == 0, "assistant").otherwise("user").alias("role"),
        F.concat(F.lit("text "), "id").alias("text"),
    )
    rows.repartition(3).write.parquet(str(tmp_path / "folder/conversations.parquet"))
    got = QUERIES[name](spark, str(tmp_path / "folder"))
    assert got.count() == 50
    if wanted:
        batch = QUERIES[wanted](spark, str(tmp_path / "folder")).select(got.columns)
        assert sorted(got.collect()) == sorted(batch.collect())
