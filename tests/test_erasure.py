"""Erasure by file: what is touched, what stays, and what an interruption leaves."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from colloquy.sources import erasure


@pytest.fixture()
def stored(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = spark.range(400).select(
        F.concat(F.lit("c"), (F.col("id") / 10).cast("int")).alias("conversation_id"), F.col("id").alias("n"),
        F.when(F.col("id") % 50 != 7, F.concat(F.lit("text "), "id")).alias("text"),
    )
    rows.unionByName(spark.sql("SELECT CAST(NULL AS STRING) AS conversation_id, -1L AS n, 'none' AS text")).repartitionByRange(
        8, "n"
    ).write.parquet(path)
    return path


def _files(path):
    return {f for f in os.listdir(path) if f.endswith(".parquet")}


def _numbers(spark, path):
    return sorted(r.n for r in spark.read.parquet(path).collect())


def test_only_files_with_requested_ids_change(spark, stored):
    before, whole = _files(stored), _numbers(spark, stored)
    wanted = spark.createDataFrame([("c1",), ("c2",), ("c2",), ("nobody",), (None,)], "conversation_id string")
    replaced = erasure.erase_rows(spark, stored, wanted)
    after = _files(stored)
    assert 1 <= replaced <= 3 and len(before & after) == len(before) - replaced
    assert _numbers(spark, stored) == [n for n in whole if not 10 <= n < 30]
    assert erasure.erase_rows(spark, stored, wanted) == 0 and _files(stored) == after
    assert not os.path.exists(f"{stored}/{erasure.STAGE}")


@pytest.mark.parametrize("staged", [True, False])
def test_an_interrupted_erasure_is_finished_or_dropped(spark, stored, monkeypatch, staged):
    whole = _numbers(spark, stored)
    wanted = spark.createDataFrame([("c5",)], "conversation_id string")
    real = erasure.finish
    calls = []

    def stop(session, path):
        calls.append(path)
        if len(calls) == 1:
            return real(session, path)
        raise KeyboardInterrupt

    monkeypatch.setattr(erasure, "finish", stop)
    with pytest.raises(KeyboardInterrupt):
        erasure.erase_rows(spark, stored, wanted)
    assert _numbers(spark, stored) == whole  # nothing was exchanged yet
    if not staged:
        shutil.rmtree(f"{stored}/{erasure.STAGE}/old")
    real(spark, stored)
    assert _numbers(spark, stored) == ([n for n in whole if not 50 <= n < 60] if staged else whole)
    assert not os.path.exists(f"{stored}/{erasure.STAGE}")
