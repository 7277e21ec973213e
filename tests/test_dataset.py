"""Split sizes and sanity, sampling, state and lineage on small frames."""

import math

import pytest
from pyspark.sql import functions as F

from colloquy.operators import dataset, metrics, state


@pytest.mark.parametrize("groups, limit", [(1, 5), (10, 3), (37, 5), (200, 20)])
def test_split_sizes_and_no_leak(spark, split_at, groups, limit):
    split_at(limit)
    rows = [(f"m{i}", f"u{i % groups if i % 3 else 0}") for i in range(groups * 6)]
    df = spark.createDataFrame(rows, "example_id string, customer_id string")
    placed = dataset.grouped_split(df, rows=limit)
    by = {}
    for r in placed.collect():
        by.setdefault(r.split, set()).add(r.customer_id)
    distinct = len({r[1] for r in rows})
    held = math.ceil((0.15 + 0.15) * distinct)
    test = math.ceil(0.15 / (0.15 + 0.15) * held)
    assert len(by.get("test", ())) == test
    assert len(by.get("validation", ())) == held - test
    assert len(by.get("train", ())) == distinct - held
    sane = dataset.split_sanity(placed, df).first()
    assert sane.error_code is None and sane.example_rows == len(rows)
    assert all(r.shared == 0 for r in dataset.split_overlap(placed).collect())


def test_split_sanity_finds_faults(spark):
    rows = [("m1", "u1", "train"), ("m2", "u1", "test"), ("m3", "u2", None)]
    df = spark.createDataFrame(rows, "example_id string, customer_id string, split string")
    assert dataset.split_sanity(df, df).first().error_code == "SP_R12_CUSTOMER_ID_LEAK"
    assert dataset.split_sanity(df, df.limit(1)).first().error_code == "SP_R11_EXAMPLE_COUNT_MISMATCH"
    assert dataset.split_sanity(df.filter("customer_id = 'u2'"), df.limit(1)).first().error_code == "SP_R13_SPLIT_ROW_SUM_MISMATCH"


def test_missing_label_stays_null(spark):
    features = spark.createDataFrame([("m1", "u", "c", "p", "t", ["x"]), ("m2", "u", "c", "p", "t", [])],
                                     "message_id string, customer_id string, conversation_id string, persona string,"
                                     " text_clean string, context_clean array<string>")
    labels = spark.createDataFrame([("m1", 0.5)], "target_id string, label_score double")
    got = {r.example_id: r.label_score for r in dataset.assemble_examples(features, labels).collect()}
    assert got == {"m1": 0.5, "m2": None}


def test_cycled_histories_in_a_small_pool(spark):
    rows = [(f"e{i}", f"t{i}") for i in range(4)]
    got = dataset.cycled_histories(spark.createDataFrame(rows, "example_id string, text_clean string")).collect()
    assert len(got) == 4
    for r in got:
        assert list(r.context_clean) == [f"t{(r.row + j) % 4}" for j in range(30)]


def test_transcript_pages_hold_every_message_once(spark):
    n = 1234
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "c-hot").otherwise(F.concat(F.lit("c-"), F.col("id") % 50)).alias("conversation_id"),
        F.concat(F.lit("m"), "id").alias("message_id"), F.lit("customer").alias("role"), F.lit("t").alias("text"),
        F.timestamp_seconds(F.col("id") * 7 % 500).alias("sent_at"), F.timestamp_seconds("id").alias("received_at"),
    )
    pages = state.transcripts(df, 20, rows=30).collect()
    assert all(len(p.messages) <= 20 for p in pages)
    assert sum(len(p.messages) for p in pages) == n
    hot = sorted((p for p in pages if p.conversation_id == "c-hot"), key=lambda p: p.page)
    flat = [m for p in hot for m in p.messages]
    assert [m.position for m in flat] == list(range(1, len(flat) + 1))
    assert [m.sent_at for m in flat] == sorted(m.sent_at for m in flat)


def test_erasure_and_orphans(spark):
    convs = spark.createDataFrame([("c1", "u1"), ("c2", "u1"), ("c3", "u2")], "conversation_id string, customer_id string")
    facts = spark.createDataFrame([("c1", 1), ("c2", 2), ("c3", 3)], "conversation_id string, x int")
    customers = spark.createDataFrame([("u1",), ("u2",)], "customer_id string")
    wanted = spark.createDataFrame([("c1",), ("c3",), ("c9",)], "conversation_id string")
    left = state.erase(wanted, facts, facts, facts, convs, customers, rows=1)
    assert [r.conversation_id for r in left["messages"].collect()] == ["c2"]
    assert [r.customer_id for r in left["customers"].collect()] == ["u1"]
    assert {r.conversation_id: r.status for r in left["results"].collect()} == {"c1": 204, "c3": 204, "c9": 404}


def test_failure_at_the_time_of_success_is_not_after_it(spark):
    at = "2024-01-01 00:00:0"
    scores = spark.createDataFrame([("c1", at + "5")], "conversation_id string, p string").select(
        "conversation_id", F.col("p").cast("timestamp").alias("persisted_at"))
    failures = spark.createDataFrame(
        [("f1", "c1", "timeout", at + "5"), ("f2", "c1", "timeout", at + "6"), ("f3", "c2", "timeout", at + "1"),
         ("f4", "c1", "quarantined", at + "7")], "failure_id string, conversation_id string, error_code string, o string",
    ).withColumn("occurred_at", F.col("o").cast("timestamp"))
    got = {r.failure_id for r in state.failures_after_success(scores, failures).collect()}
    assert got == {"f2", "f3"}


@pytest.mark.parametrize("limit", [7, 10_000])
def test_spearman_and_quantiles(spark, limit):
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(3)
    label = rng.choice([-1, -0.5, 0, 0.5, 1], 500)
    pred = np.round(label * 0.4 + rng.normal(0, 0.8, 500), 2)
    pdf = pd.DataFrame({"label_score": label, "prediction": pred})
    df = spark.createDataFrame(pdf)
    want = pdf.label_score.rank().corr(pdf.prediction.clip(-1, 1).rank())
    assert metrics.spearman(df, limit).first()[0] == pytest.approx(want, abs=1e-9)
    got = metrics.latency_summary(df, "prediction", limit).first()
    assert got.p50 == pytest.approx(np.percentile(pred, 50)) and got.p95 == pytest.approx(np.percentile(pred, 95))
    empty = metrics.latency_summary(df.filter("false"), "prediction").first()
    assert (empty.p50, empty.p95, empty.sample_size) == (0.0, 0.0, 0)
    assert metrics.spearman(df.withColumn("prediction", F.lit(0.1)), limit).first()[0] == 0.0


def test_empty_side_has_no_mae_and_gate(spark):
    df = spark.createDataFrame([(0.5, 2.0, ["x"]), (0.0, 0.1, ["y"])], "label_score double, prediction double, context_clean array<string>")
    row = metrics.context_breakdown(df).first()
    assert row.no_context_mae is None and row.no_context_rows == 0
    assert row.with_context_mae == pytest.approx((0.5 + 0.1) / 2)
    base = df.withColumn("prediction", F.lit(0.25))
    gate = metrics.quality_gate(df, base).first()
    assert gate.baseline_mae == pytest.approx(0.25) and not gate.passed


def test_versions(spark):
    df = spark.createDataFrame([("mood-2024.01.0",), ("mood-2024.01.10",), ("mood-2024.02.3",), ("other",)], "model_version string")
    got = {r.next_version for r in metrics.next_version(df).collect()}
    assert got == {"mood-2024.01.11", "mood-2024.02.4"}
