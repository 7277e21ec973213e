"""Streams over several micro-batches against their batch twins."""

import os
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from colloquy.operators import online, state
from colloquy.streaming import pipelines as p
from colloquy.streaming.keyed import KeyedTable

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = ("message_id string, conversation_id string, customer_id string, role string, text string,"
          " sent_at timestamp, received_at timestamp")


def _drop_files(spark, folder, batches, schema):
    """One file per batch, with modification times in that order."""
    folder.mkdir()
    for i, rows in enumerate(batches):
        shuffled = random.Random(i).sample(rows, len(rows))
        spark.createDataFrame(shuffled, schema).coalesce(1).write.parquet(str(folder / f"w{i}"))
        (part,) = (folder / f"w{i}").glob("*.parquet")
        target = folder / f"{i}.parquet"
        os.link(part, target)
        os.utime(target, (1_700_000_000 + i, 1_700_000_000 + i))
    frame = spark.createDataFrame(batches[0], schema)
    return p.read_stream(spark, str(folder), frame.schema, pattern="?.parquet", files_per_trigger=1)


def _messages(n=240):
    rng = random.Random(11)
    return [
        (f"m-{i:04d}", "c-hot" if rng.random() < 0.4 else f"c-{rng.randrange(8)}", f"u-{rng.randrange(2)}",
         rng.choice(["customer", "customer", "agent"]), f"text {i} a@b.co", START + timedelta(seconds=rng.randrange(3000)),
         START + timedelta(seconds=4000 + i))
        for i in range(n)
    ]


def _chunks(rows, k):
    size = len(rows) // k
    return [rows[i * size : (i + 1) * size if i < k - 1 else len(rows)] for i in range(k)]


def _read(run, stream, tmp_path, schema):
    out = str(tmp_path / run.__name__)
    run(stream, out, str(tmp_path / f"{run.__name__}-checkpoint"))
    return p.read_batches(stream.sparkSession, out, schema)


def _admission(reject):
    def admission(stream, out, checkpoint):
        p.admission(stream, reject, out, checkpoint)

    return admission


@pytest.mark.parametrize("hot", [7, 1_000_000])
def test_admission_and_histories(spark, tmp_path, split_at, hot):
    split_at(hot)
    rows = _messages()
    batch = spark.createDataFrame(rows, SCHEMA)
    stream = _drop_files(spark, tmp_path / "in", _chunks(rows, 3), SCHEMA)
    reject = F.when(F.col("message_id").endswith("7"), 400).cast("int")
    got = {r.message_id: r.status for r in _read(_admission(reject), stream, tmp_path, p.STATUSES).collect()}
    want = {r.message_id: r.status for r in online.admit(batch, reject, ["received_at", "message_id"]).collect()}
    assert got == want and set(got.values()) >= {200, 400}
    found = _read(p.histories, stream, tmp_path, p.HISTORIES).collect()
    want = {r.message_id: (list(r.history_ids), list(r.history_texts)) for r in online.online_histories(batch).collect()}
    assert {r.message_id: (list(r.history_ids), list(r.history_texts)) for r in found} == want
    assert max(len(ids) for ids, _ in want.values()) == 30


def test_one_key_brings_a_whole_batch(spark, tmp_path, split_at):
    """300,000 rows of one conversation in one batch, in pieces of 20,000 rows: the tasks of the histories read segments."""
    split_at(20_000)
    n = 300_000
    rows = spark.range(n).select(
        F.format_string("m-%07d", "id").alias("message_id"), F.lit("c").alias("conversation_id"),
        F.lit("u").alias("customer_id"), F.lit("customer").alias("role"), F.lit("t").alias("text"),
        F.timestamp_seconds(F.col("id") * 7919 % n).alias("sent_at"), F.timestamp_seconds(F.col("id")).alias("received_at"),
    )
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = p.read_stream(spark, str(tmp_path / "in"), rows.schema)
    got = _read(p.histories, stream, tmp_path, p.HISTORIES)
    assert got.count() == n
    late = 250_123
    newest = sorted(((i * 7919 % n, i) for i in range(late)), reverse=True)[:29]
    row = got.filter(F.col("message_id") == f"m-{late:07d}").first()
    assert list(row.history_ids) == [f"m-{i:07d}" for _, i in reversed(newest)] + [f"m-{late:07d}"]
    statuses = _read(_admission(F.lit(None).cast("int")), stream, tmp_path, p.STATUSES)
    assert statuses.filter("status = 200").count() == n


@pytest.mark.parametrize("hot", [6, 1_000_000])
def test_quarantine(spark, tmp_path, split_at, hot):
    split_at(hot)
    rng = random.Random(3)
    rows = [(f"c{rng.randrange(6)}", i * 10, i, "failure" if rng.random() < 0.35 else "score") for i in range(240)]
    rows = [(*r, "timeout" if r[3] == "failure" else None) for r in rows]
    schema = "conversation_id string, at_us long, seq long, kind string, error_code string"
    stream = _drop_files(spark, tmp_path / "in", _chunks(rows, 6), schema)
    got = {r.seq: r.outcome for r in _read(p.quarantine, stream, tmp_path, p.OUTCOMES).collect()}
    streak, want = {}, {}
    for c, _, i, kind, code in rows:
        n = streak.get(c, 0)
        want[i] = "quarantined" if n >= 3 else "scored" if kind == "score" else code
        streak[c] = n if n >= 3 else n + 1 if kind == "failure" else 0
    assert got == want and "quarantined" in got.values()
    batch = online.replay_quarantine(spark.createDataFrame(rows, schema))
    assert {r.seq: r.outcome for r in batch.collect()} == want


MOODS = "mood_id string, conversation_id string, score double, computed_at timestamp, persisted_at timestamp"


def _moods(n, convs):
    rng = random.Random(6)
    return [(f"s{i}", f"c{rng.randrange(convs)}", rng.random(), START + timedelta(minutes=rng.randrange(20)),
             START + timedelta(minutes=i)) for i in range(n)]


def test_current_mood_over_batches(spark, tmp_path):
    rows = _moods(120, 5)
    stream = _drop_files(spark, tmp_path / "in", _chunks(rows, 5), MOODS)
    out = str(tmp_path / "out")
    p.maintain_current_mood(stream, "conversation_id", out, str(tmp_path / "cp"), every=2)
    batch = spark.createDataFrame(rows, MOODS)
    columns = ["conversation_id", "mood_id", "score"]
    want = sorted(state.conversation_mood(batch).select(columns).collect())
    kept = p.mood_table(out, "conversation_id", batch.schema)
    assert sorted(kept.read(spark).select(columns).collect()) == want
    assert [d for d in os.listdir(out) if d.startswith("base")]


def test_keyed_table_stays_small_and_replays(spark, tmp_path):
    """40 batches, some of them run again, one stopped before its base was written."""
    table = KeyedTable(str(tmp_path / "kept"), "k", "k string, v long", every=4)
    want = {}
    for b in range(40):
        before = dict(want)
        rows = [(f"k{(b * 3 + i) % 7}", b * 10 + i) for i in range(3)]
        assert {r.k: r.v for r in table.read(spark, b).collect()} == before
        table.write(b, spark.createDataFrame(rows, "k string, v long"))
        want |= dict(rows)
        if b in (7, 8, 15):
            if b == 15:
                os.remove(tmp_path / "kept" / "base=15" / "_SUCCESS")
            assert {r.k: r.v for r in table.read(spark, b).collect()} == before
            table.write(b, spark.createDataFrame(rows, "k string, v long"))
        assert {r.k: r.v for r in table.read(spark).collect()} == want
    assert len(os.listdir(tmp_path / "kept")) <= 2 + 2 * 4


def test_keyed_table_by_order(spark, tmp_path):
    """An older record that arrives later does not replace a newer one."""
    table = KeyedTable(str(tmp_path / "kept"), "k", "k string, at long", order=("at",), every=2)
    for b, at in enumerate((5, 9, 7, 8)):
        table.write(b, spark.createDataFrame([("a", at)], "k string, at long"))
    assert [r["at"] for r in table.read(spark).collect()] == [9]
    assert [r["at"] for r in table.read(spark, 1).collect()] in ([5], [])


def test_scores_and_failures(spark, tmp_path):
    """Against the rule told message by message, over batches and with a batch that is run again."""
    rows = [(m, c, "u-0" if i % 13 else "u-1", role, text, sent, received)
            for i, (m, c, _, role, text, sent, received) in enumerate(_messages(150))]
    stream = _drop_files(spark, tmp_path / "in", _chunks(rows, 3), SCHEMA)
    number = F.substring("message_id", 3, 4).cast("int")
    reject = F.when(number % 19 == 5, 413)
    calls = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(value):
        calls.add(1)
        return value

    def model(batch):
        assert batch.filter(F.col("text_clean").contains("@")).isEmpty()
        value = F.when(number % 7 == 3, float("nan")).otherwise(F.size("context_clean") / 30)
        return batch.withColumns(
            {"prediction": counted(value.cast("double")), "error_code": F.when(number % 3 == 0, "timeout"),
             "detail": F.when(number % 3 == 0, "no answer")}
        )

    clock = F.lit("2024-02-01 00:00:00").cast("timestamp")
    out = str(tmp_path / "s")
    p.score_stream(stream, reject, model, "mood-2024.01.0", out, str(tmp_path / "cp"), clock)
    statuses, scores, failures = p.recorded(spark, out)
    owner, kept, streak, want = {}, {}, {}, {}
    asked, blocked = 0, set()
    for i, (m, c, u, role, text, sent, received) in enumerate(rows):
        if i in (50, 100):
            blocked = {k for k, n in streak.items() if n >= 3}
        no = 413 if i % 19 == 5 else 422 if c not in owner and role == "agent" else None
        if no is None:
            no = 400 if owner.setdefault(c, u) != u else 200
        want[m] = (no, None)
        if no != 200 or role != "customer":
            continue
        size = min(29, len(kept.setdefault(c, [])))
        kept[c].append(m)
        asked += c not in blocked
        n = streak.get(c, 0)
        error = "timeout" if i % 3 == 0 else "score_out_of_range" if i % 7 == 3 else None
        want[m] = (200, "quarantined" if n >= 3 else error or round(size / 30, 9))
        streak[c] = n if n >= 3 else n + 1 if error else 0
    assert calls.value == asked
    got = {r.trigger_message_id: round(r.score, 9) for r in scores.collect()}
    got |= {r.trigger_message_id: r.error_code for r in failures.collect()}
    assert {r.message_id: (r.status, got.get(r.message_id)) for r in statuses.collect()} == want
    assert {"quarantined", "timeout", "score_out_of_range"} <= set(got.values())
    first = scores.first()
    assert (first.scale, first.model_version, first.mood_label) == ("-1 to 1", "mood-2024.01.0", None)
    assert scores.select("mood_id").distinct().count() == scores.count() and len(first.mood_id) == 36
    for r in failures.collect():
        assert (r.model_version is not None) == (r.error_code == "score_out_of_range") and r.detail and r.occurred_at


@pytest.mark.parametrize("copies", [2])
def test_redelivery(spark, tmp_path, copies):
    rows = _messages(60)
    late = [(*r[:6], r[6] + timedelta(days=400)) for r in rows]
    stream = _drop_files(spark, tmp_path / "in", [late, rows] + [rows] * (copies - 1), SCHEMA)
    kept = p.collect_stream(p.without_redelivery(stream), "once").collect()
    assert sorted(r.message_id for r in kept) == sorted(r[0] for r in rows)
    stream = _drop_files(spark, tmp_path / "in2", [rows] * copies, SCHEMA)
    kept = p.collect_stream(p.without_redelivery(stream, "received_at", "1 hour"), "once").collect()
    assert sorted(r.message_id for r in kept) == sorted(r[0] for r in rows)
