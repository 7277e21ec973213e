"""Online window, streaks, quarantine and admission against sequential Python."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from colloquy.operators import dataset, online

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def _arrivals(n=500, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        conv = "c-hot" if rng.random() < 0.4 else f"c-{rng.randrange(12)}"
        sent = START + timedelta(seconds=rng.randrange(4_000))
        rows.append((f"m-{i:04d}", conv, f"u-{rng.randrange(2)}", rng.choice(["customer", "customer", "agent"]),
                     f"text {i}", sent, START + timedelta(seconds=5_000 + i)))
    return rows


SCHEMA = ("message_id string, conversation_id string, customer_id string, role string, text string,"
          " sent_at timestamp, received_at timestamp")


@pytest.mark.parametrize("limit", [8, 40, 10_000])
def test_online_window_equals_sequential_scan(spark, limit):
    rows = _arrivals()
    got = {r.message_id: list(r.history_ids)
           for r in online.online_histories(spark.createDataFrame(rows, SCHEMA), limit).collect()}
    want, seen = {}, {}
    for m in rows:
        if m[3] != "customer":
            continue
        earlier = sorted(seen.setdefault(m[1], []), key=lambda e: (e[5], e[6]))[-29:]
        want[m[0]] = [e[0] for e in earlier] + [m[0]]
        seen[m[1]].append(m)
    assert got == want


@pytest.mark.parametrize("limit", [8, 10_000])
def test_offline_window_equals_naive(spark, limit):
    rows = _arrivals(seed=9)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.message_id: list(r.h) for r in dataset.history_windows(df, F.col("message_id"), "h", limit).collect()}
    customers = [m for m in rows if m[3] == "customer"]
    for m in customers:
        same = sorted((e for e in customers if e[1] == m[1]), key=lambda e: (e[5], e[0]))
        upto = [e[0] for e in same if (e[5], e[0]) <= (m[5], m[0])]
        assert got[m[0]] == upto[-30:]


@pytest.mark.parametrize("limit", [8, 10_000])
def test_streaks_and_quarantine(spark, limit):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.4 else f"c{rng.randrange(15)}", i, rng.randrange(3_000),
             "failure" if rng.random() < 0.45 else "score") for i in range(700)]
    rows = [(c, i, t, k, "timeout" if k == "failure" else None) for c, i, t, k in rows]
    df = spark.createDataFrame(rows, "conversation_id string, seq long, at_us long, kind string, error_code string")
    got = {r.seq: (r.failures, r.outcome) for r in online.replay_quarantine(df, limit).collect()}
    streak, blocked = {}, set()
    for c, i, _, k, code in sorted(rows, key=lambda r: (r[2], r[1])):
        streak[c] = streak.get(c, 0) + 1 if k == "failure" else 0
        want = "quarantined" if c in blocked else ("scored" if k == "score" else code)
        assert got[i] == (streak[c], want)
        if streak[c] >= 3:
            blocked.add(c)


@pytest.mark.parametrize("limit", [8, 10_000])
def test_admission_in_arrival_order(spark, limit):
    rows = _arrivals(seed=7)
    df = spark.createDataFrame(rows, SCHEMA)
    reject = F.when(F.col("text").endswith("7"), 400).cast("int")
    got = {r.message_id: r.status for r in online.admit(df, reject, ["received_at", "message_id"], limit).collect()}
    owner = {}
    for m in rows:
        if m[4].endswith("7"):
            want = 400
        elif m[1] not in owner and m[3] == "agent":
            want = 422
        elif m[1] in owner and owner[m[1]] != m[2]:
            want = 400
        else:
            owner.setdefault(m[1], m[2])
            want = 200
        assert got[m[0]] == want


@pytest.mark.parametrize("limit", [5, 8, 10_000])
def test_quarantine_gate_sees_earlier_outcomes_only(spark, limit):
    rng = random.Random(4)
    rows = [("hot" if rng.random() < 0.4 else f"c{rng.randrange(15)}", i, rng.randrange(3_000),
             "failure" if rng.random() < 0.6 else "score") for i in range(500)]
    df = spark.createDataFrame(
        [(c, s, t, k, "timeout" if k == "failure" else None) for c, s, t, k in rows],
        "conversation_id string, seq long, at_us long, kind string, error_code string",
    )
    got = {r.seq: (r.failures_before, r.blocked) for r in online.quarantine_state(df, limit).collect()}
    want, streak = {}, {}
    for c, s, _, k in sorted(rows, key=lambda r: (r[2], r[1])):
        n = streak.get(c, 0)
        want[s] = (n, n >= 3)
        streak[c] = n + 1 if k == "failure" else 0
    assert got == want
