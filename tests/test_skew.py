"""Skew-safe windows and joins against plain Python, with keys forced to split."""

import random

import pytest
from pyspark.sql import functions as F

from colloquy.operators import skew


def _rows(n=600, seed=3):
    rng = random.Random(seed)
    # a third of the rows in one key, the others spread
    return [
        (i, "hot" if rng.random() < 0.34 else f"k{rng.randrange(20)}", rng.randrange(10_000), rng.randrange(-5, 6))
        for i in range(n)
    ]


@pytest.fixture()
def frame(spark):
    rows = _rows()
    return rows, spark.createDataFrame(rows, "id long, k string, t long, v long")


def _by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        out.setdefault(r[1], []).append(r)
    return out


@pytest.mark.parametrize("limit", [3, 10, 50, 10_000])
def test_segments_follow_the_order(frame, limit):
    rows, df = frame
    got = skew.with_segments(df, ["k"], "t", limit).collect()
    hot = sorted((r for r in got if r.k == "hot"), key=lambda r: r.t)
    assert [r._seg for r in hot] == sorted(r._seg for r in hot)
    if limit <= 50:
        assert len({r._seg for r in hot}) > 1
    else:
        assert {r._seg for r in got} == {0}


@pytest.mark.parametrize("limit", [3, 20, 10_000])
def test_trailing_equals_brute_force(frame, limit):
    rows, df = frame
    for size in (2, 5, 30):
        got = {
            r.id: list(r.h)
            for r in skew.trailing(df, ["k"], ["t", "id"], size, F.col("id"), "h", limit).collect()
        }
        want = {}
        for group in _by_key(rows).values():
            for i, r in enumerate(group):
                want[r[0]] = [g[0] for g in group[max(0, i - size + 1) : i + 1]]
        assert got == want


@pytest.mark.parametrize("limit", [3, 20, 10_000])
def test_running_and_position(frame, limit):
    rows, df = frame
    seg = skew.with_segments(df, ["k"], "t", limit)
    got = skew.running(
        seg, ["k"], ["t", "id"], {"s": ("sum", F.col("v")), "hi": ("max", F.col("v")), "lo": ("min", F.col("v"))}
    ).collect()
    pos = {r.id: r.position for r in skew.with_position(df, ["k"], ["t", "id"], rows=limit).collect()}
    want = {}
    for group in _by_key(rows).values():
        for i, r in enumerate(group):
            vs = [g[3] for g in group[: i + 1]]
            want[r[0]] = (sum(vs), max(vs), min(vs))
            assert pos[r[0]] == i + 1
    assert {r.id: (r.s, r.hi, r.lo) for r in got} == want
    whole = {r.id: r.position for r in skew.with_position(df, [], ["t", "id"], rows=limit).collect()}
    order = sorted(rows, key=lambda r: (r[2], r[0]))
    assert whole == {r[0]: i + 1 for i, r in enumerate(order)}


@pytest.mark.parametrize("limit", [5, 10_000])
def test_lookup_join_and_keep_first(spark, frame, limit):
    rows, df = frame
    df = df.unionByName(spark.createDataFrame([(9_001, None, 1, 1)], df.schema))
    rows = [*rows, (9_001, None, 1, 1)]
    names = spark.createDataFrame([("hot", "H"), ("k1", "one")], "k string, name string")
    for how in ("left", "inner"):
        got = sorted((r.id, r.name) for r in skew.lookup_join(df, names, ["k"], how, limit).collect())
        lookup = {"hot": "H", "k1": "one"}
        want = sorted((r[0], lookup.get(r[1])) for r in rows if how == "left" or r[1] in lookup)
        assert [g[0] for g in got] == [w[0] for w in want] and dict(got) == dict(want)
    anti = {r.id for r in skew.lookup_join(df, names, ["k"], "left_anti", limit).collect()}
    assert anti == {r[0] for r in rows if r[1] not in ("hot", "k1")}
    first = {r.id for r in skew.keep_first(df, ["k"], ["id"], "f").filter("f").collect()}
    seen = {}
    for r in rows:
        seen.setdefault(r[1], r[0])
    assert first == set(seen.values())


@pytest.mark.parametrize("limit", [3, 10_000])
def test_trailing_keeps_nulls(spark, limit):
    rows = [(i, "k", i, None if i % 3 == 0 else i) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, k string, t long, v long")
    got = {r.id: list(r.h) for r in skew.trailing(df, ["k"], ["t"], 4, F.col("v"), "h", limit).collect()}
    assert got == {i: [r[3] for r in rows[max(0, i - 3) : i + 1]] for i in range(40)}
    before = {r.id: r.b for r in skew.previous(df, ["k"], ["t"], "v", "b", limit).collect()}
    assert before == {i: rows[i - 1][3] if i else None for i in range(40)}


def test_equal_rows_of_a_hot_key_are_spread(spark):
    """A frame of one column: nothing but their place tells its rows apart."""
    df = spark.range(3000).select(F.lit("hot").alias("k"))
    names = spark.createDataFrame([("hot", 1)], "k string, n int")
    joined = skew.lookup_join(df, names, ["k"], "left", 100)
    assert joined.count() == 3000 and joined.filter("n = 1").count() == 3000
    salts = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in salts
    hot = skew.hot_keys(df, ["k"], 100)
    assert hot.first()._n == 3000 and skew.hot_keys(df, ["k"], 3000) is None


def test_ties_are_cut(spark):
    """All times equal: the second column of the order still cuts the key."""
    rows = [(i, "hot", 5, i % 7) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, k string, t long, v long")
    seg = skew.with_segments(df, ["k"], ["t", "id"], 50)
    sizes = [r["count"] for r in seg.groupBy("_seg").count().collect()]
    assert len(sizes) > 5 and max(sizes) < 400
    pos = {r.id: r.position for r in skew.with_position(df, ["k"], ["t", "id"], rows=50).collect()}
    assert pos == {i: i + 1 for i in range(900)}


def test_plain_window_where_nothing_is_hot(spark, frame):
    _, df = frame
    plan = skew.trailing(df, ["k"], ["t", "id"], 5, F.col("id"), "h", 10_000)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 1 and "Join" not in plan


@pytest.mark.parametrize("limit", [3, 20, 10_000])
def test_running_over_earlier_rows_only(frame, limit):
    """The first row of a key has nothing before it: 0 for sums and xor, null for extremes, at any limit."""
    rows, df = frame
    kinds = {"s": "sum", "hi": "max", "lo": "min", "x": "xor"}
    for inclusive in (False, True):
        seg = skew.with_segments(df, ["k"], "t", limit)
        got = skew.running(seg, ["k"], ["t", "id"], {o: (k, F.col("v")) for o, k in kinds.items()}, inclusive)
        want = {}
        for group in _by_key(rows).values():
            for i, r in enumerate(group):
                vs = [g[3] for g in group[: i + inclusive]]
                x = 0
                for v in vs:
                    x ^= v
                want[r[0]] = (sum(vs), max(vs, default=None), min(vs, default=None), x)
        assert {r.id: (r.s, r.hi, r.lo, r.x) for r in got.collect()} == want
