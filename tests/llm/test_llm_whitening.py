"""Whitening against a dense eigendecomposition."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import catalog, whitening

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>"


def brute(vectors):
    """`vectors`: float arrays of usable rows; (deviations, whitened, explained) up to signs."""
    x = np.array([[int(np.floor(64 * float(v))) + 1_000_000 for v in row] for row in vectors], object)
    fit = np.array(sorted({tuple(r) for r in x}), object)
    n, s = len(fit), fit.sum(0)
    mean = np.array([float(v) for v in s - n * 1_000_000]) / n
    y = (fit - 1_000_000).astype(float) - mean
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1], u[:, ::-1]
    k = min(16, int((e > 1e-12 * e.sum()).sum()))
    white = ((x - 1_000_000).astype(float) - mean) @ u[:, :k] / np.sqrt(e[:k])
    return n, [int(((n * r - s) ** 2).sum()) for r in x], white, e[:k] / e.sum()


def check(rows, kept):
    n, deviations, white, explained = brute([v for _, v in kept])
    k = len(explained)
    assert len(rows) == len(kept) * k
    got = {}
    for r in rows:
        got.setdefault(r.vec_id, {})[r.component] = r
    signs = None
    for (i, _), deviation, w in zip(kept, deviations, white):
        mine = got[i]
        assert sorted(mine) == list(range(1, k + 1))
        assert {r.n for r in mine.values()} == {n} and {r.deviation for r in mine.values()} == {deviation}
        ours = np.array([mine[c].whitened for c in range(1, k + 1)])
        if signs is None:
            signs = np.zeros(k)
        new = (signs == 0) & (np.abs(w) > 1e-3)
        signs[new] = np.sign(ours[new] * w[new])
        assert ours == pytest.approx(np.where(signs == 0, 1, signs) * w, abs=2e-3 if not signs.all() else 1e-7)
        assert [mine[c].explained for c in range(1, k + 1)] == pytest.approx(explained, rel=1e-9)
        assert max(r.identity_error for r in mine.values()) <= 1e-8


def test_embeddings(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    check(catalog.QUERIES["op12_embedding_whitening"](spark, SF).collect(), [tuple(r) for r in rows])


@pytest.mark.parametrize("kind", ["normal", "few values", "low rank", "copies", "equal variances"])
def test_spectra(kind):
    """Rank-one changes and their combination give the scatter matrix."""
    rng = np.random.default_rng(1)
    x = {
        "normal": rng.normal(0, 30, (150, 24)),
        "few values": rng.integers(0, 2, (150, 9)),
        "low rank": rng.normal(0, 1, (150, 3)) @ rng.normal(0, 40, (3, 24)),
        "copies": np.repeat(rng.normal(0, 30, (9, 12)), 17, 0),
        "equal variances": np.concatenate([np.eye(12) * 8, -np.eye(12) * 8]),
    }[kind].round().astype(np.int64)
    parts = [whitening.Spectrum.empty(x.shape[1]) for _ in range(3)]
    for s, rows in zip(parts, np.array_split(x, [5, 60])):
        s.add(rows)
    whole = parts[0].joined(parts[1]).joined(parts[2])
    away = x - x.mean(0)
    scatter = away.T @ away
    assert whole.n == len(x) and whole.sums == x.sum(0).tolist() and whole.mean == pytest.approx(x.mean(0))
    scale = np.abs(scatter).max()
    assert np.abs(whole.vectors.T @ whole.vectors - np.eye(x.shape[1])).max() < 1e-12
    assert np.abs(whole.vectors * whole.values @ whole.vectors.T - scatter).max() < 1e-11 * scale
    assert (np.diff(whole.values) >= 0).all()


def test_odd_rows(spark):
    rng = np.random.default_rng(2)
    good = [(i, [float(np.float32(v)) for v in rng.normal(0, 1, 5)]) for i in range(40)]
    good += [(40, good[0][1]), (41, good[0][1]), (42, [1000.0, -1000.0, 0.0, 0.0, 0.0])]
    bad = [(50, None), (51, [1.0, None, 0.0, 0.0, 0.0]), (52, [float("nan")] * 5), (53, [float("inf")] + [0.0] * 4),
           (54, [1.0, 2.0]), (55, []), (56, [3e30] + [0.0] * 4)]
    df = spark.createDataFrame(good + bad, SCHEMA)
    clash = df.select("*", *(F.lit(1).alias(c) for c in "_id _c x n place component whitened u e".split()))
    check(whitening.whiten(clash).collect(), good)
    named = spark.createDataFrame([(None, v) for _, v in good[:6]] + [(1, good[7][1])], SCHEMA)
    out = whitening.whiten(named)
    assert out.columns == "vec_id component n deviation whitened explained identity_error".split()
    assert out.where("vec_id IS NULL").count() == 6 * 5
    for few in (good[:1], [good[0], good[40]], bad[:2], []):
        assert whitening.whiten(spark.createDataFrame(few, SCHEMA)).collect() == []


def test_large_deviations(spark):
    """Beyond 64 bits the deviation is null; what fits is exact."""
    rows = [(i, [float(1 << 22) * (-1) ** i, float(i)]) for i in range(64)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    _, deviations, _, _ = brute([v for _, v in rows])
    assert {(r.vec_id, r.deviation) for r in got} == {
        (i, d if d < 1 << 63 else None) for (i, _), d in zip(rows, deviations)
    }
    y = np.array([[3, 4], [5, 6]])
    assert whitening._deviations(y, 10**18, np.array([3 * 10**18, 4 * 10**18], object)) == [0, None]
