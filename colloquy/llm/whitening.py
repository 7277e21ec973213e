"""Embedding whitening by incremental eigendecomposition.

Vectors are put on a grid of whole numbers, x = floor(64 c) + 1000000, and fitted once each. Every partition keeps the
eigenvectors and eigenvalues of its scatter matrix and adds its vectors one by one: with n vectors of mean m seen, a
further x adds n / (n + 1) times (x - m)(x - m)', a rank-one change whose eigenvalues are the roots of a secular
equation. Directions that the change does not touch, and all but one of a run of equal eigenvalues, are deflated. Two
partitions' spectra are combined in the same way: the smaller one's scaled eigenvectors, and the difference of the means,
are successive rank-one changes of the larger one. Spectra are combined in a tree, some at a time.

Rounding adds up over so many changes, so the outcome is only a basis: a pass over all fitted vectors projects the exact
covariance on it, centred before multiplying, and the small matrix is diagonalised (Rayleigh-Ritz). The basis spans
the whole space, so the components are then those of the covariance to double precision; another pass measures what is
left, and refines again where it is not small. What a task or the driver holds is a few matrices of the vectors' width,
whatever their number.

Defined cases: a row whose vector is null, or has null or non-finite entries, goes, as do entries beyond 2^40 on the
grid and vectors of another length than most (the longer one at a tie), empty ones included; equal vectors are fitted once and
each row has its results; a null id stays null; components without variance (eigenvalue at most 1e-12 of the trace) are
left out, so one distinct vector, or none, gives an empty result; a deviation beyond 64 bits is null; other columns are
not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm.registry import query, table
from colloquy.session import materialize, spread

SCALE, SHIFT = 64, 1_000_000
GRID_MOST = 1 << 40
COMPONENTS = 16
NO_VARIANCE = 1e-12  # of the trace
FAN = 16  # spectra combined by one task
REFINED, MAX_REFINES = 1e-9, 5
SECULAR_STEPS = 80
ROWS = 4_096  # worked on at once
EPS = np.finfo(float).eps


def _roots(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """The roots of 1 + rho * sum(z_j^2 / (d_j - t)) for d ascending and distinct, z without zeros, |z| = 1; and
    root i minus d_j at (i, j), accurate also where they nearly meet. Rational interpolation by the two poles beside
    each root, kept inside a bracket, for all roots at once."""
    k = len(d)
    w = rho * z * z
    right = np.append(d[1:], d[-1] + rho)
    half = (right - d) / 2
    with np.errstate(all="ignore"):
        at_half = 1 + (w / (d - (d + half)[:, None])).sum(1)
    origin = np.where(at_half >= 0, np.arange(k), np.minimum(np.arange(k) + 1, k - 1))
    last_right = at_half[-1] < 0
    gap = d[None, :] - d[origin][:, None]
    low, high = np.where(origin == np.arange(k), 0.0, -half), np.where(origin == np.arange(k), half, 0.0)
    if last_right:
        low[-1], high[-1] = half[-1], 2 * half[-1]
    mu = (low + high) / 2
    left_pole = d - d[origin]
    right_pole = right - d[origin]
    below = np.tri(k)  # poles up to the root's left one, whose terms are negative
    inverse, terms = np.empty((k, k)), np.empty((k, k))
    for _ in range(SECULAR_STEPS):
        np.subtract(gap, mu[:, None], out=inverse)
        np.reciprocal(inverse, out=inverse)
        np.multiply(inverse, w, out=terms)
        total, negative = terms.sum(1), np.einsum("ij,ij->i", terms, below)
        f = 1 + total
        size = 1 + total - 2 * negative
        done = np.abs(f) <= EPS * size
        if done.all():
            break
        low, high = np.where(f < 0, mu, low), np.where(f > 0, mu, high)
        np.multiply(terms, inverse, out=terms)  # slopes
        psi = np.einsum("ij,ij->i", terms, below)
        phi = terms.sum(1) - psi
        d1, d2 = left_pole - mu, right_pole - mu
        a = (d1 + d2) * f - d1 * d2 * (psi + phi)
        b = d1 * d2 * f
        c = f - d1 * psi - d2 * phi
        with np.errstate(all="ignore"):
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        new = mu + step
        new = np.where(np.isfinite(new) & (new > low) & (new < high), new, (low + high) / 2)
        stuck = (new == mu) | (new == low) | (new == high)
        mu = np.where(done, mu, new)
        if (done | stuck).all():
            break
    return d[origin] + mu, mu[:, None] - gap


def _merge_equal(d: np.ndarray, z: np.ndarray, u: np.ndarray, active: np.ndarray, tol: float) -> np.ndarray:
    """Turns pairs of (nearly) equal eigenvalues so that only one of the two is touched; returns what stays active."""
    keep = []
    last = -1
    for j in active:
        if last >= 0:
            t = np.hypot(z[last], z[j])
            c, s = z[j] / t, -z[last] / t
            if abs((d[j] - d[last]) * c * s) <= tol:
                z[j], z[last] = t, 0.0
                u[:, [last, j]] = u[:, [last, j]] @ np.array([[c, -s], [s, c]])
                d[last], d[j] = d[last] * c * c + d[j] * s * s, d[last] * s * s + d[j] * c * c
                keep.pop()
        keep.append(j)
        last = j
    return np.array(keep, int)


def rank_one(d: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending eigenvalues and eigenvectors of u diag(d) u' + v v'."""
    z = v @ u
    rho = float(z @ z)
    if rho == 0:
        return d, u
    z = z / np.sqrt(rho)
    tol = 8 * EPS * max(float(d[-1]), rho)
    active = np.flatnonzero(rho * np.abs(z) > tol)
    if not len(active):
        return d, u
    da, za = d[active], z[active]
    if len(active) > 1 and (np.diff(da) * np.abs(za[1:] * za[:-1]) / (za[1:] ** 2 + za[:-1] ** 2) <= tol).any():
        d, z, u = d.copy(), z, u.copy()
        active = _merge_equal(d, z, u, active, tol)
        active = active[np.argsort(d[active], kind="stable")]
        da, za = d[active], z[active]
    norm = np.sqrt(za @ za)
    za, weight = za / norm, rho * norm * norm
    k = len(active)
    if k == 1:
        roots, turned = da + weight, u[:, active]
    else:
        roots, gaps = _roots(da, za, weight)
        # the vector whose secular roots these are exactly, which keeps the new eigenvectors orthogonal
        beside = da[:, None] - da[None, :]  # above the diagonal; from it on, the difference of the next one down
        beside[np.tri(k, dtype=bool)] = np.vstack([beside[1:], np.ones(k)])[np.tri(k, dtype=bool)]
        exact = np.sqrt(np.abs(np.prod(gaps / beside, 0)))
        q = np.copysign(exact, za)[None, :] / -gaps
        q /= np.sqrt((q * q).sum(1))[:, None]
        turned = u[:, active] @ q.T
    values, vectors = d.copy(), u.copy()
    values[active], vectors[:, active] = roots, turned
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


@dataclass
class Spectrum:
    """n vectors, their exact sums on the grid less SHIFT, their mean there, and the eigenvalues (ascending) and
    eigenvectors of their scatter matrix."""

    n: int
    sums: list[int]
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, width: int) -> Spectrum:
        return cls(0, [0] * width, np.zeros(width), np.zeros(width), np.eye(width))

    def add(self, rows: np.ndarray) -> None:
        """Vectors on the grid less SHIFT, one after the other."""
        for y in rows.astype(float):
            away = y - self.mean
            if self.n:
                self.values, self.vectors = rank_one(
                    self.values, self.vectors, away * np.sqrt(self.n / (self.n + 1))
                )
            self.n += 1
            self.mean = self.mean + away / self.n
        self.sums = [a + int(b) for a, b in zip(self.sums, rows.sum(0))]

    def joined(self, other: Spectrum) -> Spectrum:
        large, small = (self, other) if self.n >= other.n else (other, self)
        n = large.n + small.n
        if not small.n:
            return large
        away = small.mean - large.mean
        values, vectors = rank_one(large.values, large.vectors, away * np.sqrt(large.n * small.n / n))
        for value, vector in zip(small.values, small.vectors.T):
            if value > 0:
                values, vectors = rank_one(values, vectors, vector * np.sqrt(value))
        sums = [a + b for a, b in zip(large.sums, small.sums)]
        return Spectrum(n, sums, large.mean + away * (small.n / n), values, vectors)


SPECTRUM = "place int, n long, sums array<long>, mean array<double>, e array<double>, u array<double>"


def _spectrum_batch(place: int, s: Spectrum) -> pa.RecordBatch:
    lists = [pa.array([s.sums], pa.list_(pa.int64()))] + [
        pa.array([a.ravel()], pa.list_(pa.float64())) for a in (s.mean, s.values, s.vectors)
    ]
    return pa.RecordBatch.from_arrays(
        [pa.array([place], pa.int32()), pa.array([s.n], pa.int64()), *lists], names=["place", "n", "sums", "mean", "e", "u"]
    )


def _spectra(rows: list[dict]) -> Iterator[Spectrum]:
    for r in rows:
        width = len(r["mean"])
        yield Spectrum(r["n"], r["sums"], np.array(r["mean"]), np.array(r["e"]), np.array(r["u"]).reshape(width, width))


def _rows(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Vectors on the grid, less SHIFT, some at a time."""
    for at in range(0, len(column), ROWS):
        yield column.slice(at, ROWS).flatten().to_numpy(zero_copy_only=False).reshape(-1, width) - SHIFT


def _place() -> int:
    return TaskContext.get().partitionId()


def _in_tree(df: DataFrame, combine: Callable[[pa.Table], pa.RecordBatch], schema: str) -> dict | None:
    """The one row that is left when FAN rows at a time, neighbours by `place`, are combined; None if there are none."""
    df = materialize(df, "parts")
    left = (df.agg(F.max("place")).first()[0] or 0) + 1
    while left > 1:
        df = df.withColumn("place", F.expr(f"place div {FAN}").cast("int"))
        df = df.groupBy("place").applyInArrow(lambda t: pa.Table.from_batches([combine(t)]), schema)
        left = -(-left // FAN)
    found = df.collect()  # one row
    return found[0].asDict() if found else None


def spectrum(fit: DataFrame, width: int) -> Spectrum | None:
    """The combined spectrum of the vectors `x` of `fit`."""

    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Spectrum.empty(width)
        for batch in batches:
            for rows in _rows(batch.column(0), width):
                own.add(rows)
        if own.n:
            yield _spectrum_batch(_place(), own)

    def combine(t: pa.Table) -> pa.RecordBatch:
        rows = sorted(t.to_pylist(), key=lambda r: r["n"])
        all_ = list(_spectra(rows))
        whole = all_[-1]
        for s in all_[-2::-1]:
            whole = whole.joined(s)
        return _spectrum_batch(rows[0]["place"], whole)

    row = _in_tree(fit.select("x").mapInArrow(partition, SPECTRUM), combine, SPECTRUM)
    return next(_spectra([row])) if row else None


def projected(fit: DataFrame, mean: np.ndarray, n: int, basis: np.ndarray) -> np.ndarray:
    """The covariance of the vectors of `fit`, projected on the columns of `basis`."""
    width = len(mean)
    schema = "place int, m array<double>"

    def batch_of(place: int, m: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([place], pa.int32()), pa.array([m.ravel()], pa.list_(pa.float64()))], names=["place", "m"]
        )

    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((basis.shape[1],) * 2)
        for batch in batches:
            for rows in _rows(batch.column(0), width):
                on = (rows - mean) @ basis
                total += on.T @ on
        yield batch_of(_place(), total)

    def combine(t: pa.Table) -> pa.RecordBatch:
        rows = sorted(t.to_pylist(), key=lambda r: r["m"])  # the same sum in any order of arrival
        return batch_of(rows[0]["place"], np.sum([r["m"] for r in rows], 0))

    m = np.array(_in_tree(fit.select("x").mapInArrow(partition, schema), combine, schema)["m"])
    m = m.reshape(basis.shape[1], -1) / n
    return (m + m.T) / 2


@dataclass
class Whitening:
    """n fitted vectors with exact sums on the grid less SHIFT; eigenvalues, falling, of the components with variance, and
    the components as columns; the trace; the largest entry by which the whitened covariance of the first COMPONENTS
    differs from the identity."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    error: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def fit_whitening(fit: DataFrame, width: int) -> Whitening | None:
    """The whitening of the distinct vectors `x` of `fit`, or None where there is no variance."""
    fit = spread(fit)
    found = spectrum(fit, width)
    if found is None or found.n < 2:
        return None
    made = Whitening(found.n, found.sums, found.values, found.vectors, 0.0, 0.0)
    basis = np.linalg.qr(found.vectors)[0]
    for _ in range(MAX_REFINES):
        ritz = projected(fit, made.mean, made.n, basis)
        some = np.diag(ritz) > NO_VARIANCE * np.trace(ritz)
        scale = np.sqrt(np.where(some, np.diag(ritz), np.trace(ritz) or 1.0))
        off = np.abs(ritz / np.outer(scale, scale))
        np.fill_diagonal(off, 0)
        values = np.diag(ritz)
        if off.max() <= REFINED and (np.diff(values) <= 0).all():
            break
        values, turn = np.linalg.eigh(ritz)
        basis = np.linalg.qr(basis @ turn[:, ::-1])[0]
    else:
        raise RuntimeError(f"components did not settle in {MAX_REFINES} refinements")
    made.values, made.vectors, made.trace = values[some], basis[:, some], float(np.trace(ritz))
    if not some.any():
        return None
    top = ritz[np.ix_(some, some)][:COMPONENTS, :COMPONENTS]
    root = np.sqrt(made.values[:COMPONENTS])
    made.error = float(np.abs(top / np.outer(root, root) - np.eye(len(root))).max())
    return made


WHITENED = (
    "component int, n long, deviation long, whitened double, explained double, identity_error double"
)


def _deviations(y: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Sums over the dimensions of (n x - S)^2, exact; None beyond 64 bits."""
    away = n * y.astype(object) - sums if n * float(np.abs(y).max(initial=0)) >= 2.0**61 else n * y - sums.astype(np.int64)
    near = (away.astype(float) ** 2).sum(1)
    out: list[int | None] = [None] * len(y)
    sure = near < 2.0**62
    exact = (away[sure].astype(np.int64) ** 2).sum(1)
    for i, v in zip(np.flatnonzero(sure), exact.tolist()):
        out[i] = v
    for i in np.flatnonzero(~sure & (near < 2.0**64)):
        v = sum(int(a) ** 2 for a in away[i])
        out[i] = v if v < 1 << 63 else None
    return out


def whiten(df: DataFrame, vector: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """A row per usable vector and component: id, component (from 1), n, deviation, whitened, explained, identity_error."""
    c = F.col("_c")
    usable = c.isNotNull() & ~F.exists(
        c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) > F.lit(float((GRID_MOST - SHIFT) // SCALE)))
    )
    grid = df.select(F.col(id_col).alias("_id"), F.col(vector).cast("array<double>").alias("_c")).where(usable).select(
        "_id", F.transform(c, lambda v: F.floor(v * SCALE) + F.lit(SHIFT).cast("long")).alias("x")
    )
    common = grid.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    width = common.width if common else 0
    grid = grid.where(F.size("x") == width)
    fit = materialize(grid.select("x").distinct(), "distinct-vectors") if width else None
    model = fit_whitening(fit, width) if width else None
    names = [f.split()[0] for f in WHITENED.split(", ")]
    id_type = df.schema[id_col].dataType.simpleString()
    schema = f"`_id` {id_type}, {WHITENED}"
    if model is None:
        empty = df.sparkSession.createDataFrame([], schema)
        return empty.select(F.col("_id").alias(id_col), *names)
    k = min(COMPONENTS, len(model.values))
    turn = model.vectors[:, :k] / np.sqrt(model.values[:k])
    share = model.values[:k] / model.trace
    n, mean, sums, error = model.n, model.mean, np.array(model.sums, object), model.error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for y in _rows(batch.column(1), width):
                ids = batch.column(0).slice(at, len(y))
                at += len(y)
                whole = len(y) * k
                deviation = pa.array(_deviations(y, n, sums), pa.int64())
                each = pa.array(np.repeat(np.arange(len(y)), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(y))),
                        pa.array(np.full(whole, n)), deviation.take(each), pa.array(((y - mean) @ turn).ravel()),
                        pa.array(np.tile(share, len(y))), pa.array(np.full(whole, error)),
                    ],
                    names=["_id", *names],
                )

    return grid.mapInArrow(run, schema).select(F.col("_id").alias(id_col), *names)


@query("op12_embedding_whitening")
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
