"""Toxicity scores from a factorization machine over hashed terms.

The terms of a text are its words (ASCII letters folded) and their beginnings of four, five and six bytes, so inflected
forms share terms. All are hashed to 2^TERM_BITS. On a bounded sample of labelled rows (`MAX_ROWS`, those with the least
hash of their id) Spark counts the documents of either label per term and keeps, by rank whatever the size of the sample,
the terms with the strongest association (G statistic) and those that part the documents most evenly, since a term that
matters only together with another has no association of its own. No association is too weak to count; a term learns at
a pace of G / (G + 2 ln(terms)), as the strongest of so many terms without meaning would have about 2 ln(terms). A factorization machine learns a weight per kept term and, through a short vector per term, a weight for
every pair of terms that meet in one text; a linear model cannot tell an insult alone from an insult with the mention of
a group. It is fitted on the sample's kept terms, which are small numbers of small rows, and scores whole texts where
they are, without a shuffle.

Defined cases: a null or empty text has no terms and gets the base rate; null labels are ignored and a document that is
labelled more than once is toxic if any of its labels says so; a null id counts as the empty text when held-out rows are
chosen; without labels of both kinds every score is the base rate (0.0 without any label); repeated rows are scored
alike; other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.llm import textbytes as tb
from colloquy.llm.arrowmap import id_hash, with_columns
from colloquy.llm.registry import query, table
from colloquy.session import materialize

TERM_BITS = 20
BEGINNINGS = (4, 5, 6)
MAX_ROWS = 50_000  # labelled rows that the fit may use
MAX_TERMS = 4_096  # terms kept
EVEN_TERMS = 256  # of them for parting the documents evenly
EVEN_PACE = 0.5  # of their vectors at least
FACTORS = 8
EPOCHS = 40
PENALTY = 1e-4


def _term_rows(column: pa.Array, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, term) pairs of a text column, each once. `keep` maps terms to numbers, negative ones are left out."""
    rows, terms = [], []
    for low, high, w in tb.tokenized(column, tb.ALNUM, tb.LOWER):
        length = w.stop - w.start
        if not len(length):
            continue
        row = w.row + low
        for salt, size in enumerate((0, *BEGINNINGS)):
            long = slice(None) if not size else np.flatnonzero(length > size)
            start = w.start[long]
            stop = w.stop[long] if not size else start + size
            h = tb.mix(tb.stretch_hash(w.sums, start, stop) + np.uint64(salt))
            term = (h >> np.uint64(64 - TERM_BITS)).astype(np.int64)
            owner = row[long]
            if keep is not None:
                term = keep[term]
                known = term >= 0
                owner, term = owner[known], term[known]
            rows.append(owner)
            terms.append(term)
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pairs = np.unique((np.concatenate(rows) << TERM_BITS) | np.concatenate(terms))
    return pairs >> TERM_BITS, pairs & ((1 << TERM_BITS) - 1)


def _numbering(terms: np.ndarray) -> np.ndarray:
    keep = np.full(1 << TERM_BITS, -1, np.int32)
    keep[terms] = np.arange(len(terms))
    return keep


@dataclass
class FactorizationMachine:
    """terms: the kept hashed terms; weights and vectors in their order."""

    terms: np.ndarray
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def margins(self, row: np.ndarray, number: np.ndarray, rows: int) -> np.ndarray:
        """Log odds of each row from its (row, term number) pairs."""
        linear = np.bincount(row, self.weights[number], rows)
        pairs = np.zeros(rows)
        for f in range(self.vectors.shape[1]):
            v = self.vectors[number, f]
            pairs += np.bincount(row, v, rows) ** 2 - np.bincount(row, v * v, rows)
        return self.bias + linear + 0.5 * pairs


def _fit(
    terms: np.ndarray, lists: list[np.ndarray], label: np.ndarray, pace: np.ndarray, pair_pace: np.ndarray, seed: int = 7
) -> FactorizationMachine:
    """AdaGrad on the logistic loss over small batches in a seeded order. The steps of a term's weight and vector are
    scaled by its pace."""
    rng = np.random.default_rng(seed)
    n, m = len(label), len(terms)
    rate = (label.sum() + 0.5) / (n + 1)
    model = FactorizationMachine(
        terms, float(np.log(rate / (1 - rate))), np.zeros(m), rng.normal(0, 0.02, (m, FACTORS)) * pair_pace[:, None]
    )
    if not m or not 0 < label.sum() < n:
        return model
    size = np.array([len(x) for x in lists])
    first = np.concatenate([[0], np.cumsum(size)])
    flat = np.concatenate(lists)
    w, v = model.weights, model.vectors
    gw, gv, gb = np.full(m, 1e-4), np.full((m, FACTORS), 1e-4), 1e-4
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for at in range(0, n, 256):
            batch = order[at : at + 256]
            count = size[batch]
            row = np.repeat(np.arange(len(batch)), count)
            t = flat[np.repeat(first[batch], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
            t = t.astype(np.int64)
            vt = v[t]
            sums = np.stack([np.bincount(row, vt[:, f], len(batch)) for f in range(FACTORS)], 1)
            squares = np.bincount(row, (vt**2).sum(1), len(batch))
            margin = model.bias + np.bincount(row, w[t], len(batch)) + 0.5 * ((sums**2).sum(1) - squares)
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - label[batch]) / len(batch)
            dw = np.bincount(t, error[row], m) + PENALTY * w
            slope = error[row, None] * (sums[row] - vt)
            dv = PENALTY * v + np.stack([np.bincount(t, slope[:, f], m) for f in range(FACTORS)], 1)
            gw += dw**2
            gv += dv**2
            gb += error.sum() ** 2
            w -= 0.1 * pace * dw / np.sqrt(gw)
            v -= 0.02 * pair_pace[:, None] * dv / np.sqrt(gv)
            model.bias -= 0.05 * error.sum() / np.sqrt(gb)
    return model


def fit(
    docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "toxic",
    max_rows: int = MAX_ROWS,
) -> FactorizationMachine:
    """Fit on the documents that `labels` names, at most `max_rows` of them."""
    spark = docs.sparkSession
    chosen = (
        labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.max(label).cast("int").alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(max_rows)
    )
    # At most max_rows pairs of numbers, so this side is always small enough to send to every executor.
    sample = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")).join(
        F.broadcast(materialize(chosen, "labelled")), "_id"
    )

    def tally(batches):
        counts = np.zeros((2, 1 << TERM_BITS), np.int64)
        n = np.zeros(2, np.int64)
        for batch in batches:
            y = np.array(batch.column("_label")) > 0
            row, term = _term_rows(batch.column("_text"))
            for k in (0, 1):
                counts[k] += np.bincount(term[y[row] == bool(k)], minlength=1 << TERM_BITS)
                n[k] += (y == bool(k)).sum()
        used = np.flatnonzero(counts.sum(0))
        term, no, yes = np.append(used, -1), np.append(counts[0][used], n[0]), np.append(counts[1][used], n[1])
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (term, no, yes)], names=["term", "no", "yes"])

    counted = sample.select("_text", "_label").mapInArrow(tally, "term long, no long, yes long")
    counted = materialize(counted.groupBy("term").agg(F.sum("no").alias("no"), F.sum("yes").alias("yes")), "terms")
    total = counted.where("term = -1").first()
    no, yes = (total["no"], total["yes"]) if total else (0, 0)
    if not no or not yes:
        return FactorizationMachine(np.zeros(0, np.int64), 30.0 if yes else -30.0, np.zeros(0), np.zeros((0, FACTORS)))

    def part(have: str, of: int) -> str:
        rest, all_n = f"({of}D - {have})", f"{no + yes}D"
        with_term, without = f"(yes + no) * {of}D / {all_n}", f"({all_n} - yes - no) * {of}D / {all_n}"
        return f"(CASE WHEN {have} > 0 THEN {have} * ln({have} / ({with_term})) ELSE 0D END" + (
            f" + CASE WHEN {rest} > 0 THEN {rest} * ln({rest} / ({without})) ELSE 0D END)"
        )

    ranked = materialize(
        counted.where("term >= 0").select(
            "term", F.expr(f"2 * ({part('yes', yes)} + {part('no', no)})").alias("g"),
            F.expr(f"least(yes + no, {no + yes} - yes - no)").alias("even"),
        ),
        "ranked",
    )
    even, best = (
        {r["term"]: max(r["g"], 0.0) for r in ranked.where(f"{by} > 0").orderBy(F.desc(by), "term").limit(n).collect()}
        for by, n in (("even", EVEN_TERMS), ("g", MAX_TERMS))
    )
    terms = list(dict.fromkeys([*list(best)[: MAX_TERMS - EVEN_TERMS], *even, *best]))[:MAX_TERMS]
    strength = np.array([even.get(t, best.get(t)) for t in terms])
    pace = strength / (strength + 2 * np.log(1 + ranked.count()))
    pair_pace = np.where(np.isin(terms, list(even)), np.maximum(pace, EVEN_PACE), pace)
    terms = np.array(terms, np.int64)

    def kept(column: pa.Array) -> dict[str, pa.Array]:
        row, number = _term_rows(column, _numbering(terms))
        at = np.searchsorted(row, np.arange(1, len(column)))
        return {"_terms": pa.array([x.astype(np.int16).tobytes() for x in np.split(number, at)], pa.binary())}

    fields = T.StructType([T.StructField("_terms", T.BinaryType())])
    rows = with_columns(sample, "_text", kept, fields).orderBy(F.xxhash64("_id"), "_id").limit(max_rows).toArrow()
    lists = [np.frombuffer(x.as_py(), np.int16) for x in rows["_terms"]]
    return _fit(terms, lists, (np.asarray(rows["_label"]) > 0).astype(float), pace, pair_pace)


def score(docs: DataFrame, model: FactorizationMachine, text: str = "text") -> DataFrame:
    """`docs` without its text, with `score` in 0..1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by MAX_TERMS

    def scored(column: pa.Array) -> dict[str, pa.Array]:
        machine = shared.value
        row, number = _term_rows(column, _numbering(machine.terms))
        margin = machine.margins(row, number, len(column))
        return {"score": pa.array(1 / (1 + np.exp(-np.clip(margin, -500, 500))), pa.float64())}

    return with_columns(docs, text, scored, T.StructType([T.StructField("score", T.DoubleType())]))


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(id_hash("doc_id", 5) != 0)
    scored = score(docs, fit(docs, labels)).withColumn("held_out", id_hash("doc_id", 5) == 0)
    return scored.select(
        "doc_id", "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )
