"""TF-IDF, ridge and vector plans against numpy closed forms."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy import session
from colloquy.operators import metrics
from colloquy.plans import features, regression, sparse_ridge, termhash, vectors
from colloquy.session import materialize

TEXTS = ["the cat sat", "the dog sat on the mat", "a cat and a dog", "the the the", "mat mat cat", "only once here"]


@pytest.mark.parametrize("limit", [2, 10_000])
def test_tfidf_equals_closed_form(spark, limit):
    df = spark.createDataFrame([(str(i), s) for i, s in enumerate(TEXTS)], "example_id string, text string")
    counts = features.word_counts(df, "text")
    idf = features.inverse_frequencies(counts, F.lit(len(TEXTS)))
    got = {(r.example_id, r.term): r.weight for r in features.weigh(counts, idf, 0.5, limit).collect()}
    grams = []
    for s in TEXTS:
        tokens = [w for w in s.split() if len(w) > 1]
        grams.append(Counter(tokens + [" ".join(p) for p in zip(tokens, tokens[1:])]))
    df_of = Counter(t for g in grams for t in g)
    want = {}
    for i, g in enumerate(grams):
        raw = {t: n * (math.log((1 + len(TEXTS)) / (1 + df_of[t])) + 1) for t, n in g.items()}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        want.update({(str(i), t): 0.5 * v / norm for t, v in raw.items()})
    assert got.keys() == want.keys()
    for key in want:
        assert got[key] == pytest.approx(want[key], abs=1e-12)


@pytest.mark.parametrize("tokens", [1, 4, 1 << 20])
def test_terms_of_repeated_and_null_keys(spark, tokens, monkeypatch):
    """Rows of one key count together, terms do not reach over rows, and nothing is shuffled by occurrence."""
    monkeypatch.setattr(features, "TOKENS", tokens)
    rows = [("a", "aa bb aa bb cc"), ("a", "bb cc"), (None, "aa aa"), (None, "aa bb"), ("b", None), ("c", ""), ("d", "cc bb aa"), ("e", "zz")]
    want, df = Counter(), Counter()
    for key, s in rows:
        w = (s or "").split()
        want.update((key, " ".join(w[i : i + n])) for n in (1, 2, 3) for i in range(len(w) - n + 1))
    df.update(term for _, term in want)
    for part in (rows, rows[3:]):
        texts = spark.createDataFrame(part, "example_id string, text string").coalesce(2)
        counts = features.word_counts(texts, "text", 1, 3)
        idf = features.word_inverse_frequencies(texts, "text", F.lit(len(part)), 1, 3)
        plain = {r.term: (r.df, r.idf) for r in features.inverse_frequencies(counts, F.lit(len(part))).collect()}
        assert {r.term: (r.df, r.idf) for r in idf.collect()} == plain
        assert "Generate" not in counts._jdf.queryExecution().toString()
        if part is rows:
            assert {(r.example_id, r.term): r.tf for r in counts.collect()} == want
            assert {t: n for t, (n, _) in plain.items()} == df
    no_text = features.word_counts(texts.filter("example_id = 'c'"), "text")
    assert no_text.count() == 0 and features.weigh(no_text, features.inverse_frequencies(no_text, F.lit(1))).count() == 0


def _closed_ridge(x, y, alpha):
    xm, ym = x.mean(0), y.mean()
    w = np.linalg.solve((x - xm).T @ (x - xm) + alpha * np.eye(x.shape[1]), (x - xm).T @ (y - ym))
    return w, ym - xm @ w


@pytest.mark.parametrize("solver", ["normal", "l-bfgs"])
def test_ridge_equals_closed_form(spark, solver):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 6)) * [1, 5, 0.2, 1, 1, 3]
    y = x @ rng.normal(size=6) + 2 + rng.normal(size=120)
    df = spark.createDataFrame([(r.tolist(), float(v)) for r, v in zip(x, y)], "f array<double>, label_score double")
    model = regression.ridge(df.withColumn("features", array_to_vector("f")), 3.0, solver=solver, tol=1e-12, max_iter=500)
    w, b = _closed_ridge(x, y, 3.0)
    assert np.allclose(model.coefficients.toArray(), w, atol=1e-5)
    assert model.intercept == pytest.approx(b, abs=1e-5)


def test_blocks_equal_term_weights(spark):
    """The hashed blocks hold the same weights as the exact term rows."""
    rows = [(str(i), s, [TEXTS[i - 1]] if i else [], float(i)) for i, s in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "example_id string, text_clean string, context_clean array<string>, label_score double")
    width = 1 << 14
    counts = materialize(sparse_ridge.pack(regression._hashed(df, width), regression.COUNTS, width), "counts")
    blocks, _ = regression.weighted_blocks(counts, width)
    exact_counts = features.word_counts(df, "text_clean")
    exact = features.weigh(exact_counts, features.inverse_frequencies(exact_counts, F.lit(len(TEXTS))))
    want = {}
    for r in exact.collect():
        want.setdefault(r.example_id, []).append(r.weight)
    rows = {}
    for b in blocks.collect():
        block = sparse_ridge._Block(*(np.frombuffer(b[c], k) for c, k in
                                      (("first", np.int64), ("column", np.int32), ("value", float), ("label", float))))
        for i, label in enumerate(block.label):
            dense = np.zeros(3 * width)
            own = slice(block.first[i], block.first[i + 1])
            dense[block.column[own]] = block.value[own]
            rows[str(int(label))] = dense
    assert rows.keys() == want.keys()
    for key, vector in rows.items():
        word = vector[:width]
        assert np.allclose(sorted(word[word > 0]), sorted(want[key]), atol=1e-12)
        assert np.linalg.norm(vector[width : 2 * width]) == pytest.approx(1.0)
        assert np.linalg.norm(vector[2 * width :]) == pytest.approx(0.5 if key != "0" else 0.0)


def _examples(spark, signal, seed):
    rng = random.Random(seed)
    phrases = {-1.0: "terrible awful broken", -0.5: "slow annoying late", 0.0: "question about order",
               0.5: "good helpful thanks", 1.0: "excellent wonderful perfect"}
    filler = "alpha beta gamma delta epsilon zeta eta theta".split()
    rows = []
    for i in range(150):
        level = rng.choice(list(phrases))
        words = rng.choices(filler, k=4)
        text = " ".join([phrases[level], *words] if signal else words)
        rows.append((text, [" ".join(rng.choices(filler, k=3))] if i % 2 else [], level))
    return spark.createDataFrame(rows, "text_clean string, context_clean array<string>, label_score double")


@pytest.mark.parametrize("signal", [True, False])
def test_gate_tells_signal_from_noise(spark, signal):
    train, test = _examples(spark, signal, 1), _examples(spark, signal, 2)
    model = regression.fit(train, width=1 << 10)
    predicted = model.predict(test)
    assert metrics.non_finite(predicted).first().non_finite == 0
    gate = metrics.quality_gate(predicted, metrics.mean_baseline(train, test)).first()
    assert gate.passed is signal
    record = regression.score_records(predicted, "mood-2024.01.0", F.lit("2024-01-01").cast("timestamp")).first()
    assert -1 <= record.score <= 1 and record.scale == "-1 to 1"


@pytest.mark.parametrize("limit", [4, 10_000])
def test_vectors_equal_numpy(spark, limit):
    rng = np.random.default_rng(5)
    rows = [(i, "hot" if i % 2 else f"k{i % 5}", rng.normal(size=3).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, k string, e array<double>")
    got = {r.id: r.context for r in vectors.context_means(df, "k", ["id"], "e", 3, split_rows=limit).collect()}
    for i, k, _ in rows:
        earlier = [e for j, kk, e in rows if kk == k and j < i][-29:]
        assert np.allclose(got[i], np.mean(earlier, axis=0) if earlier else [0, 0, 0])
    pooled = {r.k: r["mean"] for r in vectors.mean_vector(df, ["k"], "e", (F.col("id") % 4 != 0).cast("int")).collect()}
    for key in {r[1] for r in rows}:
        chosen = [e for i, k, e in rows if k == key and i % 4]
        assert np.allclose(pooled[key], np.mean(chosen, axis=0) if chosen else [0, 0, 0])
    head, b = [0.5, -1.0, 2.0], 0.25
    scored = df.select("id", vectors.linear_score(F.col("e"), head, b).alias("s"))
    for r in scored.collect():
        assert r.s == pytest.approx(np.dot(rows[r.id][2], head) + b)


def test_first_version_of_a_month(spark):
    versions = spark.createDataFrame([("mood-2024.01.3",), ("mood-2024.01.1",)], "model_version string")
    months = spark.createDataFrame([(2024, 1), (2024, 2)], "year int, month int")
    got = {r.month: r.next_version for r in metrics.next_version(versions, months=months).collect()}
    assert got == {1: "mood-2024.01.4", 2: "mood-2024.02.0"}


def test_fit_that_does_not_settle_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(sparse_ridge, "SAMPLE_ROWS", 2)
    with pytest.raises(sparse_ridge.NotSettled):
        regression.fit(_examples(spark, True, 1), width=1 << 10, max_passes=3)


@pytest.mark.parametrize("parts", [1, 40])
def test_sparse_ridge_equals_closed_form(spark, parts, monkeypatch):
    """Sparse, dense and empty rows, in one part and in more than are added up at once."""
    monkeypatch.setattr(sparse_ridge, "BLOCK_VALUES", 50)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 30)) * (rng.random((200, 30)) < 0.3) * rng.choice([0.1, 1, 8], 30)
    x[3] = 0
    y = x @ rng.normal(size=30) + 1.5 + rng.normal(size=200)
    rows = [
        (i, Vectors.dense(r) if i % 5 == 0 else Vectors.sparse(30, [(int(k), float(r[k])) for k in np.flatnonzero(r)]), float(v))
        for i, (r, v) in enumerate(zip(x, y))
    ] + [(200, None, 1.0), (201, Vectors.dense(x[0]), None)]
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("features", VectorUDT()),
                           T.StructField("label_score", T.DoubleType())])
    df = spark.createDataFrame(rows, schema).repartition(parts)
    blocks = materialize(sparse_ridge.pack(df, ["features"], 30), "blocks")
    model = sparse_ridge.solve(blocks, 30, 2.0, tol=1e-10)
    w, b = _closed_ridge(x, y, 2.0)
    assert np.allclose(model.coefficients, w, atol=1e-8) and model.intercept == pytest.approx(b, abs=1e-8)
    assert model.gradient <= 1e-10
    got = {r.id: r.prediction for r in sparse_ridge.predict(df, model, ["features"], 30).collect()}
    assert got[200] is None and np.allclose([got[i] for i in range(200)], x @ w + b)
    monkeypatch.setattr(sparse_ridge, "SAMPLE_ROWS", 20)
    assert np.allclose(sparse_ridge.solve(blocks, 30, 2.0, tol=1e-10).coefficients, w, atol=1e-8)
    none = sparse_ridge.solve(materialize(sparse_ridge.pack(df.filter("id < 0"), ["features"], 30), "none"), 30)
    assert not none.coefficients.any() and none.intercept == 0


def test_blocks_of_a_fit_lie_in_small_row_groups(spark, monkeypatch, tmp_path):
    """A task holds a row group, so blocks of megabytes may not gather in one: here each block is over the size."""
    monkeypatch.setattr(session, "LARGE_ROWS_GROUP", 1)
    monkeypatch.setattr(sparse_ridge, "BLOCK_VALUES", 300)
    monkeypatch.setattr(session, "shared_dir", lambda _: str(tmp_path))
    regression.fit(_examples(spark, True, 1), width=1 << 8, tol=1e-2)
    for name in ("term-counts", "train-rows"):
        files = [pq.ParquetFile(f).metadata for f in tmp_path.glob(f"{name}-*/*.parquet")]
        assert sum(f.num_rows for f in files) > len(files)
        assert all(f.num_row_groups == f.num_rows for f in files)
    plain = regression.materialize(spark.range(10).coalesce(1), "plain")
    assert [pq.ParquetFile(f).metadata.num_row_groups for f in tmp_path.glob("plain-*/*.parquet")] == [1]
    assert plain.count() == 10


def test_packing_hashes_terms_once(spark):
    """No filter on the hashed vectors goes below the rebalancing of the rows, where it would make them once more."""
    rows = _examples(spark, True, 1).hint("rebalance")
    packed = sparse_ridge.pack(regression._hashed(rows, 64), regression.COUNTS, 64)
    plan = packed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("UDF(") == 3 and packed.count() > 0


def _cells(blocks):
    """Of each label the columns and values, whatever the form of the blocks."""
    out = {}
    for b in sparse_ridge._blocks(iter(blocks.toArrow().to_batches())):
        first, value = b.row_values(), b.weights()
        for i, label in enumerate(b.label):
            own = slice(first[i], first[i + 1])
            out[int(label)] = dict(zip(b.column[own].tolist(), value[own].tolist()))
    return out


@pytest.mark.parametrize("piece", [1, 30, 1 << 20])
@pytest.mark.parametrize("width", [100, 1 << 12])
def test_hashed_stretches_equal_hashed_terms(spark, piece, width, monkeypatch):
    """No term is made, but slots and counts are those of the term arrays, also of a text that is cut."""
    monkeypatch.setattr(termhash, "PIECE", piece)
    rng = random.Random(7)
    letters = "abcdé ü漢😀 _1.\t\u2003İΣ"
    texts = ["".join(rng.choices(letters, k=rng.randrange(80))) for _ in range(60)] + ["", " ", None, "x" * 300, "the end " * 40]
    rows = [(s, [texts[i - 1] or "", "more"] if i % 3 else None, float(i)) for i, s in enumerate(texts)]
    df = spark.createDataFrame(rows, "text_clean string, context_clean array<string>, label_score double").coalesce(2)
    known = df.filter("text_clean IS NOT NULL")  # HashingTF takes no null
    want = _cells(sparse_ridge.pack(regression._hashed(known, width), regression.COUNTS, width))
    packed = sparse_ridge.pack(regression._with_texts(df), regression.TEXTS, width, read=termhash.hashed)
    assert _cells(packed) == want and len(want) == len(texts) - 1
    assert "UDF(" not in packed._jdf.queryExecution().optimizedPlan().toString()


def test_blocks_of_a_fit_are_small(spark):
    """Counts take a byte; with the factors of their rows' blocks and the idf they are the weights, which take eight."""
    df = _examples(spark, True, 1).withColumn("label_score", F.monotonically_increasing_id().cast("double"))
    packed = sparse_ridge.pack(regression._with_texts(df), regression.TEXTS, 256, read=termhash.hashed)
    counts = materialize(packed, "counts", large_rows=True, close=True)
    scaled, idf = regression.scaled_blocks(counts, 256)
    plain, same = regression.weighted_blocks(counts, 256)
    assert np.array_equal(idf, same)
    got = _cells(scaled)
    for b in plain.collect():
        first, column, value, label = (np.frombuffer(b[c], k) for c, k in
                                       (("first", np.int64), ("column", np.int32), ("value", float), ("label", float)))
        for i, name in enumerate(label):
            cells = got[int(name)]
            own = slice(first[i], first[i + 1])
            assert list(cells) == column[own].tolist()
            assert np.allclose([w * idf[c] for c, w in cells.items()], value[own], atol=1e-12)
    for b in scaled.collect():
        assert len(b.value) == len(b.steps) // 4


def test_few_columns_need_few_passes(spark):
    """Many short rows in few columns that go together: a sample of 512 rows left more than a hundred passes."""
    rng = np.random.default_rng(3)
    common = rng.normal(size=(40, 300)) * np.geomspace(8, 0.01, 300)
    rows = [(array.tolist(), float(y)) for array, y in zip(np.abs(rng.normal(size=(4000, 40)) @ common), rng.normal(size=4000))]
    df = spark.createDataFrame(rows, "f array<double>, label_score double").withColumn("features", array_to_vector("f"))
    blocks = materialize(sparse_ridge.pack(df, ["features"], 300), "blocks")
    model = sparse_ridge.solve(blocks, 300, 1e-3, 1e-6)
    assert model.gradient <= 1e-6 and model.passes <= 12


@pytest.mark.parametrize("tokens", [3, 1 << 20])
@pytest.mark.parametrize("repeated", [False, True])
def test_word_weights_equal_joined_weights(spark, tokens, repeated, monkeypatch):
    """Rows weighed where they are, in pieces whose terms are added up in buckets: the same rows as by joins. No row of a
    term is shuffled unless keys repeat."""
    monkeypatch.setattr(features, "TOKENS", tokens)
    monkeypatch.setattr(features, "BUCKET_TERMS", 5)
    rows = [(i, s) for i, s in enumerate(TEXTS)] + [(90, None), (91, ""), (92, "é漢 é漢 naïve")]
    rows += [(1, "the dog again"), (None, "cat cat sat")] * repeated
    df = spark.createDataFrame(rows, "example_id long, text string").repartition(3)
    got = features.word_weights(df, "text", 0.5)
    counts = features.word_counts(df, "text")
    want = features.weigh(counts, features.inverse_frequencies(counts, F.lit(len(rows))), 0.5)
    key = lambda r: (r.example_id is None, r.example_id, r.term)
    mine, other = sorted(got.collect(), key=key), sorted(want.collect(), key=key)
    assert [key(r) for r in mine] == [key(r) for r in other] and got.schema == want.schema
    assert np.allclose([r.weight for r in mine], [r.weight for r in other], atol=1e-12)
    assert ("Window" in got._jdf.queryExecution().toString()) is repeated
    assert features.word_weights(df.filter("example_id > 89 AND example_id < 92"), "text").count() == 0
