"""TF-IDF weights, the text regression, and sentence-vector features."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from colloquy.functions.text import with_prepared
from colloquy.operators import dataset, metrics
from colloquy.plans import features, regression, vectors
from colloquy.plans.dataset_queries import _examples
from colloquy.plans.dataset_queries import split_sql
from colloquy.plans.registry import query
from colloquy.plans.text_queries import _FEATURES, WS
from colloquy.session import materialize, shuffles_deleted, spread
from colloquy.sources.tables import labelled_documents, table

WORD_TERMS = """list_concat(toks, [toks[i] || ' ' || toks[i + 1] for i in range(1, len(toks))])"""
CHAR_TERMS = """flatten([flatten([[substr(w, i, n) for i in range(1, length(w) - n + 2)] for n in range(2, 6)]) for w in wds])"""


def _tfidf_sql(source: str, terms: str, prefix: str, scale: str = "1.0") -> str:
    """`source` gives (example_id, toks or wds)."""
    return f"""{prefix} tok AS ({source}),
gram AS (SELECT example_id, unnest({terms}) AS term FROM tok),
tf AS (SELECT example_id, term, count(*) AS tf FROM gram GROUP BY 1, 2),
n AS (SELECT count(*) AS n FROM tok),
idf AS (SELECT term, count(*) AS df, ln((1 + max(n.n)) / (1 + count(*))) + 1 AS idf FROM tf, n GROUP BY term),
w AS (SELECT example_id, term, tf * idf AS w FROM tf JOIN idf USING (term)),
norm AS (SELECT example_id, sqrt(sum(w * w)) AS s FROM w GROUP BY 1),
weighted AS (SELECT example_id, term, {scale}::DOUBLE * w / s AS weight FROM w JOIN norm USING (example_id))"""


_SUMMARY = """ SELECT example_id, count(*) AS terms, round(sum(weight), 6) AS total, round(max(weight), 6) AS heaviest,
  round(sum(weight * (length(term) + ascii(term) % 31)), 6) AS mix FROM weighted GROUP BY 1"""


def _summary(weights):
    return weights.groupBy("example_id").agg(
        F.count(F.lit(1)).alias("terms"),
        F.round(F.sum("weight"), 6).alias("total"),
        F.round(F.max("weight"), 6).alias("heaviest"),
        F.round(F.sum(F.col("weight") * (F.length("term") + F.ascii("term") % 31)), 6).alias("mix"),
    )


def _weights(examples, counts, scale=1.0):
    counts = materialize(counts, "term-counts")
    n = examples.agg(F.count(F.lit(1))).scalar()
    idf = materialize(features.inverse_frequencies(counts, n), "idf")
    return features.weigh(counts, idf, scale)


_DOC_TOKENS = "SELECT doc_id::VARCHAR AS example_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') AS toks FROM documents"


def _documents(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("example_id"), F.col("text").alias("text_clean"))
    return spread(docs)


@query("tfidf_words", _tfidf_sql(_DOC_TOKENS, WORD_TERMS, "WITH") + _SUMMARY)
def tfidf_words(spark, sf):
    docs = _documents(spark, sf)
    return _summary(features.word_weights(docs, "text_clean"))


@query(
    "word_frequencies",
    _tfidf_sql(_DOC_TOKENS, WORD_TERMS, "WITH") + " SELECT term, df, round(idf, 9) AS idf FROM idf",
)
def word_frequencies(spark, sf):
    docs = _documents(spark, sf)
    n = docs.agg(F.count(F.lit(1))).scalar()
    idf = features.word_inverse_frequencies(docs, "text_clean", n)
    return idf.select("term", "df", F.round("idf", 9).alias("idf"))


_PADDED = f"""SELECT message_id AS example_id, [' ' || w || ' ' for w in string_split_regex(lower(h[-1]), '{WS}+') if w <> ''] AS wds FROM framed"""


@query("tfidf_chars", _tfidf_sql(_PADDED, CHAR_TERMS, _FEATURES.rstrip() + ",") + _SUMMARY)
def tfidf_chars(spark, sf):
    rows = materialize(_examples(spark, sf).select("example_id", "text_clean"), "texts")
    return _summary(_weights(rows, features.char_counts(rows, "text_clean")))


_CONTEXT = """SELECT message_id AS example_id,
  regexp_extract_all(lower(coalesce(array_to_string(h[1:len(h) - 1], ' '), '')), '[\\p{L}\\p{N}_]{2,}') AS toks FROM framed"""


@query("tfidf_context", _tfidf_sql(_CONTEXT, WORD_TERMS, _FEATURES.rstrip() + ",", "0.5") + _SUMMARY)
def tfidf_context(spark, sf):
    rows = materialize(_examples(spark, sf).select("example_id", "context_clean"), "texts")
    return _summary(_weights(rows, features.context_counts(rows), 0.5))


@query(
    "ridge_one_feature",
    """WITH m AS (SELECT avg(value) AS mx, avg((event_id % 5 - 2) / 2.0::DOUBLE + value / 100) AS my FROM events),
    f AS (SELECT sum((value - mx) * ((event_id % 5 - 2) / 2.0::DOUBLE + value / 100 - my)) / (sum((value - mx) * (value - mx)) + 1000000.0) AS w FROM events, m)
    SELECT round(w, 6) AS coefficient, round(my - w * mx, 5) AS intercept FROM f, m""",
)
def ridge_one_feature(spark, sf):
    rows = table(spark, sf, "events").select(
        array_to_vector(F.array("value")).alias("features"),
        ((F.col("event_id") % 5 - 2) / 2.0 + F.col("value") / 100).alias("label_score"),
    )
    model = regression.ridge(rows, 1_000_000.0)
    fitted = spark.createDataFrame([(float(model.coefficients[0]), float(model.intercept))], "coefficient double, intercept double")
    return fitted.select(F.round("coefficient", 6).alias("coefficient"), F.round("intercept", 5).alias("intercept"))


def _document_examples(spark, sf):
    docs = with_prepared(labelled_documents(spark, sf), "text", "text_clean").drop("text")
    return docs.withColumn("context_clean", F.array("persona"))


@query(
    "text_regression",
    f"""WITH x AS (SELECT source AS customer_id, quality * 2.0::DOUBLE - 1 AS y FROM documents JOIN labels USING (doc_id)),
    {split_sql('x', 'customer_id')}, p AS (SELECT y, split FROM x JOIN assigned USING (customer_id)),
    g AS (SELECT count(*) FILTER (split = 'test') AS n, count(*) FILTER (split = 'validation') AS v,
      avg(abs(y - (SELECT avg(y) FROM p WHERE split = 'train'))) FILTER (split = 'test') AS b FROM p)
    SELECT n AS n_test, v AS n_validation, round(b, 9) AS baseline_mae, round(0.9::DOUBLE * b, 9) AS required_max_mae,
      true AS passed, true AS passed_validation, true AS settled, 0::BIGINT AS non_finite FROM g""",
)
def text_regression(spark, sf):
    """Fit on the training split, measured on the other two: whether the error passes the gate on each, and whether the
    gradient of the objective vanishes."""
    with shuffles_deleted(spark):
        placed = materialize(dataset.grouped_split(_document_examples(spark, sf)), "documents", close=True)
    train, check, test = (placed.filter(F.col("split") == s) for s in ("train", "validation", "test"))
    model = regression.fit(train)
    predicted = materialize(
        model.predict(placed.filter("split <> 'train'")).select("split", "label_score", "prediction"), "predictions"
    )
    on_test, on_check = (predicted.filter(F.col("split") == s) for s in ("test", "validation"))
    gate = metrics.quality_gate(on_test, metrics.mean_baseline(train, test))
    other = metrics.quality_gate(on_check, metrics.mean_baseline(train, check))
    return gate.select(
        on_test.agg(F.count(F.lit(1))).scalar().alias("n_test"),
        on_check.agg(F.count(F.lit(1))).scalar().alias("n_validation"),
        F.round("baseline_mae", 9).alias("baseline_mae"),
        F.round("required_max_mae", 9).alias("required_max_mae"),
        "passed",
        other.select("passed").scalar().alias("passed_validation"),
        F.lit(model.model.gradient <= 1e-6).alias("settled"),
        metrics.non_finite(predicted).select("non_finite").scalar().alias("non_finite"),
    )


@query(
    "score_documents",
    """SELECT doc_id::VARCHAR AS example_id, CASE WHEN quality IS NOT NULL THEN true END AS on_the_right_side,
    true AS in_range, '-1 to 1' AS scale, 'mood-2024.02.0' AS model_version, 1706745600 AS computed_s
    FROM documents LEFT JOIN labels USING (doc_id)""",
)
def score_documents(spark, sf):
    """Score records of all documents from a model fitted on the labelled ones. `on_the_right_side` says whether the
    score of a labelled one has the sign of its label."""
    with shuffles_deleted(spark):
        train = materialize(_document_examples(spark, sf), "documents", close=True)
    model = regression.fit(train)
    every = with_prepared(spread(table(spark, sf, "documents")), "text", "text_clean").select(
        F.col("doc_id").cast("string").alias("example_id"), "text_clean", F.array("lang").alias("context_clean")
    )
    at = F.lit("2024-02-01 00:00:00").cast("timestamp")
    scored = regression.score_records(model.predict(every), "mood-2024.02.0", at)
    labels = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("example_id"), "quality")
    return scored.join(labels, "example_id", "left").select(
        "example_id",
        (F.when(F.col("quality").isNotNull(), F.col("score") * (2 * F.col("quality") - 1) > 0)).alias("on_the_right_side"),
        F.col("score").between(-1, 1).alias("in_range"), "scale", "model_version",
        F.unix_timestamp("computed_at").cast("int").alias("computed_s"),
    )


@query(
    "mean_pooling",
    """WITH f AS (SELECT label, vec_id % 3 AS m, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS d FROM embeddings)
    SELECT label, d::INT AS dim, round(sum(CASE WHEN m <> 0 THEN v::DOUBLE ELSE 0 END) / greatest(sum((m <> 0)::INT), 1e-9), 6) + 0.0 AS mean
    FROM f GROUP BY 1, 2""",
)
def mean_pooling(spark, sf):
    rows = table(spark, sf, "embeddings").withColumn("mask", (F.col("vec_id") % 3 != 0).cast("int"))
    pooled = vectors.mean_vector(rows, ["label"], "embedding", F.col("mask"))
    return pooled.select("label", F.posexplode("mean").alias("dim", "mean")).select(
        "label", (F.col("dim") + 1).alias("dim"), F.round("mean", 6).alias("mean")
    )


def _with_context(spark, sf):
    rows = table(spark, sf, "embeddings").select(
        "vec_id", F.floor(F.col("vec_id") / 10).alias("conversation"), "embedding", "label"
    )
    dim = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    return vectors.context_means(rows, "conversation", ["vec_id"], "embedding", dim), dim


_CONTEXT_SQL = """WITH e AS (SELECT vec_id, vec_id // 10 AS conversation, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS d FROM embeddings),
c AS (SELECT vec_id, d, v, coalesce(avg(v) OVER (PARTITION BY conversation, d ORDER BY vec_id ROWS BETWEEN 29 PRECEDING AND 1 PRECEDING), 0) AS ctx FROM e)"""


@query("context_vectors", _CONTEXT_SQL + " SELECT vec_id, d::INT AS dim, round(ctx, 6) + 0.0 AS context FROM c")
def context_vectors(spark, sf):
    rows, _ = _with_context(spark, sf)
    return rows.select("vec_id", F.posexplode("context").alias("dim", "context")).select(
        "vec_id", (F.col("dim") + 1).alias("dim"), F.round("context", 6).alias("context")
    )


def _vector_features(spark, sf):
    rows, dim = _with_context(spark, sf)
    joined = vectors.concat_weighted(F.col("embedding"), F.col("context"), 0.5)
    return rows.select("vec_id", "label", joined.alias("features")), dim


@query(
    "linear_head",
    _CONTEXT_SQL
    + """ SELECT vec_id, round(sum(v * ((d - 1) % 7 - 3) / 10.0 + 0.5 * ctx * ((d - 1 + (SELECT max(d) FROM c)) % 7 - 3) / 10.0) + 0.25, 5) + 0.0 AS score
    FROM c GROUP BY 1""",
)
def linear_head(spark, sf):
    rows, dim = _vector_features(spark, sf)
    head = [(i % 7 - 3) / 10.0 for i in range(2 * dim)]
    return rows.select("vec_id", F.round(vectors.linear_score(F.col("features"), head, 0.25), 5).alias("score"))


@query(
    "linear_probe",
    """SELECT count(*) AS n, true AS optimal FROM embeddings
    WHERE ('0x' || substr(md5(vec_id::VARCHAR || '-42'), 1, 8))::BIGINT % 10000 BETWEEN 7000 AND 8499""",
)
def linear_probe(spark, sf):
    """Ridge on frozen vectors: the vectors held out that it scores, and whether
    the gradient of its objective vanishes at the solution."""
    rows, _ = _vector_features(spark, sf)
    labelled = rows.withColumn("label_score", F.col("label") % 5 / 2.0 - 1.0)
    split = dataset.hash_split(F.col("vec_id").cast("string"))
    placed = materialize(labelled.withColumn("split", split), "vectors")
    train = placed.filter("split = 'train'")
    model = vectors.linear_probe(train)
    held = placed.filter("split = 'validation'").withColumn("features", array_to_vector("features"))
    # d/dw of squared errors + alpha * w^2, per column: sum of error * x, plus w
    fitted = model.transform(train.withColumn("features", array_to_vector("features")))
    error = (F.col("prediction") - F.col("label_score")).alias("e")
    parts = fitted.select(error, F.posexplode(vector_to_array("features")).alias("d", "x"))
    weights = F.array(*[F.lit(float(c)) for c in model.coefficients])
    slope = parts.groupBy("d").agg(F.sum(F.col("e") * F.col("x")).alias("g")).select(
        F.abs(F.col("g") + F.get(weights, F.col("d"))).alias("g")
    )
    steepest = slope.agg(F.max("g")).scalar()
    scored = metrics.errors(model.transform(held).select("label_score", "prediction"))
    return scored.select("n", (steepest < 1e-6).alias("optimal"))
