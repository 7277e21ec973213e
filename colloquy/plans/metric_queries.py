"""Metrics over the scored events, gates and model comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.operators import dataset, metrics
from colloquy.plans.dataset_queries import split_sql
from colloquy.plans.registry import query
from colloquy.session import materialize
from colloquy.sources.tables import EVENT_PREDICTIONS_SQL, event_predictions, table

_PRED = f"WITH {EVENT_PREDICTIONS_SQL}"
_ERR = "abs(prediction - label_score)"


def _rounded(df, *columns, digits=9):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("errors", f"{_PRED} SELECT count(*) AS n, round(avg({_ERR}), 9) AS mae, round(sqrt(avg({_ERR} * {_ERR})), 9) AS rmse FROM pred")
def errors(spark, sf):
    return _rounded(metrics.errors(event_predictions(spark, sf)), "mae", "rmse")


@query(
    "errors_by_persona",
    f"{_PRED} SELECT persona, count(*) AS n, round(avg({_ERR}), 9) AS mae, round(sqrt(avg({_ERR} * {_ERR})), 9) AS rmse FROM pred GROUP BY 1",
)
def errors_by_persona(spark, sf):
    return _rounded(metrics.errors(event_predictions(spark, sf), ("persona",)), "mae", "rmse")


@query(
    "persona_range",
    f"""{_PRED}, p AS (SELECT persona, avg({_ERR}) AS mae FROM pred GROUP BY 1)
    SELECT count(*) AS personas, round(min(mae), 9) AS min_mae, round(max(mae), 9) AS max_mae FROM p""",
)
def persona_range(spark, sf):
    return _rounded(metrics.persona_range(event_predictions(spark, sf)), "min_mae", "max_mae")


@query(
    "spearman",
    f"""{_PRED}, r AS (SELECT rank() OVER (ORDER BY label_score) + (count(*) OVER (PARTITION BY label_score) - 1) / 2 AS x,
      rank() OVER (ORDER BY prediction) + (count(*) OVER (PARTITION BY prediction) - 1) / 2 AS y FROM pred)
    SELECT round(corr(x, y), 6) AS spearman FROM r""",
)
def spearman(spark, sf):
    return _rounded(metrics.spearman(event_predictions(spark, sf)), "spearman", digits=6)


@query(
    "spearman_constant",
    "SELECT 0.0::DOUBLE AS spearman FROM events LIMIT 1",
)
def spearman_constant(spark, sf):
    return metrics.spearman(event_predictions(spark, sf).withColumn("prediction", F.lit(0.25)))


@query(
    "context_breakdown",
    f"""{_PRED} SELECT count(*) FILTER (WHERE context_size > 0) AS with_context_rows,
    round(avg({_ERR}) FILTER (WHERE context_size > 0), 9) AS with_context_mae,
    count(*) FILTER (WHERE context_size = 0) AS no_context_rows, round(avg({_ERR}) FILTER (WHERE context_size = 0), 9) AS no_context_mae FROM pred""",
)
def context_breakdown(spark, sf):
    return _rounded(metrics.context_breakdown(event_predictions(spark, sf)), "with_context_mae", "no_context_mae")


_GATE = f"""{_PRED}, {split_sql('pred', 'customer_id')}, placed AS (SELECT * FROM pred JOIN assigned USING (customer_id)),
mean AS (SELECT avg(label_score) AS m FROM placed WHERE split = 'train'),
g AS (SELECT avg({_ERR}) AS c, avg(abs(label_score - m)) AS b FROM placed, mean WHERE split = 'test')"""


def _splits(spark, sf):
    placed = materialize(dataset.grouped_split(event_predictions(spark, sf)), "split")
    return placed.filter("split = 'train'"), placed.filter("split = 'test'")


@query("mean_baseline", f"{_GATE} SELECT round(b, 9) AS mae FROM g")
def mean_baseline(spark, sf):
    train, test = _splits(spark, sf)
    return _rounded(metrics.errors(metrics.mean_baseline(train, test)).select("mae"), "mae")


@query(
    "quality_gate",
    f"{_GATE} SELECT round(c, 9) AS candidate_mae, round(b, 9) AS baseline_mae, round(0.9::DOUBLE * b, 9) AS required_max_mae, c <= 0.9::DOUBLE * b AS passed FROM g",
)
def quality_gate(spark, sf):
    train, test = _splits(spark, sf)
    gate = metrics.quality_gate(test, metrics.mean_baseline(train, test))
    return _rounded(gate, "candidate_mae", "baseline_mae", "required_max_mae")


@query(
    "latency_summary",
    """SELECT round(quantile_cont(value, 0.5), 9) AS p50, round(quantile_cont(value, 0.95), 9) AS p95, count(value) AS sample_size FROM events""",
)
def latency_summary(spark, sf):
    return _rounded(metrics.latency_summary(table(spark, sf, "events"), "value"), "p50", "p95")


def _model_metrics(spark, sf):
    return event_predictions(spark, sf).groupBy(
        F.col("persona").alias("dataset_id"), F.when(F.col("customer_id").cast("long") % 2 == 0, "tfidf-ridge").otherwise("embeddings-ft").alias("algorithm")
    ).agg(F.avg(F.abs(F.col("prediction") - F.col("label_score"))).alias("mae"))


@query(
    "compare_models",
    """SELECT event_type AS dataset_id, round(avg(e) FILTER (WHERE user_id % 2 = 1) - avg(e) FILTER (WHERE user_id % 2 = 0), 9) AS mae_delta
    FROM (SELECT *, abs((event_id % 5 - 2) / 4.0::DOUBLE + value / 40 - 0.5::DOUBLE - (event_id % 5 - 2) / 2.0::DOUBLE) AS e FROM events) GROUP BY 1""",
)
def compare_models(spark, sf):
    return _rounded(metrics.compare_models(_model_metrics(spark, sf), "embeddings-ft", "tfidf-ridge"), "mae_delta")


@query(
    "regressions",
    f"""{_PRED}, m AS (SELECT model_version, avg({_ERR}) AS mae FROM pred GROUP BY 1),
    a AS (SELECT mae AS active FROM m WHERE model_version = 'mood-2024.01.2')
    SELECT model_version, round(mae, 9) AS mae, model_version = 'mood-2024.01.2' AS already_active,
    model_version <> 'mood-2024.01.2' AND mae > active AS regression FROM m, a""",
)
def regressions(spark, sf):
    by_version = metrics.errors(event_predictions(spark, sf), ("model_version",))
    return _rounded(metrics.regressions(by_version, "mood-2024.01.2"), "mae")


@query("non_finite", "SELECT count(*) FILTER (WHERE event_id % 50 = 0) AS non_finite, count(*) AS n FROM events")
def non_finite(spark, sf):
    p = event_predictions(spark, sf)
    bad = F.when(F.col("example_id").cast("long") % 100 == 0, float("nan")).when(F.col("example_id").cast("long") % 100 == 50, float("inf"))
    return metrics.non_finite(p.withColumn("prediction", F.coalesce(bad, F.col("prediction"))))
