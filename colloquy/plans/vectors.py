"""Sentence-vector features: pooling, context means, and a linear head. Vectors
are array<float> or array<double> columns of one fixed length."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.text import MAX_HISTORY
from colloquy.operators.skew import over_trailing
from colloquy.plans.regression import ridge
from colloquy.session import materialize


def mean_vector(vectors: DataFrame, keys: list[str], vector: str, weight: Column | None = None) -> DataFrame:
    """(keys, mean): weighted mean per dimension, added up map-side. A key
    without weight has a zero vector.

    Rows per key may be any number: only (key, dimension) sums are shuffled."""
    w = weight.cast("double") if weight is not None else F.lit(1.0)
    flat = vectors.select(*keys, w.alias("_w"), F.posexplode(F.col(vector)).alias("_dim", "_v"))
    sums = flat.groupBy(*keys, "_dim").agg(
        F.sum(F.col("_w") * F.col("_v")).alias("_s"), F.sum("_w").alias("_n")
    )
    value = F.col("_s") / F.greatest(F.col("_n"), F.lit(1e-9))
    return (
        sums.groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("_dim", value.alias("_m")))).alias("_dims"))
        .select(*keys, F.col("_dims._m").alias("mean"))
    )


def context_means(
    rows: DataFrame, key: str, order: list[str], vector: str, dim: int, size: int = MAX_HISTORY,
    split_rows: int | None = None,
) -> DataFrame:
    """`context`: mean vector of the up to `size - 1` rows before each row of the
    same key, zeros if there is none. Each dimension is a number averaged over a
    sliding frame; no vectors are gathered."""
    means = {f"_m{i}": F.avg(F.get(F.col(vector), F.lit(i)).cast("double")) for i in range(dim)}
    framed = over_trailing(rows, [key], order, size, means, -1, split_rows)
    context = F.array(*(F.coalesce(name, F.lit(0.0)) for name in means)) if dim else F.array().cast("array<double>")
    return framed.withColumn("context", context).drop(*means)


def concat_weighted(text: Column, context: Column, weight: float) -> Column:
    """`[text ; weight * context]`."""
    return F.concat(
        F.transform(text, lambda x: x.cast("double")), F.transform(context, lambda x: x * F.lit(weight))
    )


def linear_score(features: Column, coefficients: list[float], intercept: float) -> Column:
    """Dot product with a fixed head of the vector's length, plus intercept."""
    head = F.array(*[F.lit(float(c)) for c in coefficients])
    return F.aggregate(
        F.zip_with(features, head, lambda x, c: x * c), F.lit(0.0), lambda acc, p: acc + p
    ) + F.lit(float(intercept))


def linear_probe(train: DataFrame, features: str = "features", label: str = "label_score",
                 alpha: float = 1.0) -> LinearRegressionModel:
    """Ridge on frozen vectors."""
    data = train.select(array_to_vector(F.transform(F.col(features), lambda x: x.cast("double"))).alias("features"),
                        F.col(label).alias("label_score"))
    return ridge(materialize(data, "probe-vectors"), alpha)
