"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted into cells (source, language, topic) with their tokens. Sweeps over the dimensions scale the
weights of the cells so that the marginal of each dimension meets its target in turn, until all marginals agree within
TOLERANCE; cells, marginals and targets stay tables throughout. The raked weight of a cell over its tokens is the rate of
its documents; the largest rate is set to one, and a document is drawn when a hash of its id and text falls below its
rate, so a draw does not depend on order or partitions and the expected tokens have the target marginals.

The topic of a text is a coarse class found by fixed patterns. Targets are tables of (value, weight) per dimension; by
default each marginal is the corpus marginal raised to TEMPERATURES and scaled to one.

Defined cases: a null or empty text has no tokens and weighs as one token, so it can be drawn; null values of a
dimension are a value of their own; targets are scaled to one over the values that occur, and a value without a target
gets weight zero; a row repeated with the same id and text gets the same draw; an empty table gives an empty result;
other columns pass through, and columns named as the results are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm.registry import query, table
from colloquy.session import materialize

DIMENSIONS = ("source", "lang", "topic")
TEMPERATURES = {"source": 0.8, "lang": 0.9, "topic": 1.0}
TOLERANCE = 1e-6
MAX_SWEEPS = 60
SEED = 20
_OWN = "__mix_"  # of columns that a join drops again

# Topic patterns, the first that is found decides.
TOPICS = (
    ("legal", r"(?i)licen[cs]e|copyright|rights reserved"),
    ("markup", r" [|] [^\n]* [|] |[*$%&#]{3}"),
    ("contact", r"@|\+[0-9]|https?://"),
)


def topic_of(text: str = "text") -> Column:
    out = F.lit("prose")
    for name, pattern in reversed(TOPICS):
        out = F.when(F.col(text).rlike(pattern), F.lit(name)).otherwise(out)
    return out


def token_count(text: str = "text") -> Column:
    """White-space separated words."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def count_cells(measured: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """Tokens per cell; see `mix` for the columns."""
    return measured.groupBy(*dimensions).agg(F.sum(F.greatest("n_tokens", F.lit(1))).cast("double").alias("tokens"))


def tempered(cells: DataFrame, dimension: str, temperature: float) -> DataFrame:
    """Default target: the corpus marginal raised to `temperature`."""
    marginal = cells.groupBy(F.col(dimension).alias("value")).agg(F.sum("tokens").alias("n"))
    return marginal.select("value", F.pow("n", F.lit(temperature)).alias("weight"))


def _scaled(cells: DataFrame, dimension: str, target: DataFrame) -> DataFrame:
    """Targets of the values that occur, as shares of one."""
    values = cells.select(F.col(dimension).alias("v")).distinct()
    wanted = target.groupBy(F.col("value").alias("_value")).agg(F.sum("weight").alias("_w"))
    here = materialize(
        values.join(wanted, values["v"].eqNullSafe(wanted["_value"]), "left")
        .select("v", F.coalesce("_w", F.lit(0.0)).cast("double").alias("w")),
        "targets",
    )
    total = here.agg(F.sum("w")).first()[0] or 1.0
    return here.select("v", (F.col("w") / F.lit(total)).alias("share"))


def rake(
    cells: DataFrame, targets: dict[str, DataFrame], tolerance: float = TOLERANCE, max_sweeps: int = MAX_SWEEPS
) -> DataFrame:
    """`cells` with `weight`, whose marginals are those of `targets`, and `marginal_error`: the largest share by which the
    last sweep still had to change a marginal. It is above `tolerance` only where `max_sweeps` sweeps do not do, as for
    targets that no weights of the cells can have."""
    wanted = {d: _scaled(cells, d, t) for d, t in targets.items()}
    total = cells.agg(F.sum("tokens")).first()[0] or 1.0
    now = cells.withColumn("weight", F.col("tokens") / F.lit(total))
    worst = 0.0
    for _ in range(max_sweeps):
        errors = []
        for d, target in wanted.items():
            sums = now.groupBy(F.col(d).alias("_v")).agg(F.sum("weight").alias("_sum"))
            scale = sums.join(target, sums["_v"].eqNullSafe(target["v"])).select(
                "_v", F.when(F.col("_sum") > 0, F.col("share") / F.col("_sum")).otherwise(0.0).alias("_scale")
            )
            now = now.join(scale, now[d].eqNullSafe(scale["_v"])).withColumn("weight", F.col("weight") * F.col("_scale"))
            errors.append(F.when(F.col("_scale") > 0, F.abs(F.col("_scale") - 1)).otherwise(0.0).alias(f"_e_{d}"))
            now = now.select(*cells.columns, "weight", *(c for c in now.columns if c.startswith("_e_")), errors[-1])
        swept = materialize(now, "rake")
        worst = swept.agg(F.max(reduce(F.greatest, [F.col(f"_e_{d}") for d in wanted]) if len(wanted) > 1 else F.col(f"_e_{next(iter(wanted))}"))).first()[0]
        now = swept.select(*cells.columns, "weight")
        if (worst or 0.0) <= tolerance:
            break
    return now.withColumn("marginal_error", F.lit(float(worst or 0.0)))


def mix(
    docs: DataFrame, targets: dict[str, DataFrame] | None = None, text: str = "text", id_col: str = "doc_id",
    temperatures: dict[str, float] = TEMPERATURES, seed: int = SEED,
) -> DataFrame:
    """`docs` with topic, n_tokens, `probability`, `drawn` and `marginal_error` (see `rake`; the same in all rows)."""
    made = ("topic", "n_tokens", "probability", "drawn", "marginal_error")
    measured = docs.drop(*made).withColumns({"topic": topic_of(text), "n_tokens": token_count(text)})
    cells = materialize(count_cells(measured), "cells")
    if targets is None:
        targets = {d: tempered(cells, d, temperatures[d]) for d in DIMENSIONS}
    rated = materialize(
        rake(cells, targets).select(
            *DIMENSIONS, (F.col("weight") / F.col("tokens")).alias("rate"), "marginal_error"
        ),
        "rates",
    )
    top = rated.agg(F.max("rate")).first()[0] or 1.0
    chance = rated.select(
        *(F.col(d).alias(f"{_OWN}{d}") for d in DIMENSIONS), (F.col("rate") / F.lit(top)).alias("probability"),
        "marginal_error",
    )
    same = reduce(lambda a, b: a & b, [measured[d].eqNullSafe(chance[f"{_OWN}{d}"]) for d in DIMENSIONS])
    joined = measured.join(chance, same, "left").drop(*(f"{_OWN}{d}" for d in DIMENSIONS))
    point = F.pmod(F.xxhash64(F.col(id_col), F.col(text), F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    return joined.withColumn("drawn", point < F.col("probability"))


def mix_sample(docs: DataFrame, targets: dict[str, DataFrame] | None = None, text: str = "text") -> DataFrame:
    """The drawn rows of `docs` with their columns, topic, n_tokens and probability."""
    return mix(docs, targets, text).where("drawn").drop("drawn", "marginal_error")


@query("op6_mixing")
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mix(docs).select("doc_id", "source", "lang", "topic", "n_tokens", "probability", "drawn", "marginal_error")
