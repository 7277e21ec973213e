"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.session import materialize

MAX_ROUNDS = 60


def _joined_least(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with m, the least of u and its neighbours v."""
    least = materialize(edges.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "least")
    return edges.join(least, "u")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (two long columns u, v; loops are dropped), root being the least node of
    its component. Two steps take turns: every node links its larger neighbours to its least one, then its smaller
    ones. The edges never become more, every round is written, and the rounds grow with the logarithm of the longest
    path."""
    now = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _state(now)
    for _ in range(MAX_ROUNDS):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _joined_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large")
        least = _joined_least(large)
        small = least.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
        now = materialize(small.where("u <> v").distinct(), "edges")
        before, state = state, _state(now)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
