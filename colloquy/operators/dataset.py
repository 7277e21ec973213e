"""Examples from messages and labels, and their split by customer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.text import MAX_HISTORY, split_history, with_prepared
from colloquy.operators.skew import lookup_join, trailing, with_position
from colloquy.session import materialize

SPLITS = ("train", "validation", "test")


def customer_messages(messages: DataFrame) -> DataFrame:
    return messages.filter(F.col("role") == "customer")


def history_windows(
    messages: DataFrame, value: Column, out: str = "history", rows: int | None = None
) -> DataFrame:
    """The last 30 customer messages of the conversation up to and including
    each customer message, by `sent_at`."""
    return trailing(
        customer_messages(messages),
        ["conversation_id"],
        ["sent_at", "message_id"],
        MAX_HISTORY,
        value,
        out,
        rows,
    )


def feature_rows(messages: DataFrame, rows: int | None = None) -> DataFrame:
    """`text_clean` and `context_clean` per customer message. Each text is
    cleaned and masked once, before it is copied into up to 30 windows."""
    slim = customer_messages(messages).drop("role")
    prepared = with_prepared(slim, "text", "_text").drop("text").withColumn("role", F.lit("customer"))
    windows = history_windows(prepared, F.col("_text"), "_history", rows)
    last, earlier = split_history(F.col("_history"))
    return windows.select(
        *[c for c in slim.columns if c != "text"],
        last.alias("text_clean"),
        earlier.alias("context_clean"),
    )


def assemble_examples(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Features with their label; null where a message has none."""
    scores = labels.select(F.col("target_id").alias("message_id"), "label_score")
    return features.join(scores, "message_id", "left").select(
        F.col("message_id").alias("example_id"),
        "customer_id",
        "conversation_id",
        "persona",
        "text_clean",
        "context_clean",
        "label_score",
    )


def split_assignment(
    groups: DataFrame,
    key: str,
    train: float = 0.70,
    validation: float = 0.15,
    test: float = 0.15,
    seed: int = 42,
) -> DataFrame:
    """(key, split) for the distinct keys: exact shares of keys, not of rows, by
    the position of each key in a seeded hash order. The held-out share is
    rounded up first and the test share of it second."""
    if abs(train + validation + test - 1.0) > 1e-9:
        raise ValueError("split ratios must add up to 1")
    # the distinct keys are read by every step below
    keys = materialize(groups.select(key).distinct(), "split-keys")
    hashed = keys.withColumn("_order", F.md5(F.concat(F.col(key), F.lit(f"-{seed}"))))
    placed = with_position(hashed, [], ["_order", key], "_position")
    total = keys.agg(F.count(F.lit(1))).scalar()
    held = validation + test
    return (
        placed.withColumn("_held", F.ceil(F.lit(held) * total))
        .withColumn("_test", F.ceil(F.lit(test / held) * F.col("_held")))
        .select(
            key,
            F.when(F.col("_position") <= F.col("_test"), "test")
            .when(F.col("_position") <= F.col("_held"), "validation")
            .otherwise("train")
            .alias("split"),
        )
    )


def grouped_split(
    examples: DataFrame, key: str = "customer_id", rows: int | None = None, **shares
) -> DataFrame:
    """Examples with their split; all rows of a customer stay together."""
    return lookup_join(examples, split_assignment(examples, key, **shares), [key], "left", rows)


def hash_split(
    key: Column, train: float = 0.70, validation: float = 0.15, seed: int = 42
) -> Column:
    """Split from the key alone, sizes approximate: no shuffle, fits streams."""
    bucket = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"-{seed}"))), 1, 8), 16, 10).cast("long") % 10_000
    return (
        F.when(bucket < int(train * 10_000), "train")
        .when(bucket < int((train + validation) * 10_000), "validation")
        .otherwise("test")
    )


def split_counts(examples: DataFrame, key: str = "customer_id") -> DataFrame:
    """Rows and distinct customers per split, pre-aggregated by customer."""
    return (
        examples.groupBy("split", key)
        .agg(F.count(F.lit(1)).alias("_n"))
        .groupBy("split")
        .agg(F.sum("_n").alias("n_rows"), F.count(F.lit(1)).alias("customers"))
    )


def split_sanity(examples: DataFrame, labels: DataFrame, key: str = "customer_id") -> DataFrame:
    """One row: counts, customers found in two splits, rows left without one."""
    by_key = examples.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(F.col("split").isin(*SPLITS)).alias("_placed"),
        F.count_distinct("split").alias("_splits"),
    )
    checks = by_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("example_rows"),
        F.coalesce(F.sum("_placed"), F.lit(0)).alias("split_rows"),
        F.count_if(F.col("_splits") > 1).alias("leaked_customers"),
    )
    label_rows = labels.agg(F.count(F.lit(1))).scalar()
    return checks.withColumn("label_rows", label_rows).withColumn(
        "error_code",
        F.when(F.col("example_rows") != F.col("label_rows"), "SP_R11_EXAMPLE_COUNT_MISMATCH")
        .when(F.col("leaked_customers") > 0, "SP_R12_CUSTOMER_ID_LEAK")
        .when(F.col("split_rows") != F.col("example_rows"), "SP_R13_SPLIT_ROW_SUM_MISMATCH"),
    )


def split_overlap(examples: DataFrame, key: str = "customer_id") -> DataFrame:
    """Keys common to each pair of splits; zero rows of them in a sound dataset."""
    keys = {s: examples.filter(F.col("split") == s).select(key) for s in SPLITS}
    result = None
    for left, right in (("train", "validation"), ("train", "test"), ("validation", "test")):
        shared = (
            keys[left]
            .intersect(keys[right])
            .agg(F.count(F.lit(1)).alias("shared"))
            .select(F.lit(left).alias("left_split"), F.lit(right).alias("right_split"), "shared")
        )
        result = shared if result is None else result.unionAll(shared)
    return result


def missing_from_union(examples: DataFrame, parts: list[DataFrame], key: str = "example_id") -> DataFrame:
    """Example keys that the union of the parts lacks."""
    union = parts[0].select(key)
    for part in parts[1:]:
        union = union.unionAll(part.select(key))
    return examples.select(key).exceptAll(union)


def write_dataset(examples: DataFrame, path: str) -> None:
    """One folder per split."""
    examples.write.partitionBy("split").parquet(path)


def review_sample(messages: DataFrame, size: int, seed: int = 42) -> DataFrame:
    """`size` customer messages, the same ones for the same seed."""
    order = F.md5(F.concat(F.col("message_id"), F.lit(f"-{seed}")))
    return customer_messages(messages).orderBy(order, "message_id").limit(size)


def cycled_histories(examples: DataFrame, size: int = 10, length: int = 30) -> DataFrame:
    """`size` rows whose context is `length` texts taken round and round from the
    pool of all `text_clean`: item j of row i is text (i + j) mod n."""
    order = ["example_id"]
    total = examples.agg(F.count(F.lit(1))).scalar()
    needed = size + length
    # only the first size + length texts can be reached from a larger pool
    pool = (
        examples.select("example_id", "text_clean")
        .orderBy(*order)
        .limit(needed)
    )
    pool = with_position(pool, [], order, "_p").withColumn("_at", F.col("_p") - 1)
    wanted = (
        pool.filter(F.col("_at") < size)
        .select(F.col("_at").alias("row"), "text_clean")
        .withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(length - 1))))
        .withColumn("_at", (F.col("row") + F.col("j")) % total)
    )
    texts = pool.select("_at", F.col("text_clean").alias("item"))
    return (
        wanted.join(texts, "_at")
        .groupBy("row", "text_clean")
        .agg(F.sort_array(F.collect_list(F.struct("j", "item"))).alias("_items"))
        .select("row", "text_clean", F.col("_items.item").alias("context_clean"))
    )
