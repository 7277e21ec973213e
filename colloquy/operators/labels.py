"""Label sets from a validated corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.sources.tables import LEVELS

LABEL_SCHEMA = T.StructType(
    [
        T.StructField("label_set_id", T.StringType(), False),
        T.StructField("target_type", T.StringType(), False),
        T.StructField("target_id", T.StringType(), False),
        T.StructField("label_score", T.DoubleType(), False),
        T.StructField("scale", T.StringType(), False),
        T.StructField("label_source", T.StringType(), False),
        T.StructField("annotator", T.StringType(), True),
        T.StructField("labeled_at", T.StringType(), False),
    ]
)


def label_rows(messages: DataFrame, corpus_id: Column) -> DataFrame:
    """One label per customer message; the label time is the message's own."""
    return messages.filter(F.col("role") == "customer").select(
        F.concat(F.lit("ls-"), corpus_id).alias("label_set_id"),
        F.lit("message").alias("target_type"),
        F.col("message_id").alias("target_id"),
        F.col("generated_label").alias("label_score"),
        F.lit("-1 to 1").alias("scale"),
        F.lit("synthetic").alias("label_source"),
        F.lit(None).cast("string").alias("annotator"),
        F.col("sent_at").alias("labeled_at"),
    )


def write_label_set(labels: DataFrame, path: str) -> None:
    """Parquet with the fixed label schema; a null in a required column fails."""
    rows = labels.select(
        *[
            (F.col(f.name) if f.nullable else F.coalesce(F.col(f.name), F.raise_error(F.lit(f"{f.name} is null")).cast(f.dataType)))
            .cast(f.dataType)
            .alias(f.name)
            for f in LABEL_SCHEMA
        ]
    )
    rows.write.parquet(path)


def read_label_set(spark, path: str) -> DataFrame:
    return spark.read.schema(LABEL_SCHEMA).parquet(path)


def label_levels(labels: DataFrame) -> DataFrame:
    """Rows per level, all five levels present."""
    spark = labels.sparkSession
    levels = spark.createDataFrame([(v,) for v in LEVELS], "level double")
    counts = labels.groupBy(F.col("label_score").alias("level")).agg(F.count(F.lit(1)).alias("n"))
    return levels.join(counts, "level", "left").select(
        "level", F.coalesce("n", F.lit(0).cast("long")).alias("n")
    )


def label_sanity(labels: DataFrame, messages: DataFrame) -> DataFrame:
    """One row: the counts the label set has to agree on, and the verdict."""
    expected = messages.agg(F.count_if(F.col("role") == "customer").alias("expected_rows"))
    repeated = (
        labels.groupBy("target_id")
        .agg(F.count(F.lit(1)).alias("_n"), F.count_if(~F.col("label_score").isin(*LEVELS) | F.col("label_score").isNull()).alias("_bad"))
        .agg(
            F.coalesce(F.sum("_n"), F.lit(0)).alias("label_rows"),
            F.count(F.lit(1)).alias("distinct_targets"),
            F.coalesce(F.sum("_bad"), F.lit(0)).alias("out_of_domain"),
        )
    )
    return repeated.withColumn("expected_rows", expected.scalar()).withColumn(
        "error_code",
        F.when(F.col("label_rows") != F.col("expected_rows"), "LB_R10_ROW_COUNT_MISMATCH")
        .when(F.col("distinct_targets") != F.col("label_rows"), "LB_R11_DUPLICATE_TARGET_ID")
        .when(F.col("out_of_domain") > 0, "LB_R11_LABEL_SCORE_OUT_OF_DOMAIN"),
    )
