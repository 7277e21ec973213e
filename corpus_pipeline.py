"""The way of a corpus: quality rules, line dedup, near-duplicate join, benchmark decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns the rows that go on; `run` writes every stage as Parquet and reads it
again for the next one. All stages but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from colloquy.llm.decontam import decontaminate
from colloquy.llm.linededup import line_dedup
from colloquy.llm.mixing import mix_sample
from colloquy.llm.ngramjoin import drop_near_duplicates
from colloquy.llm.quality import quality_filter
from colloquy.llm.registry import table
from colloquy.session import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_filter(docs, table(spark, sf_dir, "labels"))


def cross_site_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that spread over many sites."""
    return line_dedup(docs)


def near_duplicate_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies."""
    return drop_near_duplicates(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not hold benchmark items."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to the target weights of sources, languages and topics."""
    return mix_sample(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", cross_site_lines),
    ("ngram_jaccard_join", near_duplicate_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mixing", target_mix),
]

ORACLE_SQL = None  # the join's prefix tries and the raking sweeps have no SQL form; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
