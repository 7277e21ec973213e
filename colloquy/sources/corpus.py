"""JSONL corpora: line-numbered scan, encoding and path checks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.functions.text import is_blank

# The fields of a corpus line and their type.
FIELDS = (
    "corpus_id", "conversation_id", "customer_id", "message_id", "role",
    "text", "sent_at", "persona", "generated_label",
)
LINE = ", ".join(f"{f} {'double' if f == 'generated_label' else 'string'}" for f in FIELDS)


def stem(path: Column) -> Column:
    """The corpus that a file should hold: its name without folders and suffix."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def scan_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, corpus, line_no, value) of every physical line, blank ones included.

    Lines are numbered without moving them: the position inside a file block
    comes from the row id of the scan, and the lines in the blocks before it from
    a table with one row per block."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"),
        "value",
    )
    blocks = lines.groupBy("path", "_block").agg(
        F.min("_id").alias("_least"), F.count(F.lit(1)).alias("_lines")
    )
    before = Window.partitionBy("path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(
        "path", "_block",
        (F.coalesce(F.sum("_lines").over(before), F.lit(0)) - F.col("_least") + 1).alias("_offset"),
    )
    # one row per file block: its size is the corpus size over the block size,
    # and the runtime size check decides whether it is broadcast
    return lines.join(offsets, ["path", "_block"]).select(
        "path", stem(F.col("path")).alias("corpus"), (F.col("_id") + F.col("_offset")).alias("line_no"), "value"
    )


def load_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Messages of a corpus that was validated before; blank lines skipped. The
    canonical order is for sinks: see `write_canonical`."""
    return (
        spark.read.text(path)
        .filter(~is_blank(F.col("value")))
        .select(F.from_json("value", LINE).alias("m"))
        .select("m.*")
    )


def write_canonical(messages: DataFrame, path: str) -> None:
    """JSONL ordered by (conversation_id, sent_at); null labels are kept."""
    messages.orderBy("conversation_id", "sent_at").select(
        F.to_json(F.struct(*FIELDS), {"ignoreNullFields": "false"}).alias("value")
    ).write.text(path)


def open_path(path: str):
    """The file system of a path as Spark prints it, and the name there."""
    from pyarrow import fs

    # Spark prints local paths with one slash
    local = path.startswith("file:/") and not path.startswith("file://")
    return fs.FileSystem.from_uri("file://" + path[len("file:") :] if local else path)


def _inspect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow import fs

    for batch in batches:
        rows = []
        for path in batch["path"]:
            source, name = open_path(path)
            info = source.get_file_info(name)
            start, readable = b"", info.type == fs.FileType.File
            if readable:
                try:
                    with source.open_input_stream(name) as stream:
                        start = stream.read(3)
                except OSError:
                    readable = False
            rows.append((path, info.type != fs.FileType.NotFound, readable, info.size or 0, start == b"\xef\xbb\xbf"))
        yield pd.DataFrame(rows, columns=["path", "found", "readable", "size", "has_bom"])


def files(spark: SparkSession, path: str) -> DataFrame:
    """Paths of the files that hold anything; their content is not read."""
    return spark.read.format("binaryFile").load(path).select("path")


def inspect_files(paths: DataFrame) -> DataFrame:
    """(path, found, readable, size, has_bom) of the given paths; three bytes of
    each file are read. A folder is found but not readable. Text scans drop a byte order mark, and listings leave empty files
    out, so neither can be seen there."""
    return paths.select("path").mapInPandas(_inspect, "path string, found boolean, readable boolean, size long, has_bom boolean")


def encoding_errors(lines: DataFrame, marks: DataFrame) -> DataFrame:
    """At most one error per file: a byte order mark (no line), else the first
    line that is not UTF-8."""
    first_bad = (
        lines.filter(~F.is_valid_utf8("value"))
        .groupBy("path")
        .agg(F.min("line_no").alias("line_no"))
    )
    return (
        marks.join(first_bad, "path", "left")
        .filter(F.col("has_bom") | F.col("line_no").isNotNull())
        .select(
            "path",
            F.when(~F.col("has_bom"), F.col("line_no")).alias("line_no"),
            F.lit("IG_R04_ENCODING_INVALID").alias("code"),
            F.when(F.col("has_bom"), "byte order mark").otherwise("not UTF-8").alias("detail"),
        )
    )


def readable_lines(lines: DataFrame, encoding: DataFrame) -> DataFrame:
    """Lines ahead of a file's encoding error; none of a file with a mark."""
    # one row per faulty file
    stops = encoding.select("path", F.coalesce("line_no", F.lit(1).cast("long")).alias("_stop"))
    return (
        lines.join(stops, "path", "left")
        .filter(F.col("_stop").isNull() | (F.col("line_no") < F.col("_stop")))
        .drop("_stop")
    )


def path_errors(inspected: DataFrame) -> DataFrame:
    """Why a file cannot be a corpus, or null; `corpus` is the expected id."""
    code = (
        F.when(~F.col("path").endswith(".jsonl"), "IG_R01_NOT_READABLE")
        .when(~F.col("found"), "IG_R01_FILE_NOT_FOUND")
        .when(~F.col("readable"), "IG_R01_NOT_READABLE")
        .when(F.col("size") == 0, "IG_R01_EMPTY_FILE")
        .when(~F.col("path").rlike(r"/raw/synthetic/[^/]+$"), "IG_R02_PATH_OUTSIDE_SYNTHETIC")
    )
    return inspected.select("path", stem(F.col("path")).alias("corpus"), "size", code.alias("code"))
