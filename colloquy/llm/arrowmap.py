"""Adds columns computed from a text column by whole-array functions, batch by batch, without a shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

def with_columns(
    df: DataFrame, text: str, function: Callable[[pa.Array], Mapping[str, pa.Array]], fields: T.StructType,
    keep_text: bool = False,
) -> DataFrame:
    """`df` with the columns `fields` that `function` derives from the column `text` (a null is passed as null). Columns
    of those names are replaced. The text column itself is carried on only if asked for."""
    added = [f.name for f in fields]
    kept = [c for c in df.columns if c not in added and (keep_text or c != text)]
    body = "_".join(["", *df.columns])  # a name that no column has
    source = df.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text}`").cast("string").alias(body))
    schema = T.StructType([source.schema[c] for c in kept] + list(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            made = function(batch.column(batch.num_columns - 1))
            arrays = [batch.column(i) for i in range(len(kept))] + [made[name] for name in added]
            yield pa.RecordBatch.from_arrays(arrays, names=kept + added)

    return source.mapInArrow(run, schema)


def by_place(df: DataFrame) -> tuple[DataFrame, Callable[[str], str], Callable[[DataFrame], DataFrame]]:
    """`df` with its columns named by place, so that no name can clash with those of a step; the new name of a column;
    and the way back, which drops what the step added."""
    names = df.columns

    def place(name: str) -> str:
        return f"c{names.index(name)}"

    def back(out: DataFrame) -> DataFrame:
        return out.select(*(F.col(f"c{i}").alias(name) for i, name in enumerate(names)))

    return df.toDF(*(f"c{i}" for i in range(len(names)))), place, back


def id_hash(column: str, modulus: int) -> Column:
    """crc32 of a column's text modulo `modulus`; a null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus
