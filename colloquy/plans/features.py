"""TF-IDF weights of words and characters, exact over the whole vocabulary.

Terms stay rows: (example_id, term, weight). Nothing the size of the vocabulary
or of the corpus is held by the driver or one task. The terms of a row are counted
where the row is, on Arrow batches, so what is shuffled is one row per example and
term, not one per occurrence; an idf that many rows need is broadcast. Where no two
rows have one key, `word_weights` shuffles not even those: a task's pieces of the table
ask for the frequencies of their terms, once a piece, and weigh their rows in place.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.functions.text import char_ngrams, join_context, words
from colloquy.operators.skew import lookup_join
from colloquy.plans import termhash
from colloquy.session import hot_rows, materialize, shuffles_deleted, small_batches

TOKENS = 1 << 20  # tokens of the rows counted at once, unless a single row has more
COMMON_TERMS = 1 << 17  # terms whose idf is broadcast, at most
BUCKET_TERMS = 1 << 21  # terms of all pieces that a bucket adds up, about
TABLES_AT_ONCE = 4  # pieces that a task takes from the JVM at once

Found = tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]
Pair = tuple[np.ndarray, np.ndarray]  # numbers of the (n-1)-gram and the token that make an n-gram


def _pieces(lists: pa.Array) -> Iterator[tuple[int, np.ndarray, pa.Array]]:
    """First row, first token of each row (one more entry than rows) and tokens of consecutive rows."""
    offsets = np.asarray(lists.offsets).astype(np.int64)
    row = 0
    while row < len(lists):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + TOKENS, "right")) - 1)
        stop = min(stop, len(lists))
        yield row, offsets[row : stop + 1] - offsets[row], lists.values[offsets[row] : offsets[stop]]
        row = stop


def _joined(terms: pa.Array, single: pa.Array, pair: Pair) -> pa.Array:
    left, last = pair
    return pc.binary_join_element_wise(terms.take(pa.array(left)), single.take(pa.array(last)), " ")


def _counted(
    first: np.ndarray, tokens: pa.Array, low: int, high: int, made: list[Pair] | None = None
) -> Iterator[Found]:
    """Row, number of the term and count, of each row and n-gram, and the terms by number; one item per n. `made` gets what
    the terms of each n above one are joined from."""
    coded = tokens.dictionary_encode()
    single, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at, gram, terms = np.arange(len(code)), code, single
    for n in range(1, high + 1):
        if n > 1:
            # the n-gram at i is the (n-1)-gram at i and the token at i + n - 1, if that is of the same row
            whole = at + n - 1 < len(code)
            at, gram = at[whole], gram[whole]
            whole = row[at + n - 1] == row[at]
            at, gram = at[whole], gram[whole]
            pairs, gram = np.unique(gram * len(single) + code[at + n - 1], return_inverse=True)
            pair = np.divmod(pairs, max(len(single), 1))
            terms = _joined(terms, single, pair)
            if made is not None:
                made.append(pair)
        if n >= low and len(at):
            cells, times = np.unique(row[at] * len(terms) + gram, return_counts=True)
            yield cells // len(terms), cells % len(terms), times, terms


def _count(examples: DataFrame, key: str, low: int, high: int) -> DataFrame:
    """(key, term, tf) of each row of (key, _tokens), whatever other rows have its key."""
    schema = T.StructType([examples.schema[key], T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, first, tokens in _pieces(batch.column(1)):
                for row, term, times, terms in _counted(first, tokens, low, high):
                    keys = batch.column(0).take(pa.array(row + start))
                    yield pa.RecordBatch.from_arrays([keys, terms.take(pa.array(term)), pa.array(times)], names=schema.names)

    return examples.select(key, "_tokens").mapInArrow(run, schema)


def _rows_with(examples: DataFrame, low: int, high: int) -> DataFrame:
    """(term, df): rows of (_tokens) that have a term, added up within a part of a task's rows; a term may come again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, first, tokens in _pieces(batch.column(0)):
                for _, term, _, terms in _counted(first, tokens, low, high):
                    rows = np.bincount(term, minlength=len(terms))
                    yield pa.RecordBatch.from_arrays([terms, pa.array(rows)], names=["term", "df"])

    return examples.select("_tokens").mapInArrow(run, "term string, df long")


def _by_key(examples: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """The rows whose key no other row has, and the rest, or None if there is no rest. The keys are read once more."""
    repeated = examples.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    repeated = materialize(repeated, "repeated-keys")
    if repeated.isEmpty():
        return examples, None
    again = repeated.select(key, F.lit(True).alias("_again"))
    marked = lookup_join(examples, again, [key], "left", sizes=repeated)
    rest = F.col(key).isNull() | F.col("_again").isNotNull()
    return marked.filter(~rest).drop("_again"), marked.filter(rest).drop("_again")


def _sum_by_key(rest: DataFrame, key: str, low: int, high: int) -> DataFrame:
    return _count(rest, key, low, high).groupBy(key, "term").agg(F.sum("tf").alias("tf"))


def term_counts(examples: DataFrame, tokens: Column, key: str = "example_id", low: int = 1, high: int = 1) -> DataFrame:
    """(key, term, tf) of the n-grams of a token array. Rows of one key count together."""
    own, rest = _by_key(examples.select(key, tokens.alias("_tokens")), key)
    counts = _count(own, key, low, high)
    return counts if rest is None else counts.unionByName(_sum_by_key(rest, key, low, high))


def word_counts(examples: DataFrame, text: str, low: int = 1, high: int = 2) -> DataFrame:
    return term_counts(examples, words(F.col(text)), "example_id", low, high)


def char_counts(examples: DataFrame, text: str, low: int = 2, high: int = 5) -> DataFrame:
    return term_counts(examples, char_ngrams(F.col(text), low, high))


def context_counts(examples: DataFrame, context: str = "context_clean") -> DataFrame:
    joined = examples.select("example_id", join_context(F.col(context)).alias("_context"))
    return word_counts(joined, "_context")


def _smoothed(frequencies: DataFrame, examples: Column) -> DataFrame:
    return frequencies.withColumn("idf", F.log((1 + examples) / (1 + F.col("df"))) + 1)


def inverse_frequencies(counts: DataFrame, examples: Column) -> DataFrame:
    """(term, df, idf): smoothed, `ln((1 + n) / (1 + df)) + 1`."""
    return _smoothed(counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")), examples)


def word_inverse_frequencies(
    texts: DataFrame, text: str, examples: Column, low: int = 1, high: int = 2, key: str = "example_id"
) -> DataFrame:
    """`inverse_frequencies` of `word_counts`, but rows are added up where they are, and no count is made of them."""
    own, rest = _by_key(texts.select(key, words(F.col(text)).alias("_tokens")), key)
    found = _rows_with(own, low, high)
    if rest is not None:
        found = found.unionByName(_sum_by_key(rest, key, low, high).select("term", F.lit(1).cast("long").alias("df")))
    return _smoothed(found.groupBy("term").agg(F.sum("df").alias("df")), examples)


def weigh(
    counts: DataFrame, idf: DataFrame, scale: float = 1.0, rows: int | None = None
) -> DataFrame:
    """(example_id, term, weight): tf x idf with length one per example, then
    scaled. Terms the idf table does not know are left out.

    The document frequency of a term is its number of rows. Those with one in
    COMMON_TERMS of all rows, of which there are no more than that, and any with
    more than `rows`, are broadcast; the others are joined and no task gets many
    rows of one. The norm needs the rows of one example together; there are no more
    of them than its text has n-grams."""
    total = idf.agg(F.sum("df")).first()[0] or 0
    limit = min(max(1, total // COMMON_TERMS), rows or hot_rows(counts.sparkSession))
    common = F.broadcast(idf.filter(F.col("df") > limit).select("term", "idf"))
    others = idf.filter(F.col("df") <= limit).select("term", "idf")
    joined = counts.join(common, "term").unionByName(counts.join(common, "term", "left_anti").join(others, "term"))
    weighted = joined.select("example_id", "term", (F.col("tf") * F.col("idf")).alias("_w"))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy("example_id")))
    return weighted.select("example_id", "term", (F.lit(scale) * F.col("_w") / norm).alias("weight"))


PIECES = "piece long, found long, keys binary, terms binary, cells binary"


def _bytes_of(**columns: np.ndarray | pa.Array) -> bytes:
    """Columns of one length, compressed."""
    batch = pa.RecordBatch.from_pydict(columns)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _columns_of(data: bytes) -> list[pa.Array]:
    return pa.ipc.open_stream(data).read_next_batch().columns


def _rows_of(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    """Rows of numbers and bytes."""
    fields = [field.split() for field in schema.split(", ")]
    kinds = [pa.int64() if kind == "long" else pa.binary() for _, kind in fields]
    columns = [pa.array(column, kind) for column, kind in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)]
    return pa.RecordBatch.from_arrays(columns, names=[name for name, _ in fields])


def _as_pieces(examples: DataFrame, key: str, low: int, high: int) -> DataFrame:
    """PIECES of (key, _tokens): some rows' keys, the terms they have, and row, term and count, as steps, of each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for start, first, tokens in _pieces(batch.column(1)):
                made: list[Pair] = []
                found = list(_counted(first, tokens, low, high, made))
                if not found:
                    continue
                before = np.cumsum([0, *(len(f[3]) for f in found)])
                row = np.concatenate([f[0] for f in found])
                term = np.concatenate([f[1] + b for f, b in zip(found, before)])
                times = np.concatenate([f[2] for f in found])
                steps = (np.diff(x, prepend=0).astype(np.int32) for x in (row, term))
                cells = _bytes_of(row=next(steps), term=next(steps), times=times.astype(np.int32))
                keys = _bytes_of(key=batch.column(0).slice(start, len(first) - 1))
                single = _bytes_of(term=tokens.dictionary_encode().dictionary)
                pairs = [_bytes_of(left=np.diff(a, prepend=0).astype(np.int32), last=b.astype(np.int32)) for a, b in made]
                yield _rows_of(PIECES, [(number, int(before[-1]), keys, pickle.dumps([single, *pairs]), cells)])
                number += 1

    return examples.select(key, "_tokens").mapInArrow(run, PIECES)


def _terms_of(data: bytes, low: int) -> pa.Array:
    """The terms of a piece: tokens are kept, n-grams joined anew."""
    single, *pairs = pickle.loads(data)
    terms = single = _columns_of(single)[0]
    found = [terms] if low == 1 else []
    for n, pair in enumerate(pairs, 2):
        left, last = (c.to_numpy() for c in _columns_of(pair))
        terms = _joined(terms, single, (np.cumsum(left, dtype=np.int64), last))
        if n >= low:
            found.append(terms)
    return pa.concat_arrays(found)


def _dealt(terms: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The terms' numbers in the order of their buckets, and where each bucket starts (one more entry than buckets)."""
    text, first = termhash._bytes(terms)
    bucket = termhash._hash(text, first[:-1], np.diff(first)) % np.uint32(buckets)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


ASKED = "bucket long, piece long, terms binary, rows binary"
ANSWERS = "piece long, bucket long, df binary"


def _frequencies(pieces: DataFrame, buckets: int, low: int) -> DataFrame:
    """ANSWERS: of each piece and bucket how many rows of all pieces have each of its terms."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, terms_, cells in zip(*(batch.column(i).to_pylist() for i in range(3))):
                terms = _terms_of(terms_, low)
                rows = np.bincount(np.cumsum(_columns_of(cells)[1].to_numpy(), dtype=np.int64), minlength=len(terms))
                order, start = _dealt(terms, buckets)
                asked = []
                for bucket in range(buckets):
                    own = order[start[bucket] : start[bucket + 1]]
                    if len(own):
                        asked.append((bucket, piece, _bytes_of(term=terms.take(pa.array(own))), _bytes_of(rows=rows[own])))
                yield _rows_of(ASKED, asked)

    def answer(t: pa.Table) -> pa.Table:
        terms = [_columns_of(b)[0] for b in t["terms"].to_pylist()]
        rows = np.concatenate([_columns_of(b)[0].to_numpy() for b in t["rows"].to_pylist()])
        code = pa.concat_arrays(terms).dictionary_encode().indices.to_numpy()
        df = np.bincount(code, rows)[code].astype(np.int64)
        cuts = np.cumsum([len(x) for x in terms])[:-1]
        made = zip(t["piece"].to_pylist(), t["bucket"].to_pylist(), (_bytes_of(df=x) for x in np.split(df, cuts)))
        return pa.Table.from_batches([_rows_of(ANSWERS, list(made))])

    asked = pieces.select("piece", "terms", "cells").mapInArrow(ask, ASKED)
    return asked.groupBy("bucket").applyInArrow(answer, ANSWERS)


def word_weights(
    examples: DataFrame, text: str, scale: float = 1.0, low: int = 1, high: int = 2, key: str = "example_id"
) -> DataFrame:
    """(key, term, weight): `weigh` of `word_counts` and `inverse_frequencies` over all `examples`.

    Where a key repeats or is null, it is that. Else a row's terms stay where they are, packed closely, until the bucket
    of each term has told in how many rows it is; then the row is weighed, whole. What is written and shuffled is each
    term of a piece of rows once, and a few bytes for each row and term."""
    spark = examples.sparkSession
    own, rest = _by_key(examples.select(key, words(F.col(text)).alias("_tokens")), key)
    n = examples.count()
    if rest is not None:
        counts = materialize(word_counts(examples, text, low, high), "term-counts", close=True)
        idf = materialize(inverse_frequencies(counts, F.lit(n)), "idf", close=True)
        return weigh(counts, idf, scale)
    pieces = materialize(_as_pieces(own, key, low, high), "pieces", large_rows=True)
    total = pieces.agg(F.sum("found")).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_TERMS))
    with shuffles_deleted(spark), small_batches(spark, TABLES_AT_ONCE):
        answers = materialize(_frequencies(pieces, buckets, low), "frequencies")
    schema = T.StructType(
        [examples.schema[key], T.StructField("term", T.StringType()), T.StructField("weight", T.DoubleType())]
    )

    def weighed(piece: pa.Table, answered: pa.Table) -> pa.Table:
        (keys,), cells = (_columns_of(piece[c][0].as_py()) for c in ("keys", "cells"))
        terms = _terms_of(piece["terms"][0].as_py(), low)
        row, term, times = (c.to_numpy() for c in cells)
        row, term = np.cumsum(row, dtype=np.int64), np.cumsum(term, dtype=np.int64)
        by_bucket = sorted(zip(answered["bucket"].to_pylist(), answered["df"].to_pylist()))
        df = np.empty(len(terms), np.int64)
        df[_dealt(terms, buckets)[0]] = np.concatenate([_columns_of(b)[0].to_numpy() for _, b in by_bucket])
        weight = times * (np.log((1 + n) / (1 + df)) + 1)[term]
        norm = np.sqrt(np.bincount(row, weight * weight))
        found = [keys.take(pa.array(row)), terms.take(pa.array(term)), pa.array(scale * weight / norm[row])]
        return pa.Table.from_arrays(found, names=schema.names)

    return pieces.groupBy("piece").cogroup(answers.groupBy("piece")).applyInArrow(weighed, schema)
