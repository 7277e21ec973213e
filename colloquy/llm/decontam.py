"""Benchmark decontamination with suffix arrays of the training texts.

Texts are searched where they are, in shards of a few megabytes. Of a shard only stretches of words that the benchmark
also knows are indexed (nothing else can match): their suffixes are sorted by prefix doubling. All benchmark suffixes
are then searched at once, word by word, each step narrowing a range of the suffix array by binary search, until no word
matches any more. That yields every occurrence of every window and, per benchmark suffix, the longest verbatim match in
the shard and where it is.

A window is 13 consecutive words of an item; an item of fewer words, but not none, is one window. Words of a text inside
an occurrence of a window are hit; a text is contaminated when at least one word in twenty is.

The benchmark is sent to the tasks in blocks of at most MAX_BLOCK_WORDS words (or one item), whose size is counted
first; a larger benchmark takes several passes, and the slim rows of texts with hits are merged.

Defined cases: a null or empty text has no words and is clean; items without words are ignored; a null item id is the
empty string; items repeated under one id count once; rows with the same id and text are judged alike; an empty
benchmark finds nothing; other columns pass through, and columns named as the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.llm import textbytes as tb
from colloquy.llm.arrowmap import by_place, with_columns
from colloquy.llm.registry import query, table
from colloquy.session import materialize

WINDOW = 13
SHARD_BYTES = 4 << 20
MAX_BLOCK_WORDS = 4_000_000
HIT_SHARE = 20  # one word in so many

FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField(
            "hits",
            T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])),
        ),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


@dataclass
class Tests:
    """A block of the benchmark: word numbers of all items one after another, each item closed by a 0; `known` are the
    sorted hashes of the words numbered from 1; `first` and `size` delimit the items, `ids` are their names."""

    known: np.ndarray
    words: np.ndarray
    first: np.ndarray
    size: np.ndarray
    ids: list[str]

    @classmethod
    def of(cls, ids: list[str], texts: list[str]) -> Tests:
        column = pa.array(texts, pa.string())
        parts, sizes = [], []
        for _, _, w in tb.tokenized(column, tb.ALNUM, tb.LOWER, SHARD_BYTES):
            parts.append(w.hash)
            sizes.append(np.diff(w.first))
        h = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        some = np.flatnonzero(size)
        known, number = np.unique(h, return_inverse=True)
        size = size[some]
        first = np.concatenate([[0], np.cumsum(size + 1)])[:-1].astype(np.int64)
        words = np.zeros(int((size + 1).sum()), np.int64)
        words[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(len(number))] = number + 1
        return cls(known, words, first, size, [ids[i] for i in some])

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """For each place in `words`: the window length there (0: none) and the item."""
        span = np.minimum(self.size, WINDOW)
        length = np.zeros(len(self.words), np.int64)
        item = np.repeat(np.arange(len(self.size)), self.size + 1)
        at = np.arange(len(self.words)) - self.first[item]
        starts = at <= (self.size - span)[item]
        length[starts] = span[item][starts]
        return length, item


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of `s` in order, by prefix doubling."""
    n = len(s)
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        step *= 2
        if new[-1] == n - 1 or step >= n:
            return order


def _narrow(s: np.ndarray, order: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int, word: np.ndarray, right: bool) -> np.ndarray:
    """Binary search, all ranges at once: the border of the suffixes whose word at `depth` is below (or, `right`, not
    above) `word`."""
    low, high = low.copy(), high.copy()
    while True:
        open_ = low < high
        if not open_.any():
            return low
        mid = (low + high) // 2
        at = order[np.minimum(mid, len(order) - 1)] + depth
        seen = np.where(at < len(s), s[np.minimum(at, len(s) - 1)], -1)
        go = open_ & ((seen <= word) if right else (seen < word))
        low = np.where(go, mid + 1, low)
        high = np.where(open_ & ~go, mid, high)


@dataclass
class Shard:
    """What a search of one shard found. `window_at[k]`, `window_place[k]`: window (place in the tests) and text
    place of one occurrence. `length[j]`, `place[j]`: longest match of test suffix j and one place of it."""

    window: np.ndarray
    place: np.ndarray
    longest: np.ndarray
    longest_place: np.ndarray


def search(s: np.ndarray, tests: Tests, lengths: np.ndarray) -> Shard:
    """All occurrences in `s` of the windows of `tests`, and the longest match of every test suffix."""
    order = suffix_array(s)
    suffix = np.flatnonzero(tests.words)
    # Equal windows are searched once per place of the tests; there are few places.
    low = np.zeros(len(suffix), np.int64)
    high = np.full(len(suffix), len(s), np.int64)
    longest = np.zeros(len(tests.words), np.int64)
    longest_place = np.full(len(tests.words), -1, np.int64)
    found_window, found_low, found_high = [], [], []
    depth = 0
    while len(suffix):
        word = tests.words[suffix + depth]
        lower = _narrow(s, order, low, high, depth, word, False)
        upper = _narrow(s, order, lower, high, depth, word, True)
        go = (lower < upper) & (word > 0)
        suffix, low, high = suffix[go], lower[go], upper[go]
        depth += 1
        longest[suffix], longest_place[suffix] = depth, order[low]
        full = lengths[suffix] == depth
        found_window.append(suffix[full])
        found_low.append(low[full])
        found_high.append(high[full])
    window, low, high = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found_window, found_low, found_high))
    count = high - low
    index = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
    return Shard(np.repeat(window, count), order[index], longest, longest_place)


def _stretches(w: tb.Words, tests: Tests, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of at least `least` words that the tests know, each closed by a 0: word numbers, and the number
    in `w` of each word (-1 for the closing ones)."""
    h = w.hash
    n = len(h)
    maybe = np.zeros(1 << 20, bool)
    maybe[(tests.known >> np.uint64(44)).astype(np.int64)] = True
    at = np.flatnonzero(maybe[(h >> np.uint64(44)).astype(np.int64)])
    near = np.searchsorted(tests.known, h[at])
    right = tests.known[np.minimum(near, len(tests.known) - 1)] == h[at]
    at, number = at[right], near[right] + 1
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row_start = np.zeros(n + 1, bool)
    row_start[w.first] = True
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) > 1) | row_start[at[1:]]
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(at)))
    stretch = np.repeat(np.arange(len(first)), size)
    keep = (size >= least)[stretch]
    at, number, stretch = at[keep], number[keep], stretch[keep]
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    closing = np.cumsum(np.concatenate([[0], stretch[1:] != stretch[:-1]]))
    place = np.arange(len(at)) + closing
    s = np.zeros(place[-1] + 2, np.int64)
    owner = np.full(len(s), -1, np.int64)
    s[place], owner[place] = number, at
    return s, owner


def _merged(row: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of word ranges per row."""
    order = np.lexsort((start, row))
    row, start, stop = row[order], start[order], stop[order]
    # Ends only grow along a row once rows are set apart by more than any word number.
    apart = row * (1 << 40)
    reach = np.maximum.accumulate(stop + apart)
    new = np.ones(len(row), bool)
    new[1:] = (start + apart)[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row)) - 1
    return row[first], start[first], (reach - apart)[last]


def _lists(row: np.ndarray, values: pa.Array, rows: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(rows + 1)), pa.int32()), values)


def _search_column(column: pa.Array, tests: Tests) -> dict[str, pa.Array]:
    lengths, item = tests.windows()
    least = int(lengths[lengths > 0].min()) if (lengths > 0).any() else 0
    counts, hits, items = [], [], []
    for low, _, w in tb.tokenized(column, tb.ALNUM, tb.LOWER, SHARD_BYTES):
        counts.append(np.diff(w.first))
        s, owner = _stretches(w, tests, least) if least else (np.zeros(0, np.int64),) * 2
        if not len(s):
            continue
        found = search(s, tests, lengths)
        if not len(found.window):
            continue
        word = owner[found.place]
        row = np.searchsorted(w.first, word, "right") - 1
        start = word - w.first[row]
        hits.append((row + low, start, start + lengths[found.window]))
        items.append(np.unique(((row + low) << 32) | item[found.window]))
    rows = len(column)
    none = np.zeros(0, np.int64)
    row, start, stop = _merged(*(np.concatenate(x) for x in zip(*hits, strict=True))) if hits else (none, none, none)
    pair = np.concatenate(items) if items else none
    spans = pa.StructArray.from_arrays([pa.array(start), pa.array(stop)], names=["start", "end"])
    # The same id may stand for several items of the benchmark.
    named = sorted({(int(p >> 32), tests.ids[int(p & 0xFFFFFFFF)]) for p in pair})
    return {
        "n_words": pa.array(np.concatenate(counts) if counts else np.zeros(rows, np.int64), pa.int64()),
        "hits": _lists(row, spans, rows),
        "items": _lists(np.array([r for r, _ in named], np.int64), pa.array([i for _, i in named], pa.string()), rows),
    }


def _blocks(benchmark: DataFrame, text: str, item_id: str, limit: int) -> Iterator[Tests]:
    """The benchmark in blocks whose size is bounded before they are brought together."""
    named = benchmark.select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("id"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    ).distinct()
    total = named.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // (2 * limit)))  # a word and what parts it from the next are two characters at least
    for k in range(blocks):
        rows = sorted(named.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k).collect())
        yield Tests.of([r["id"] for r in rows], [r["text"] for r in rows])


def _pass(docs: DataFrame, tests: Tests, text: str, keep_text: bool) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(tests)  # at most one block
    return with_columns(docs, text, lambda column: _search_column(column, sent.value), FOUND, keep_text)


_KEY = ["_key", "_key2"]


def _several(docs: DataFrame, blocks: list[Tests], text: str, keep_text: bool) -> DataFrame:
    """As one pass; what the further blocks hit is written per text and joined to it."""
    keyed = docs.withColumns({"_key": F.xxhash64(text), "_key2": F.xxhash64(text, F.lit(1))})
    rest = None
    for tests in blocks[1:]:
        hit = _pass(keyed.select(*_KEY, text), tests, text, False).where(F.size("hits") > 0)
        slim = hit.groupBy(*_KEY).agg(F.first("hits").alias("hits"), F.first("items").alias("items"))
        rest = slim if rest is None else rest.unionByName(slim)
    merged = materialize(rest, "hits").groupBy(*_KEY).agg(
        F.flatten(F.collect_list("hits")).alias("_hits"), F.flatten(F.collect_list("items")).alias("_items")
    )
    first = _pass(keyed, blocks[0], text, keep_text)
    both = first.join(merged, _KEY, "left")
    return both.withColumns(
        {
            "hits": F.concat("hits", F.coalesce("_hits", F.array().cast(first.schema["hits"].dataType))),
            "items": F.array_distinct(F.concat("items", F.coalesce("_items", F.array().cast("array<string>")))),
        }
    ).drop("_hits", "_items", *_KEY)


_N_HIT = (
    "aggregate(array_sort(hits), named_struct('n', 0L, 'stop', 0L), (a, h) -> named_struct("
    "'n', a.n + greatest(0L, h.end - greatest(a.stop, h.start)), 'stop', greatest(a.stop, h.end)), a -> a.n)"
)


def find_benchmark(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", keep_text: bool = False, item_id: str = "item_id",
    limit: int = MAX_BLOCK_WORDS,
) -> DataFrame:
    """`docs` with n_words, hits (word ranges inside occurrences of windows), n_hit, items (ids of the items with an
    occurring window) and `contaminated`. The text is carried on only if asked for."""
    blocks = list(_blocks(benchmark, "text", item_id, limit))
    ready = docs.drop("n_words", "hits", "n_hit", "items", "contaminated", *_KEY)
    found = (_pass if len(blocks) == 1 else _several)(
        ready, blocks[0] if len(blocks) == 1 else blocks, text, keep_text
    )
    return found.withColumn("n_hit", F.expr(_N_HIT)).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (HIT_SHARE * F.col("n_hit") >= F.col("n_words"))
    )


LONGEST = "item_id string, item_word long, length long, {id} {type}, doc_word long"


def longest_matches(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", id_col: str = "doc_id", item_id: str = "item_id",
    limit: int = MAX_BLOCK_WORDS,
) -> DataFrame:
    """Per benchmark item its longest verbatim match over all shards: where it starts in the item, its length in
    words, the document and where it starts there (of equal ones the first by item word, document and its word)."""
    kind = docs.schema[id_col].dataType.simpleString()
    best = None
    for tests in _blocks(benchmark, "text", item_id, limit):
        sent = docs.sparkSession.sparkContext.broadcast(tests)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            tests = sent.value
            lengths, item = tests.windows()
            for batch in batches:
                ids, column = batch.column(0), batch.column(1)
                for low, _, w in tb.tokenized(column, tb.ALNUM, tb.LOWER, SHARD_BYTES):
                    s, owner = _stretches(w, tests, 1) if len(tests.known) else (np.zeros(0, np.int64),) * 2
                    if not len(s):
                        continue
                    found = search(s, tests, lengths)
                    some = np.flatnonzero(found.longest)
                    # One suffix per item: the longest match, the first of equal ones.
                    order = np.lexsort((some, -found.longest[some], item[some]))
                    top = some[order][np.unique(item[some][order], return_index=True)[1]]
                    word = owner[found.longest_place[top]]
                    row = np.searchsorted(w.first, word, "right") - 1
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([tests.ids[i] for i in item[top]], pa.string()),
                            pa.array(top - tests.first[item[top]], pa.int64()),
                            pa.array(found.longest[top], pa.int64()),
                            ids.take(pa.array(row + low)),
                            pa.array(word - w.first[row], pa.int64()),
                        ],
                        names=["item_id", "item_word", "length", id_col, "doc_word"],
                    )

        here = docs.select(id_col, F.col(text).cast("string").alias(text)).mapInArrow(
            run, LONGEST.format(id=f"`{id_col}`", type=kind)
        )
        best = here if best is None else best.unionByName(here)
    rank = F.struct(-F.col("length"), "item_word", id_col, "doc_word")
    return best.groupBy("item_id").agg(F.min(rank).alias("m")).select(
        "item_id", "m.item_word", (-F.col("m.col1")).alias("length"), f"m.{id_col}", "m.doc_word"
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `docs` that are not contaminated, with their columns."""
    placed, place, back = by_place(docs)
    return back(find_benchmark(placed, benchmark, place(text), keep_text=True).where(~F.col("contaminated")))


_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_FOLDED = "translate(coalesce({c}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_FOLDED.format(c="text")}, '{_WORD}') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({_FOLDED.format(c="text")}, '{_WORD}') AS w
      FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(list_slice(w, i, i + least(len(w), {WINDOW}) - 1), ' ') AS g
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
place AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
          FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
                FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id, place.n, i FROM place JOIN win ON place.g = win.g AND place.n = win.n),
words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hit)
          GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
          FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND {HIT_SHARE} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query("op5_decontamination", _SQL)
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_benchmark(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), "contaminated",
    )
