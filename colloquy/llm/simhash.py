"""SimHash near-duplicates by tiled exact comparison with exclusive-or and bit counts.

A text's fingerprint has a bit set where over half the XXH64 values of its 4-word shingles, repeats included, have it.
Documents of one fingerprint are one class; only distinct fingerprints are compared, and copies are never expanded.

The fingerprints are dealt to tiles. All of a tile have the same population count (number of set bits), and a count with
many fingerprints has several tiles, filled by hash, so the size of a tile is bounded whatever the texts. Two
fingerprints at a distance of at most RADIUS differ in their population counts by no more than that, so a pair of tiles
further apart is skipped; every other pair of tiles is a group of its own. Inside a group the same bound is applied to
the counts of the two halves, whose differences add up; what is left is compared by numpy, all of a block against all
of another.

Nothing is approximate: the bounds are necessary conditions, and what meets them is compared. Linked pairs are not
written. A group joins its members by the links it found and gives each member that has a partner the least one it
reaches, so what leaves a group is at most a row per fingerprint; the components of those edges are those of all links.
The work grows with the square of the distinct fingerprints, as the method does, divided by the tiles' bounds.

Defined cases: a text of fewer than four words has one shingle of them all; null, empty and blank texts have the
fingerprint zero, which is linked like any other; rows repeated as they are have one fingerprint and stay two rows; a null id
has a row, but its component gets the least id that is there, null if none is; an empty table gives an empty result; other
columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.llm import textbytes as tb
from colloquy.llm.arrowmap import with_columns
from colloquy.llm.components import components
from colloquy.llm.registry import query, table
from colloquy.operators.skew import lookup_join
from colloquy.session import materialize

SHINGLE = 4
SEED = 42
RADIUS = 4
BITS = 64
LANE_MOST = 255  # what a byte-wide lane can count
TILE_LEAST, TILE_MOST = 2_048, 131_072  # fingerprints of a tile
TILES = 32  # aimed at, where that keeps tiles within their bounds
BLOCK_PAIRS = 1 << 19  # comparisons of one numpy step

_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()

FINGERPRINT = T.StructType([T.StructField("fp", T.LongType())])


def _joined(w: tb.Words) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words one space apart, and where each starts and stops."""
    size = w.stop - w.start
    stop = np.cumsum(size + 1) - 1
    start = stop - size
    out = np.full(int(stop[-1]) + 1 if len(stop) else 0, 0x20, np.uint8)
    step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(start, size) + step] = w.data[np.repeat(w.start, size) + step]
    return out.tobytes(), start, stop


def _shingle_hashes(w: tb.Words) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of all shingles, and the number of the first one of each row (one more entry than rows)."""
    count = np.diff(w.first)
    runs = np.where(count >= SHINGLE, count - SHINGLE + 1, (count > 0).astype(count.dtype))
    first = np.concatenate([[0], np.cumsum(runs)])
    if not first[-1]:
        return np.zeros(0, np.uint64), first
    text, start, stop = _joined(w)
    row = np.repeat(np.arange(len(runs)), runs)
    low = w.first[:-1][row] + np.arange(first[-1]) - first[row]
    high = np.minimum(low + SHINGLE, w.first[1:][row]) - 1
    digest = xxhash.xxh64_intdigest
    hashes = (digest(text[a:b], SEED) for a, b in zip(start[low].tolist(), stop[high].tolist()))
    return np.fromiter(hashes, np.uint64, len(low)), first


def _bit_counts(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many of each row's hashes have each bit. A byte's bits are spread over eight byte-wide lanes, in which up to
    LANE_MOST hashes add up before they are carried on."""
    runs = np.diff(first)
    steps = -(-runs // LANE_MOST)
    begin = np.concatenate([[0], np.cumsum(steps)])
    row = np.repeat(np.arange(len(runs)), steps)
    start = first[:-1][row] + LANE_MOST * (np.arange(begin[-1]) - begin[row])
    lanes = np.add.reduceat(_SPREAD[h.view(np.uint8).reshape(-1, 8)], start, axis=0)
    some = np.flatnonzero(steps)
    counts = np.zeros((len(runs), BITS), np.int64)
    counts[some] = np.add.reduceat(lanes.view(np.uint8).reshape(-1, BITS), begin[some], axis=0, dtype=np.int64)
    return counts


def fingerprints(column: pa.Array) -> np.ndarray:
    """One fingerprint per text."""
    out = np.zeros(len(column), np.uint64)
    for low, high, w in tb.tokenized(column, tb.NON_SPACE, tb.LOWER):
        h, first = _shingle_hashes(w)
        if len(h):
            over = 2 * _bit_counts(h, first) > np.diff(first)[:, None]
            out[low:high] = np.packbits(over, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def _fingerprint_column(column: pa.Array) -> dict[str, pa.Array]:
    return {"fp": pa.array(fingerprints(column).view(np.int64), pa.int64())}


class _Joins:
    """Union of members 0..n-1; `least` leads to the least member that each reaches."""

    def __init__(self, n: int):
        self.least = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.least[a], self.least[b]
            apart = a != b
            a, b = a[apart], b[apart]
            if len(a):
                np.minimum.at(self.least, np.maximum(a, b), np.minimum(a, b))
            self.settle()

    def settle(self) -> None:
        while True:
            further = self.least[self.least]
            if (further == self.least).all():
                return
            self.least = further


def _cells(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of the fingerprints by the counts of their halves, the counts that occur, and where each begins."""
    counts = np.bitwise_count(fp.view(np.uint32).reshape(-1, 2)).astype(np.int16)
    order = np.lexsort(counts.T[::-1])
    counts = counts[order]
    new = np.ones(len(fp), bool)
    new[1:] = (counts[1:] != counts[:-1]).any(1)
    begin = np.flatnonzero(new)
    return order, counts[begin], np.append(begin, len(fp))


def compare(left: np.ndarray, right: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Joins the members of left (then of right) by the pairs within RADIUS, one of each side; without `right`, by those
    within left. Returns the members joined with a lesser one, and the least that each reaches."""
    n = len(left)
    joins = _Joins(n if right is None else n + len(right))
    order, counts, begin = _cells(left)
    values = left[order]
    if right is None:
        order2, counts2, begin2, values2 = order, counts, begin, values
    else:
        order2, counts2, begin2 = _cells(right)
        values2 = right[order2]
        order2 = order2 + n
    for c in range(len(counts)):
        after = c if right is None else 0
        near = np.flatnonzero(np.abs(counts2[after:] - counts[c]).sum(1) <= RADIUS) + after
        if not len(near):
            continue
        size = begin2[near + 1] - begin2[near]
        other = np.repeat(begin2[near] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        width = max(1, BLOCK_PAIRS // len(other))
        for low in range(begin[c], begin[c + 1], width):
            own = np.arange(low, min(low + width, begin[c + 1]))
            for start in range(0, len(other), BLOCK_PAIRS):
                part = other[start : start + BLOCK_PAIRS]
                at = np.flatnonzero(np.bitwise_count(values[own][:, None] ^ values2[part][None, :]) <= RADIUS)
                a, b = order[own[at // len(part)]], order2[part[at % len(part)]]
                apart = a != b
                joins.add(a[apart], b[apart])
    linked = np.flatnonzero(joins.least != np.arange(len(joins.least)))
    return linked, joins.least[linked]


EDGES = "u long, v long"


def _compare_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches hold rows (left, right, tile, fp) in the order of the groups (left, right)."""

    def finish(key, tiles: dict[int, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if key is None or (key[0] != key[1] and len(tiles) < 2):
            return
        sides = [np.concatenate(tiles[t]) for t in sorted(tiles)]
        fp = np.concatenate(sides).view(np.int64)
        who, least = compare(sides[0], sides[1] if len(sides) > 1 else None)
        u, v = fp[who], fp[least]
        if len(u):
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    key, tiles = None, {}
    for batch in batches:
        if not batch.num_rows:
            continue
        left, right, tile, fp = (batch.column(i).to_numpy() for i in range(4))
        new = np.ones(len(fp), bool)
        new[1:] = (left[1:] != left[:-1]) | (right[1:] != right[:-1]) | (tile[1:] != tile[:-1])
        begin = np.append(np.flatnonzero(new), len(fp))
        for low, high in zip(begin[:-1], begin[1:]):
            now = (int(left[low]), int(right[low]))
            if now != key:
                yield from finish(key, tiles)
                key, tiles = now, {}
            tiles.setdefault(int(tile[low]), []).append(fp[low:high].astype(np.int64).view(np.uint64))
    yield from finish(key, tiles)


def links(classes: DataFrame) -> DataFrame:
    """Edges (u, v) between the fingerprints `fp` of `classes` (each there once) whose components are those of all
    pairs within RADIUS."""
    counted = classes.withColumn("pop", F.bit_count("fp").cast("int"))
    sizes = {r.pop: r.n for r in counted.groupBy("pop").agg(F.count(F.lit(1)).alias("n")).collect()}  # BITS + 1 at most
    if not sizes:
        return classes.sparkSession.createDataFrame([], EDGES)
    size = min(max(sum(sizes.values()) // TILES, TILE_LEAST), TILE_MOST)
    tiles = {p: -(-n // size) for p, n in sizes.items()}
    first, total = {}, 0
    for p in sorted(tiles):
        first[p] = total
        total += tiles[p]
    # by population count: its first tile, its tiles, and the tiles from the first to the last that may hold partners
    rows = []
    for p in sorted(tiles):
        near = [q for q in tiles if abs(q - p) <= RADIUS]
        rows.append((p, first[p], tiles[p], first[min(near)], first[max(near)] + tiles[max(near)] - 1))
    plan = classes.sparkSession.createDataFrame(rows, "pop int, first int, tiles int, low int, high int")
    dealt = counted.join(F.broadcast(plan), "pop").select(
        "fp", "low", "high",
        (F.col("first") + F.pmod(F.xxhash64("fp"), F.col("tiles"))).cast("int").alias("tile"),
    )
    pairs = dealt.withColumn("other", F.explode(F.sequence("low", "high"))).select(
        F.least("tile", "other").alias("left"), F.greatest("tile", "other").alias("right"), "tile", "fp"
    )
    ordered = pairs.repartition("left", "right").sortWithinPartitions("left", "right", "tile")
    return ordered.mapInArrow(_compare_groups, EDGES)


def simhash_components(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """A row per document: its id, `fp` (long, the 64 bits), component_id (the least id reachable over links)."""
    source = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"))
    rows = materialize(with_columns(source, "_text", _fingerprint_column, FINGERPRINT), "fingerprints")
    classes = rows.groupBy("fp").agg(F.min("_id").alias("least"), F.count(F.lit(1)).alias("_n"))
    classes = materialize(classes, "fingerprint-classes")
    roots = components(links(classes.select("fp")))
    placed = classes.join(roots, classes.fp == roots.node, "left").select(
        "fp", "least", "_n", F.coalesce("root", "fp").alias("root")
    )
    placed = materialize(placed, "fingerprint-roots")
    best = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = lookup_join(placed.select("fp", "root"), best, ["root"]).select("fp", "component_id")
    return lookup_join(rows, named, ["fp"], sizes=classes).select(F.col("_id").alias(id_col), "fp", "component_id")


@query("op11_simhash_near_dedup")
def op11_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
