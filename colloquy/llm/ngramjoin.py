"""Near-duplicate join on five-word shingles with a MinHash LSH forest and exact verification.

Texts with equal sets of shingles are one class, found by a 128-bit hash of the set; only classes go on, and copies are
never expanded. A class has a signature of TREES labels of MAX_DEPTH min-hashes, 16 bits
of each. The labels of one tree, sorted, are a
prefix trie; two classes match at depth d if they meet in a node of depth d of any trie. A link of similarity s meets with
probability 1 - (1 - s^d)^TREES; the join uses the greatest depth at which links of the least similarity, the hardest to
find, reach RECALL. So no link is less likely to be found because many others are more alike.

Verification is exact. Classes that meet are brought together by connected components of the tries' nodes (each member
linked to the least one, so edges grow with members, not pairs). A component is cut into blocks of bounded size, and
every pair of blocks is a group of its own, so no task holds more than two blocks however large the component is. In a
group the pairs that meet are found on signatures and their Jaccard similarity is counted on the shingles; what leaves
the group is a row per class: its links and its least partner. Pairs are never written.

Defined cases: a text of fewer than five words, but not none, is one shingle; null, empty and blank texts have no
shingles, match nothing and are classes of their own; rows repeated with the same id and text are copies; a null id ranks
after all others; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.llm import textbytes as tb
from colloquy.llm.arrowmap import by_place, with_columns
from colloquy.llm.components import components
from colloquy.llm.registry import query, table
from colloquy.session import materialize

SHINGLE = 5
SIMILAR = (4, 5)  # at least 4/5
TREES = 24
MAX_DEPTH = 8
RECALL = 0.9999
BLOCK_CLASSES = 1_024
BLOCK_SHINGLES = 2_000_000
FILTER_SLOTS = 1 << 20
BINS = 20  # of similarity between the threshold and 1

SIGNED = T.StructType(
    [
        T.StructField("n_shingles", T.LongType()),
        T.StructField("key", T.BinaryType()),
        T.StructField("signature", T.BinaryType()),
    ]
)


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(5)
    n = TREES * MAX_DEPTH
    return rng.integers(0, 1 << 31, n, np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, n, np.uint32)


_A, _B = _multipliers()


def _shingle_sets(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, shingles, first shingle of each row): sorted and unique within a row."""
    for low, high, w in tb.tokenized(column, tb.NON_SPACE, tb.SAME):
        h, first = tb.window_hash(w.hash, w.first, SHINGLE)
        row = np.repeat(np.arange(high - low), np.diff(first))
        order = np.lexsort((h, row))
        h = h[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])  # rows keep their places
        yield low, high, h[new], np.searchsorted(row[new], np.arange(high - low + 1))


def _fixed(values: np.ndarray, some: np.ndarray) -> pa.Array:
    """Rows of bytes; null where not `some`."""
    width = values.shape[1] * values.itemsize
    data = pa.py_buffer(np.ascontiguousarray(values))
    offsets = pa.py_buffer(np.concatenate([[0], np.cumsum(np.where(some, width, 0))]).astype(np.int32))
    mask = pa.py_buffer(np.packbits(some, bitorder="little"))
    return pa.Array.from_buffers(pa.binary(), len(some), [mask, offsets, data])


def _set_key(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """128 bits of the sets that `first` delimits in `h`; none is empty."""
    parts = [np.add.reduceat(tb.mix(h ^ np.uint64(c)), first) for c in (0x243F6A8885A308D3, 0x13198A2E03707344)]
    return np.ascontiguousarray(np.stack(parts, 1)).view(np.uint8).reshape(len(first), 16)


def _sign(column: pa.Array) -> dict[str, pa.Array]:
    counts, keys, signatures = [], [], []
    for low, high, h, first in _shingle_sets(column):
        size = np.diff(first)
        counts.append(size)
        some = first[:-1][size > 0]
        if not len(some):
            continue
        keys.append(_set_key(h, some))
        short = (h >> np.uint64(32)).astype(np.uint32)
        signature = np.empty((len(some), TREES * MAX_DEPTH), np.uint16)
        for k in range(TREES * MAX_DEPTH):
            signature[:, k] = np.minimum.reduceat(short * _A[k] + _B[k], some) & np.uint32(0xFFFF)
        signatures.append(signature)
    n = np.concatenate(counts) if counts else np.zeros(len(column), np.int64)
    key = np.concatenate(keys) if keys else np.zeros((0, 16), np.uint8)
    signature = np.concatenate(signatures) if signatures else np.zeros((0, TREES * MAX_DEPTH), np.uint16)
    return {"n_shingles": pa.array(n, pa.int64()), "key": _fixed(key, n > 0), "signature": _fixed(signature, n > 0)}


def _prefixes(signatures: list[bytes], depth: int) -> np.ndarray:
    """Hashes of the prefixes of all labels: a row per class, a column per tree."""
    labels = np.frombuffer(b"".join(signatures), np.uint16).reshape(-1, TREES, MAX_DEPTH)[:, :, :depth]
    out = np.zeros(labels.shape[:2], np.uint64)
    for k in range(depth):
        out = tb.mix(out + labels[:, :, k].astype(np.uint64) + np.uint64(1))
    return out


@dataclass
class _Group:
    """Classes of one group as they arrive."""

    key: tuple
    nodes: list
    blocks: list
    signatures: list
    sets: list


def _verify(g: _Group, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes, their links, and the least node each is linked with through the group. Pairs count that meet at `depth`."""
    cluster, left, right = g.key
    m = len(g.nodes)
    node, block = np.array(g.nodes, np.int64), np.array(g.blocks, np.int64)
    now = _prefixes(g.signatures, depth)
    size = np.array([len(s) for s in g.sets])
    first = np.concatenate([[0], np.cumsum(size)])
    flat = np.unique(np.concatenate(g.sets), return_inverse=True)[1]
    marked = np.zeros(int(flat.max()) + 1, bool)
    links = np.zeros(m, np.int64)
    least = node.copy()
    num, den = SIMILAR
    for i in range(m):
        rest = slice(i + 1, m)
        meet = (now[rest] == now[i]).any(1)
        if left != right:
            meet &= block[rest] != block[i]
        other = np.flatnonzero(meet) + i + 1
        # A set that is too small or too large cannot be similar enough.
        other = other[(den * np.minimum(size[other], size[i]) >= num * np.maximum(size[other], size[i]))]
        if not len(other):
            continue
        own = flat[first[i] : first[i + 1]]
        marked[own] = True
        count = size[other]
        index = np.repeat(first[other] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        common = np.add.reduceat(marked[flat[index]].astype(np.int64), np.cumsum(count) - count)
        marked[own] = False
        union = count + size[i] - common
        good = den * common >= num * union
        other = other[good]
        if not len(other):
            continue
        links[i] += len(other)
        links[other] += 1
        joined = np.unique(least[np.append(other, i)])
        if len(joined) > 1:
            least[np.isin(least, joined)] = joined[0]
    return node, links, least


VERIFIED = "node long, links long, least long"


def _verify_groups(depth: int):
    def finish(g: _Group | None) -> Iterator[pa.RecordBatch]:
        if g is None or len(g.nodes) < 2:
            return
        node, links, least = _verify(g, depth)
        some = np.flatnonzero(links)
        if not len(some):
            return
        yield pa.RecordBatch.from_arrays(
            [pa.array(node[some]), pa.array(links[some]), pa.array(least[some])], names=["node", "links", "least"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = None
        for batch in batches:
            column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            ids = [column[c].to_pylist() for c in ("cluster", "left", "right", "node", "block", "key", "signature")]
            for low, high, h, first in _shingle_sets(column["text"]):
                for r in range(low, high):
                    cluster, left, right, node, block, key, signature = (x[r] for x in ids)
                    own = h[first[r - low] : first[r - low + 1]]
                    # An id that stands for several texts brings them all; the class's own is known by its key.
                    if not len(own) or _set_key(own, np.zeros(1, np.int64)).tobytes() != key:
                        continue
                    if group is None or group.key != (cluster, left, right):
                        yield from finish(group)
                        group = _Group((cluster, left, right), [], [], [], [])
                    if group.nodes and group.nodes[-1] == node:
                        continue
                    group.nodes.append(node)
                    group.blocks.append(block)
                    group.signatures.append(signature)
                    group.sets.append(own.copy())
        yield from finish(group)

    return run


def _meeting(classes: DataFrame, depth: int) -> DataFrame:
    """Edges (u, v) from every class that meets others at `depth` to the least one of its node in each tree."""
    width = 2 * MAX_DEPTH
    places = classes.select(
        "node",
        F.explode(
            F.expr(
                f"transform(sequence(0, {TREES - 1}), t -> xxhash64(t, substring(signature, t * {width} + 1, {2 * depth})))"
            )
        ).alias("place"),
    )
    hubs = places.groupBy("place").agg(F.min("node").alias("v"), F.max("node").alias("top")).where("v < top")
    hubs = materialize(hubs.select("place", "v"), "hubs")
    return places.join(hubs, "place").where("node <> v").select(F.col("node").alias("u"), "v").distinct()


def _asked(texts: DataFrame, placed: DataFrame) -> DataFrame:
    """The rows of `texts` whose id may be in `placed`, so that other texts are not shuffled: ids share FILTER_SLOTS
    slots, and the table of used slots is never larger than that."""

    def slot(c: str) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(FILTER_SLOTS)).alias("_slot")

    used = F.broadcast(placed.select(slot("doc")).distinct())
    return texts.withColumn("_slot", slot("_id")).join(used, "_slot", "left_semi").drop("_slot")


def _linked(texts: DataFrame, classes: DataFrame, depth: int) -> DataFrame:
    """Links between classes that meet at `depth`."""
    cluster = components(_meeting(classes, depth)).withColumnRenamed("root", "cluster")
    member = materialize(classes.join(cluster, "node"), "members")
    blocks = member.groupBy("cluster").agg(
        F.ceil(
            F.greatest(F.count(F.lit(1)) / F.lit(BLOCK_CLASSES), F.sum("n_shingles") / F.lit(BLOCK_SHINGLES))
        ).cast("long").alias("blocks")
    )
    placed = member.join(blocks, "cluster").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    # A class joins the pairs of its block with each block: as many copies as its component has blocks, mostly one.
    paired = placed.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)"))).select(
        "cluster", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"),
        "node", "block", "key", "signature", "doc",
    )
    full = paired.join(_asked(texts, placed), F.col("_id").eqNullSafe(F.col("doc"))).drop("_id", "doc")
    ordered = full.repartition("cluster", "left", "right").sortWithinPartitions("cluster", "left", "right", "node")
    return ordered.mapInArrow(_verify_groups(depth), VERIFIED)


def _meets(similarity: float, depth: int) -> float:
    return 1 - (1 - similarity**depth) ** TREES


def next_depth(bins: np.ndarray, depth: int, recall: float = RECALL) -> int:
    """The greatest depth whose estimated recall reaches `recall`, given the links by similarity found at `depth`."""
    low = SIMILAR[0] / SIMILAR[1]
    similarity = low + (1 - low) * np.minimum(np.arange(BINS + 1) / BINS, 1)
    there = bins / np.array([_meets(s, depth) for s in similarity])
    for d in range(depth, 1, -1):
        if (there * [_meets(s, d) for s in similarity]).sum() >= recall * there.sum():
            return d
    return 1


def sure_depth(recall: float = RECALL) -> int:
    """The greatest depth at which even links of the least similarity reach `recall`."""
    least = np.zeros(BINS + 1)
    least[0] = 1
    return next_depth(least, MAX_DEPTH, recall)


@dataclass
class Joined:
    """rows: doc_id, text hash, key per document. classes: node, key, doc (its least id), th, copies. links: node,
    links. roots: node, root of the linked classes."""

    rows: DataFrame
    classes: DataFrame
    links: DataFrame
    roots: DataFrame


def similarity_join(docs: DataFrame, text: str = "text", id_col: str = "doc_id", recall: float = RECALL) -> Joined:
    """All links between texts whose sets of shingles have a Jaccard similarity of at least SIMILAR."""
    source = docs.select(
        F.col(id_col).alias("_id"), F.xxhash64(text).alias("_th"), F.col(text).cast("string").alias("text")
    )
    rows = materialize(with_columns(source, "text", _sign, SIGNED), "signed")
    least = F.min(F.struct(F.col("_id").isNull().alias("null"), "_id", "_th"))
    grouped = rows.where(F.col("key").isNotNull()).groupBy("key").agg(
        least.alias("at"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n_shingles"),
        F.first("signature").alias("signature"),
    )
    classes = materialize(
        grouped.select(
            F.monotonically_increasing_id().alias("node"), "key", F.col("at._id").alias("doc"),
            F.col("at._th").alias("th"), "copies", "n_shingles", "signature",
        ),
        "classes",
    )
    texts = source.select("_id", "text")
    found = materialize(_linked(texts, classes, sure_depth(recall)), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("u"), F.col("least").alias("v")))
    return Joined(rows.drop("signature"), classes.drop("signature"), links, roots)


def _classed(joined: Joined) -> DataFrame:
    """Per class: key, copies, links, and doc and th of the least document of its group."""
    rank = F.struct(F.col("doc").isNull().alias("null"), "doc", "th")
    member = joined.classes.join(joined.roots, "node")
    group = member.groupBy("root").agg(F.min(rank).alias("best"))
    linked = joined.roots.join(group, "root").join(joined.links, "node").select("node", "best", "links")
    return joined.classes.join(linked, "node", "left").select(
        "key", "copies", F.coalesce("links", F.lit(0)).alias("n_links"),
        F.coalesce(F.col("best.doc"), F.col("doc")).alias("class_id"),
        F.coalesce(F.col("best.th"), F.col("th")).alias("class_th"),
    )


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """A row per document: its id, class_id (the least id of its group of copies and similar texts), n_copies (rows with
    the same shingles, itself included) and n_links (other classes of copies that are similar enough)."""
    joined = similarity_join(docs, text, id_col)
    classed = materialize(_classed(joined), "classed")
    some = joined.rows.where(F.col("key").isNotNull()).select("_id", "key").join(classed, "key")
    none = joined.rows.where(F.col("key").isNull())
    return some.select(
        F.col("_id").alias(id_col), "class_id", F.col("copies").alias("n_copies"), "n_links"
    ).unionByName(
        none.select(F.col("_id").alias(id_col), F.col("_id").alias("class_id"), F.lit(1).cast("long").alias("n_copies"),
                    F.lit(0).cast("long").alias("n_links"))
    )


def drop_near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row of `docs` per group, that with the least id; texts without words stay."""
    joined = similarity_join(docs, text, id_col)
    classed = _classed(joined).select(F.col("class_id").alias("_id"), F.col("class_th").alias("_th")).distinct()
    blank = joined.rows.where(F.col("key").isNull()).select("_id", "_th").distinct()
    kept = materialize(classed.unionByName(blank), "kept")
    placed, place, back = by_place(docs)
    out = placed.withColumn("_h", F.xxhash64(place(text))).join(
        kept, F.col(place(id_col)).eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_th")), "left_semi"
    )
    if joined.rows.groupBy("_id", "_th").count().where("count > 1").limit(1).count():
        out = out.dropDuplicates([place(id_col), "_h"])  # rows repeated as they are
    return back(out)


@query("op3_ngram_jaccard_join")
def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
