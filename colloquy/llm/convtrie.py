"""Conversation prefix trie: which beginnings conversations share, and what storing each once would save.

A conversation is rebuilt from the first turns of the one its id is grouped with and its own further turns. The nodes of
the trie are the distinct beginnings of rebuilt conversations.

Equal conversations are one class. A class is sorted by its path: the turns, as 128-bit hashes of all turns up to there,
at which other classes part from it. Turns that every class of the beginning shares are left out, so a path has as many
entries as its conversation has branching nodes, and the paths of all classes have no more than the turns. In that order
the longest common beginning (LCP) of neighbours says where they part.

The sorted classes lie in range partitions. In each, union-find takes the edges between neighbours by falling LCP; every
merge of components creates a branching node, or completes the class that ends there. What does not touch a border of
the partition is complete and is written. The rest, the nodes above the first and the last class, is contracted to one entry a node with
the sums of its complete children; these few entries a partition are merged in the same way by one task, the LCP of
neighbouring partitions' border classes being the edges between them. Nodes with one child need no merge: they are listed from
the edges of this tree.

Defined cases: rows without a conv_id go; a null turn is the first, a null role or text is empty; turns with equal numbers
are ordered by role and text, repeated rows are turns like others; conversations without turns end at the root; no
conversations give an empty result; other columns are not looked at. A conversation, a class of equal ones or a first turn may
hold any share of the rows: places and running values are cut into segments, copies are counted map-side, and of ids only
their joined text, in pieces, comes together to be hashed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm.registry import query, table
from colloquy.operators.skew import lookup_join, running, with_position, with_segments
from colloquy.session import materialize

SHARED_MOST = 5  # turns taken over from the conversation of the hundred
PART_CLASSES = 20_000  # sorted classes of one task
EMPTY_DIGEST = hashlib.sha256(b"").hexdigest()


def _shared(conv: Column) -> Column:
    return (F.crc32(conv.cast("string").cast("binary")) % (SHARED_MOST + 1)).cast("int")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv, d, role, text): the turns of every rebuilt conversation, d from 1; and a row with d = 0 for each."""
    named = conversations.select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).where("conv IS NOT NULL")
    turns = materialize(with_position(named, ["conv"], ["turn", "role", "text"], "pos").drop("turn"), "turns")
    conv = F.col("conv")
    convs = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("turns"))
    asked = convs.select(
        conv, (conv - conv % 100).alias("first"), _shared(conv).alias("h")
    )
    heads = turns.where((conv % 100 == 0) & (F.col("pos") <= SHARED_MOST)).withColumnRenamed("conv", "first")
    taken = asked.join(heads, "first").where("pos <= h").select("conv", F.col("pos").alias("d"), "role", "text")
    counts = heads.groupBy("first").agg(F.count(F.lit(1)).alias("there"))
    own = turns.withColumns({"h": _shared(conv), "first": conv - conv % 100}).where("pos > h")
    rest = lookup_join(own, counts, ["first"]).select(
        "conv", (F.col("pos") - F.col("h") + F.least("h", F.coalesce("there", F.lit(0)))).alias("d"), "role", "text"
    )
    none = convs.select("conv", F.lit(0).cast("long").alias("d"), F.lit("").alias("role"), F.lit("").alias("text"))
    return taken.unionByName(rest).unionByName(none)


def _numbered(turns: DataFrame) -> DataFrame:
    """(conv, d, h1, h2, size, upto): two hashes of all turns up to d, the code points of the text, and those of all texts
    up to d. Both hashes are 0 at d = 0."""
    some = F.col("d") > 0
    hashed = turns.select(
        "conv", "d", F.length("text").cast("long").alias("size"),
        F.when(some, F.xxhash64("d", "role", "text")).otherwise(F.lit(0)).alias("g1"),
        F.when(some, F.xxhash64(F.lit("b"), "text", "d", "role")).otherwise(F.lit(0)).alias("g2"),
    )
    seg = with_segments(hashed, ["conv"], ["d"])
    measures = {"h1": ("xor", F.col("g1")), "h2": ("xor", F.col("g2")), "upto": ("sum", F.col("size"))}
    return running(seg, ["conv"], ["d"], measures).select("conv", "d", "h1", "h2", "size", "upto")


def _digests(ends: DataFrame, classes: DataFrame) -> DataFrame:
    """(ends, digest): the SHA-256 of the ids of each class, ascending and comma-joined."""
    one = classes.where("copies = 1").select("conv", F.sha2(F.col("conv").cast("string"), 256).alias("digest"))
    more = classes.where("copies > 1").select("d", "h1", "h2", F.col("conv").alias("class"), F.col("copies").alias("_n"))
    keys = ["d", "h1", "h2"]
    members = lookup_join(ends, more.drop("_n"), keys, "inner", sizes=more).select("class", "conv")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            who, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            begin = [i for i in range(len(who)) if not i or who[i] != who[i - 1]] + [len(who)]
            runs = [(a, b) for a, b in zip(begin, begin[1:]) if b > a]
            yield pa.RecordBatch.from_arrays(
                [pa.array([who[a] for a, _ in runs], pa.int64()), pa.array([ids[a] for a, _ in runs], pa.int64()),
                 pa.array([",".join(map(str, ids[a:b])) for a, b in runs], pa.string())],
                names=["class", "first", "ids"],
            )

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([now], pa.int64()), pa.array([state.hexdigest()], pa.string())], names=["conv", "digest"]
            )

        for batch in batches:
            for who, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                if who != now:
                    if now is not None:
                        yield done()
                    now, state = who, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.as_buffer())
        if now is not None:
            yield done()

    cut = members.repartitionByRange("class", "conv").sortWithinPartitions("class", "conv").mapInArrow(
        pieces, "class long, first long, ids string"
    )
    whole = cut.repartition("class").sortWithinPartitions("class", "first").select("class", "ids")
    return one.unionByName(whole.mapInArrow(hashed, "conv long, digest string")).withColumnRenamed("conv", "ends")


def _paths(numbered: DataFrame, classes: DataFrame, total: int) -> DataFrame:
    """(conv, path): for each class the (d, h1, h2, code points before) at which others part from it."""
    keys = ["d", "h1", "h2"]
    own = lookup_join(numbered.where("d > 0"), classes.select("conv"), ["conv"], "left_semi")
    nodes = materialize(own.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), "beginnings")
    shared = lookup_join(own, nodes.select(*keys, F.col("_n").alias("among")), keys, "inner", sizes=nodes)
    part = F.min(F.struct("d", "h1", "h2", (F.col("upto") - F.col("size")).alias("before"))).alias("part")
    parts = shared.where(F.col("among") < total).groupBy("conv", "among").agg(part)
    return parts.groupBy("conv").agg(F.sort_array(F.collect_list("part")).alias("path"))


@dataclass
class _Node:
    """A node and what is known below it: `at` is the code points up to `depth`; `n`, `least`, `kids`, `leaves` and `saved`
    are sums over its children so far, with the class that ends here."""

    depth: int
    at: int
    n: int = 0
    least: int | None = None
    kids: int = 0
    leaves: int = 0
    saved: int = 0
    ends: int | None = None
    parent: int = -1

    def count(self, n: int, least: int | None) -> None:
        self.n += n
        if least is not None:
            self.least = least if self.least is None else min(self.least, least)

    def adopt(self, child: _Node) -> None:
        self.count(child.n, child.least)
        self.kids += 1
        self.leaves += child.leaves if child.kids else 1
        self.saved += child.saved + (child.n - 1) * (child.at - self.at)

    def absorb(self, same: _Node) -> None:
        self.count(same.n, same.least)
        self.kids += same.kids
        self.leaves += same.leaves
        self.saved += same.saved
        self.ends = same.ends if self.ends is None else self.ends


def _find(link: list[int], i: int) -> int:
    while link[i] != i:
        link[i] = link[link[i]]
        i = link[i]
    return i


def grow(nodes: list[_Node], edges: list[tuple[int, int]]) -> list[int]:
    """Joins `nodes`, which lie in order, by the edges (LCP, code points up to it) between neighbours, deepest first.
    Appends the branching nodes that are made and sets parents; returns for each node the one it was absorbed by."""
    same = list(range(len(nodes)))
    component = list(range(len(nodes)))
    top = list(range(len(nodes)))  # of a component's root

    def under(parent: int, child: int) -> None:
        nodes[child].parent = parent
        nodes[parent].adopt(nodes[child])

    for i in sorted(range(len(edges)), key=lambda i: (-edges[i][0], i)):
        depth, at = edges[i]
        left, right = _find(component, i), _find(component, i + 1)
        a, b = top[left], top[right]
        if nodes[a].depth == depth and nodes[b].depth == depth:
            nodes[a].absorb(nodes[b])
            same[b] = a
        elif nodes[a].depth == depth:
            under(a, b)
        elif nodes[b].depth == depth:
            under(b, a)
            a = b
        else:
            nodes.append(_Node(depth, at))
            same.append(len(nodes) - 1)
            under(len(nodes) - 1, a)
            under(len(nodes) - 1, b)
            a = len(nodes) - 1
        component[right] = left
        top[left] = a
    return same


PATH = pa.list_(pa.struct([("d", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("before", pa.int64())]))
FIELDS = [
    ("part", pa.int64()), ("item", pa.int64()),  # of a contracted entry; else of the entry that is the parent
    ("entry", pa.bool_()), ("complete", pa.bool_()), ("conv", pa.int64()), ("depth", pa.int64()), ("at", pa.int64()),
    ("n", pa.int64()), ("kids", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64()), ("ends", pa.int64()),
    ("parent_depth", pa.int64()), ("parent_conv", pa.int64()), ("path", PATH),
]
GROWN = ", ".join(
    f"{name} {'boolean' if kind == pa.bool_() else 'long' if kind == pa.int64() else 'array<struct<d:long,h1:long,h2:long,before:long>>'}"
    for name, kind in FIELDS
)
ROWS = 8_192


def _batches(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), ROWS):
        columns = zip(*rows[at : at + ROWS])
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, kind) for c, (_, kind) in zip(columns, FIELDS)], names=[name for name, _ in FIELDS]
        )


def _lcp(left: list[dict], right: list[dict]) -> tuple[int, int]:
    """How many turns two neighbouring classes share, the right one being the later, and their code points."""
    for a, b in zip(left, right):
        if a != b:
            return b["d"] - 1, b["before"]
    b = right[len(left)]
    return b["d"] - 1, b["before"]


def _row(node: _Node, **more) -> tuple:
    values = {
        "complete": True, "entry": False, "conv": node.least, "depth": node.depth, "at": node.at, "n": node.n,
        "kids": node.kids, "leaves": node.leaves if node.kids else 1, "saved": node.saved, "ends": node.ends,
    } | more
    return tuple(values.get(name) for name, _ in FIELDS)


def _climb(nodes: list[_Node], i: int) -> list[int]:
    path = [i]
    while nodes[path[-1]].parent >= 0:
        path.append(nodes[path[-1]].parent)
    return path


def _partition_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted classes (conv, copies, depth, at, path) -> complete nodes and contracted entries."""
    nodes, edges, first, last = [], [], None, None
    for batch in batches:
        for conv, copies, depth, at, path in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if last is None:
                first = path
            else:
                edges.append(_lcp(last, path))
            last = path
            nodes.append(_Node(depth, at, copies, conv, ends=conv))
    if not nodes:
        return
    place, m = TaskContext.get().partitionId(), len(nodes)
    classes = [(node.n, node.least) for node in nodes]
    grow(nodes, edges)
    left, right = _climb(nodes, 0), _climb(nodes, m - 1)
    spine = left + right[:-1][::-1]
    item = {node: k for k, node in enumerate(spine)}
    entries = [_Node(nodes[i].depth, nodes[i].at, ends=nodes[i].ends) for i in spine]
    for k, i in enumerate(spine):
        if i < m:
            entries[k].count(*classes[i])
    rows = []
    for i, node in enumerate(nodes):
        if i in item:
            continue
        above = node.parent
        if above in item:
            entries[item[above]].adopt(node)
            rows.append(_row(node, part=place, item=item[above], parent_depth=nodes[above].depth))
        else:
            rows.append(_row(node, parent_depth=nodes[above].depth, parent_conv=nodes[above].least))
    for k, entry in enumerate(entries):
        path = first if not k else last if k == len(entries) - 1 else None
        rows.append(_row(entry, complete=False, entry=True, part=place, item=k, leaves=entry.leaves, path=path))
    yield from _batches(rows)


def _merged_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contracted entries by part and item -> the nodes they make, and which of them each entry is."""
    rows = [r for batch in batches for r in batch.to_pylist()]
    if not rows:
        return
    nodes, edges, ended = [], [], None
    for before, r in zip([None, *rows], rows):
        node = _Node(r["depth"], r["at"], r["n"], r["conv"], r["kids"], r["leaves"], r["saved"], r["ends"])
        if before and before["part"] == r["part"]:
            edges.append(min((nodes[-1].depth, nodes[-1].at), (node.depth, node.at)))
        elif before:
            edges.append(_lcp(ended, r["path"]))
        if r["path"] is not None:  # of a partition's first and last entry, which may be one
            ended = r["path"]
        nodes.append(node)
    same = grow(nodes, edges)
    out = []
    for i, node in enumerate(nodes):
        if same[i] != i:
            continue
        above = nodes[_find(same, node.parent)] if node.parent >= 0 else None
        out.append(_row(node, parent_depth=above.depth if above else -1, parent_conv=above.least if above else None))
    for i, r in enumerate(rows):
        out.append(_row(nodes[_find(same, i)], complete=False, entry=True, part=r["part"], item=r["item"]))
    yield from _batches(out)


def _tree(classes: DataFrame, paths: DataFrame, total: int) -> DataFrame:
    """(conv, depth, at, n, kids, leaves, saved, ends, parent_depth, parent_conv) of every branching or ending node, and of
    the topmost one."""
    none = F.from_json(F.lit("[]"), "array<struct<d:long,h1:long,h2:long,before:long>>")
    placed = classes.join(paths, "conv", "left").select(
        "conv", "copies", F.col("d").alias("depth"), F.col("upto").alias("at"), F.coalesce("path", none).alias("path")
    )
    ordered = placed.repartitionByRange(-(-total // PART_CLASSES), "path").sortWithinPartitions("path")
    grown = materialize(ordered.mapInArrow(_partition_forest, GROWN), "forests")
    entries = grown.where("entry").repartition(1).sortWithinPartitions("part", "item")
    merged = materialize(entries.mapInArrow(_merged_forest, GROWN), "merged-forest")
    columns = ["conv", "depth", "at", "n", "kids", "leaves", "saved", "ends", "parent_depth", "parent_conv"]
    known = merged.where("entry").select("part", "item", F.col("conv").alias("found"))
    complete = grown.where("complete").join(known, ["part", "item"], "left").withColumn(
        "parent_conv", F.coalesce("parent_conv", "found")
    )
    return complete.select(*columns).unionByName(merged.where("complete").select(*columns))


COLUMNS = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row per node: COLUMNS."""
    numbered = materialize(_numbered(rebuilt(conversations)), "numbered-turns")
    last = F.max(F.struct("d", "h1", "h2", "upto")).alias("last")
    ends = materialize(numbered.groupBy("conv").agg(last).select("conv", "last.*"), "ends")
    classes = materialize(
        ends.groupBy("d", "h1", "h2").agg(
            F.min("conv").alias("conv"), F.count(F.lit(1)).alias("copies"), F.first("upto").alias("upto")
        ),
        "conversation-classes",
    )
    total = classes.count()
    if not total:
        return conversations.sparkSession.createDataFrame([], COLUMNS)
    tree = _tree(classes, _paths(numbered, classes, total), total)
    listed = tree.withColumn("d", F.explode(F.sequence(F.col("parent_depth") + 1, "depth")))
    sized = listed.join(numbered.select("conv", "d", "size", "upto"), ["conv", "d"])
    whole = sized.join(_digests(ends, classes), "ends", "left")
    here, first = F.col("d") == F.col("depth"), F.col("d") == F.col("parent_depth") + 1
    return whole.select(
        F.col("conv").alias("conv_id"), F.col("d").alias("depth"),
        F.when(first, F.col("parent_conv")).otherwise(F.col("conv")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(here, F.col("kids")).otherwise(1).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("saved") + (F.col("n") - 1) * (F.col("at") - F.col("upto") + F.col("size"))).alias("saved_tokens"),
        F.when(here & F.col("digest").isNotNull(), F.col("digest")).otherwise(EMPTY_DIGEST).alias("ends_sha256"),
    )


ORACLE = """
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT c, c - c % 100 AS p, CAST(xor(list_reduce(
      list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: ascii(x)::UBIGINT)),
      lambda v, b: list_reduce(list_prepend(xor(v, b), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]),
                               lambda y, z: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384::UBIGINT) ELSE y // 2 END)
    ), 4294967295::UBIGINT) % 6 AS BIGINT) AS h
  FROM (SELECT DISTINCT c FROM t)
), taken AS (
  SELECT ids.c, t.pos AS d, role, text FROM ids JOIN t ON t.c = ids.p AND t.pos <= ids.h
), there AS (
  SELECT ids.c, ids.h, count(taken.d) AS k FROM ids LEFT JOIN taken ON taken.c = ids.c GROUP BY 1, 2
), r AS (
  SELECT * FROM taken
  UNION ALL
  SELECT t.c, t.pos - there.h + there.k, role, text FROM t JOIN there ON there.c = t.c WHERE t.pos > there.h
  UNION ALL
  SELECT c, 0, '', '' FROM ids
), path AS (
  SELECT c, d, length(text) AS size, md5(string_agg(length(role) || ':' || role || length(text) || ':' || text, ';')
         OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING)) AS k
  FROM r
), node AS (
  SELECT k, d, min(c) AS c, count(*) AS n, any_value(size) AS size FROM path GROUP BY 1, 2
), up AS (
  SELECT node.k, node.d, node.c, node.n, node.size, path.k AS pk FROM node LEFT JOIN path ON path.c = node.c AND path.d = node.d - 1
), kids AS (
  SELECT pk AS k, count(*) AS kids FROM up WHERE pk IS NOT NULL GROUP BY 1
), below AS (
  SELECT path.k, path.d, sum((node.n - 1) * node.size) AS saved, count(*) FILTER (kids.kids IS NULL) AS leaves
  FROM node JOIN path ON path.c = node.c AND path.d <= node.d LEFT JOIN kids ON kids.k = node.k GROUP BY 1, 2
), ended AS (
  SELECT k, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS digest
  FROM (SELECT c, max_by(k, d) AS k FROM path GROUP BY c) GROUP BY 1
)
SELECT up.c AS conv_id, CAST(up.d AS BIGINT) AS depth, parent.c AS parent_conv_id, up.n AS n_convs,
       coalesce(kids.kids, 0) AS n_children, below.leaves AS n_leaves, CAST(below.saved AS BIGINT) AS saved_tokens,
       coalesce(ended.digest, sha256('')) AS ends_sha256
FROM up JOIN below ON below.k = up.k AND below.d = up.d LEFT JOIN node parent ON parent.k = up.pk
LEFT JOIN kids ON kids.k = up.k LEFT JOIN ended ON ended.k = up.k
"""


@query("op13_conversation_trie", ORACLE)
def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))
