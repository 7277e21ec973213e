"""The conversation trie against plain Python, in one partition and in many."""

import hashlib
import random
import zlib

import oracle
import pytest
from pyspark.sql import functions as F

from colloquy.llm import catalog, convtrie

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """`rows`: (conv_id, turn, role, text)."""
    original = {}
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None,
                                                                        r[2] or "", r[3] is not None, r[3] or ""))
    for c, _, role, text in order:
        original.setdefault(c, []).append((role or "", text or ""))
    built = {}
    for c, turns in original.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(original.get(c - c % 100, [])[:h] + turns[h:])
    nodes = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    kids, saved, leaves = {}, {}, {}
    for key in nodes:
        if key:
            kids.setdefault(key[:-1], []).append(key)
    for key in sorted(nodes, key=len, reverse=True):
        below = kids.get(key, [])
        own = (len(nodes[key]) - 1) * (len(key[-1][1]) if key else 0)
        saved[key] = own + sum(saved[k] for k in below)
        leaves[key] = sum(leaves[k] for k in below) if below else 1
    out = []
    for key, members in nodes.items():
        ended = ",".join(str(c) for c in sorted(members) if built[c] == key)
        out.append((min(members), len(key), min(nodes[key[:-1]]) if key else None, len(members), len(kids.get(key, [])),
                    leaves[key], saved[key], hashlib.sha256(ended.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df):
    assert df.columns == [c.split()[0] for c in convtrie.COLUMNS.split(", ")]
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("part", [20_000, 3])
def test_conversations(spark, monkeypatch, part):
    monkeypatch.setattr(convtrie, "PART_CLASSES", part)
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select(*"conv_id turn role text".split()).collect()]
    got = catalog.QUERIES["op13_conversation_trie"](spark, SF)
    assert rows_of(got) == brute(rows)
    assert oracle.compare(got, oracle.connect(SF), catalog.ORACLES["op13_conversation_trie"]) == []


def _random(seed, convs, texts, most):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        rows += [(c * 7, t, rng.choice("ua"), rng.choice(texts)) for t in range(rng.randrange(most))] or [(c * 7, 0, "u", "x")]
    return rows


@pytest.mark.parametrize("part,hot", [(1, 1_000_000), (4, 5), (50, 40)])
def test_random_tries(spark, monkeypatch, split_at, part, hot):
    """Few texts, so that beginnings are shared deep down, equal conversations occur, and some end inside others."""
    monkeypatch.setattr(convtrie, "PART_CLASSES", part)
    split_at(hot)
    rows = _random(part, 60, ["", "x", "é😀"], 7) + [(14_000, t, "u", "x") for t in range(60)]
    rows += [(14_000 + c, t, "u", "x") for c in range(1, 9) for t in range(c * 5)]
    assert rows_of(convtrie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_odd_rows(spark):
    long = "wörd " * 100_000
    rows = [(None, 1, "u", "lost"), (100, None, None, None), (100, 2, "u", "b"), (100, 2, "u", "a"), (101, 1, "u", long),
            (101, 1, "u", long), (102, 1, "", ""), (103, None, "u", "z"), (104, 5, "user", "x"), (105, 5, "user", "x"),
            (205, 1, "u", None), (100, 3, None, "a"), (100, 3, "u", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    clash = df.select("*", *(F.lit("mine").alias(c) for c in "conv d pos h first there size h1 path item class ends depth n".split()))
    assert rows_of(convtrie.prefix_trie(clash)) == brute(rows)
    assert convtrie.prefix_trie(df.where("conv_id > 1000")).collect() == []
    assert convtrie.prefix_trie(df.where("conv_id IS NULL")).collect() == []
    one = [(7, 0, "u", "hello")]
    assert rows_of(convtrie.prefix_trie(spark.createDataFrame(one, SCHEMA))) == brute(one)
