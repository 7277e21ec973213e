"""SimHash fingerprints and components against plain Python."""

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from colloquy.llm import catalog, simhash

SF = "/root/testdata/sf0.001"


def fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def reachable(fps):
    """Least member of each one's component, over all pairs."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def check(got, rows):
    """`got`: sorted (id, fingerprint, component); `rows`: (id, text)."""
    fps = [fingerprint(t) for _, t in rows]
    root = reachable(fps)
    ids = {}
    for (i, _), r in zip(rows, root):
        ids.setdefault(r, []).append(i)
    least = {r: min((i for i in found if i is not None), default=None) for r, found in ids.items()}
    want = [(i, f"{fp:016x}", least[r]) for (i, _), fp, r in zip(rows, fps, root)]
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("tile", [2_048, 7])
def test_documents(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE_LEAST", tile)
    monkeypatch.setattr(simhash, "TILE_MOST", tile)
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    check([tuple(r) for r in catalog.QUERIES["op11_simhash_near_dedup"](spark, SF).collect()], rows)


@pytest.mark.parametrize("apart", [True, False])
def test_compare_finds_every_pair(apart):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 64, 80, np.uint64)
    near = [b ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, rng.integers(1, 7), replace=False)))
            for b in base for _ in range(5)]
    fp = np.unique(np.concatenate([base, np.array(near, np.uint64), np.array([0, 1, 31], np.uint64)]))
    rng.shuffle(fp)
    n = len(fp) // 2 if apart else len(fp)
    who, least = simhash.compare(fp[:n], fp[n:] if apart else None)
    root = np.arange(len(fp))
    root[who] = least
    want = np.arange(len(fp))
    while True:  # the least member reached, step by step
        old = want.copy()
        for i in range(len(fp)):
            for j in np.flatnonzero(np.bitwise_count(fp ^ fp[i]) <= 4):
                if not apart or (i < n) != (j < n):
                    want[i] = want[j] = min(want[i], want[j])
        if (old == want).all():
            break
    assert (root == want).all()


def test_odd_rows(spark):
    long = " ".join(f"w{i % 5003}" for i in range(200_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "One"), (6, "one two three"), (7, "a b c d"),
            (None, "a b c d"), (None, "x y z"), (8, long), (8, long), (9, long + " tail"), (2, ""), (10, "é É 😀 a\x0bb")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clash = df.select("*", *(F.lit(1).alias(c) for c in "fp _id _text _n root node least tile pop u v component_id".split()))
    got = simhash.simhash_components(clash)
    assert got.columns == ["doc_id", "fp", "component_id"]
    check([(r[0], f"{r[1] % (1 << 64):016x}", r[2]) for r in got.collect()], rows)
    assert simhash.simhash_components(df.where("doc_id > 99")).collect() == []
