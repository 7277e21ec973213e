"""Operators do the whole job: cases that a cut would miss."""

import os
import random
import time

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy import session
from colloquy.llm import catalog, lmscore, ngramjoin, toxicity


def test_links_at_the_threshold_beside_a_hot_group(spark):
    """A large group of close copies must not decide how well links of the least similarity are found."""
    rng = random.Random(11)
    hot = [f"h{i}" for i in range(300)]
    rows = []
    for i in range(400):
        text = list(hot)
        text[0] = f"x{i}"  # nearly 80,000 links of 0.99
        rows.append((i, " ".join(text)))
    for i in range(400):
        # 72 and 90 shingles, 72 of them common: similarity 0.8
        text = [f"p{i}q{k}" for k in range(94)]
        rows += [(1000 + 2 * i, " ".join(text)), (1001 + 2 * i, " ".join(text[:76]))]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, ngramjoin.near_duplicates(df).collect())) == brute.groups(rows)


def test_no_similarity_is_found_less_often_than_the_target():
    depth = ngramjoin.sure_depth()
    assert 1 - (1 - 0.8**depth) ** ngramjoin.TREES >= ngramjoin.RECALL
    assert ngramjoin.sure_depth(0.5) > depth


def test_contexts_never_share_counts(spark, monkeypatch):
    """Scores are those of exact counts of whole contexts, however many buckets the pairs are in."""
    monkeypatch.setattr(lmscore, "BUCKET_BYTES", 1000)
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(300))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4, "doc_id")
    teaching = docs.select("text").withColumn("_role", F.lit(lmscore.TRAINS | lmscore.TEACHES))
    rows = docs.withColumn("_role", F.lit(lmscore.SCORED_ROLE)).unionByName(teaching, allowMissingColumns=True)
    trained = lmscore._train(teaching.select("text"), lmscore._chunks(rows.select("_role", "doc_id", "text")))
    assert trained.buckets > 5
    mixer = brute.Mixer(texts, trained.code, trained.weights)
    got = {r.doc_id: r.bits for r in lmscore.score(docs, docs).collect()}
    assert got == pytest.approx({i: mixer.bits(t, lmscore.STRETCH) for i, t in enumerate(texts)}, rel=2e-2, abs=0.2)


def test_packed_numbers_come_back():
    for values in (np.zeros(0, np.int64), np.array([-5, 0, 1 << 60, 7]), np.array([1, -1, 127], np.int8)):
        back = lmscore._unpacked(lmscore._packed(values), values.dtype.type)
        assert back.dtype == values.dtype and back.tolist() == values.tolist()


def test_all_training_texts_teach_the_weights(spark, tmp_path):
    """Also those of which the hash is no multiple of sixteen."""
    rows = [(i, f"the cat {i % 7} sat on the mat and the dog {i % 5} ran off ") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").where(F.pmod(F.xxhash64("doc_id"), F.lit(16)) != 0)
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    training = docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0)
    got = {r.doc_id: r.score for r in catalog.QUERIES["op1_lm_scoring"](spark, str(tmp_path)).collect()}
    want = {r.doc_id: r.score for r in lmscore.score(docs, training).collect()}
    assert got == pytest.approx(want, rel=1e-3)


def test_toxic_texts_are_found_on_the_smallest_tables(spark):
    """Few labelled rows give no term a strong association; the best ones count all the same."""
    sf = "/root/testdata/sf0.001"
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.toxic is not None}
    rows = [r for r in catalog.QUERIES["op10_toxicity"](spark, sf).collect() if r.doc_id in label]
    toxic = [r for r in rows if label[r.doc_id]]
    assert sum(r.predicted for r in toxic) >= 0.7 * len(toxic)
    assert sum(r.predicted for r in rows if not label[r.doc_id]) <= 0.05 * len(rows)


def test_terms_that_matter_only_together_are_kept(spark):
    """Toxic if just one of two words is there: neither has any association alone."""
    fill = [" ".join(f"w{(i * 7 + k * k) % 50}" for k in range(8)) for i in range(2000)]
    rows = [(i, fill[i] + " grunkle" * (i // 2 % 2) + " zorblin" * (i // 4 % 2)) for i in range(2000)]
    labels = [(i, int(i // 2 % 2 != i // 4 % 2)) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs.where("doc_id < 1500"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    held = toxicity.score(docs.where("doc_id >= 1500"), model).collect()
    assert sum((r.score >= 0.5) == bool(labels[r.doc_id][1]) for r in held) >= 0.9 * len(held)


def test_scoring_keeps_no_tables_or_shuffles_it_has_used(spark, tmp_path):
    """When scores are made, neither the texts nor the answers of the chunks are on disk, and no shuffle before them."""
    rows = [(i, f"the cat {i % 7} sat on the mat and the dog {i % 5} ran off ") for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        files = blocks.getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    before, first = shuffled(), len(session._made)
    frame = catalog.QUERIES["op1_lm_scoring"](spark, str(tmp_path))
    kept = [path for path in session._made[first:] if os.path.isdir(path)]
    assert sorted(os.path.basename(path).split("-")[0] for path in kept) == ["scores", "tally"]
    until = time.time() + 20  # they are deleted in the background
    while shuffled() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffled() - before
    assert frame.count() == 200


def test_places_of_pairs():
    """Also of pairs that want the same slot."""
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 1000, 50_000):
        keys = np.unique(np.concatenate([rng.integers(-(1 << 62), 1 << 62, n), np.arange(n) << 40, [0, -(1 << 63)]]))
        order = rng.integers(0, len(keys), 2 * len(keys))
        assert lmscore.Places(keys).find(keys[order]).tolist() == order.tolist()
