"""Files: line numbers over many blocks, encoding, path policy, round trips."""

import pytest
from pyspark.sql import functions as F

from colloquy.operators import labels
from colloquy.sources import corpus, lineage


@pytest.fixture()
def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_line_numbers_over_blocks_and_files(spark, tmp_path, small_blocks):
    want = {}
    for name, ending in (("a", "\n"), ("b", "\r\n")):
        lines = [f"{name}-{i}" + "x" * (i * 7 % 40) if i % 9 else "" for i in range(300)]
        (tmp_path / f"{name}.jsonl").write_bytes(ending.join(lines).encode())
        want.update({(name, i + 1): line for i, line in enumerate(lines)})
    scanned = corpus.scan_lines(spark, str(tmp_path))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
    got = {(r.corpus, r.line_no): r.value for r in scanned.collect()}
    assert got == want


def test_encoding(spark, tmp_path):
    (tmp_path / "good.jsonl").write_bytes(b"1\n2\n3\n")
    (tmp_path / "bom.jsonl").write_bytes(b"\xef\xbb\xbf1\n2\n")
    (tmp_path / "bad.jsonl").write_bytes(b"1\n2\n\xff\xfe\n4\n\xff\n")
    lines = corpus.scan_lines(spark, str(tmp_path))
    errors = corpus.encoding_errors(lines, corpus.inspect_files(corpus.files(spark, str(tmp_path))))
    got = {r.path.rsplit("/", 1)[1]: (r.line_no, r.code) for r in errors.collect()}
    assert got == {"bom.jsonl": (None, "IG_R04_ENCODING_INVALID"), "bad.jsonl": (3, "IG_R04_ENCODING_INVALID")}
    kept = {(r.corpus, r.line_no) for r in corpus.readable_lines(lines, errors).collect()}
    assert kept == {("good", 1), ("good", 2), ("good", 3), ("bad", 1), ("bad", 2)}


def test_path_policy(spark, tmp_path):
    inside = tmp_path / "raw" / "synthetic"
    inside.mkdir(parents=True)
    (inside / "syn-a.jsonl").write_text("{}\n")
    (inside / "notes.txt").write_text("x")
    (tmp_path / "raw" / "other.jsonl").write_text("{}\n")
    got = {}
    (inside / "empty.jsonl").write_text("")
    names = ["synthetic/syn-a.jsonl", "synthetic/empty.jsonl", "synthetic/notes.txt", "synthetic/gone.jsonl", "other.jsonl"]
    paths = spark.createDataFrame([(f"file:{tmp_path}/raw/{n}",) for n in names], "path string")
    for r in corpus.path_errors(corpus.inspect_files(paths)).collect():
        got[r.path.rsplit("/", 1)[1]] = (r.corpus, r.code)
    listed = {r.path.rsplit("/", 1)[1] for r in corpus.files(spark, str(inside)).collect()}
    assert listed == {"syn-a.jsonl", "notes.txt"}
    assert got["syn-a.jsonl"] == ("syn-a", None)
    assert got["empty.jsonl"][1] == "IG_R01_EMPTY_FILE"
    assert got["gone.jsonl"][1] == "IG_R01_FILE_NOT_FOUND"
    assert got["notes.txt"][1] == "IG_R01_NOT_READABLE"
    assert got["other.jsonl"][1] == "IG_R02_PATH_OUTSIDE_SYNTHETIC"


def test_label_set_needs_scores(spark, tmp_path):
    rows = spark.createDataFrame(
        [("m1", "customer", 0.5, "2024-01-01T00:00:00Z"), ("m2", "customer", None, "2024-01-01T00:01:00Z")],
        "message_id string, role string, generated_label double, sent_at string",
    )
    made = labels.label_rows(rows, F.lit("a"))
    with pytest.raises(Exception, match="label_score is null"):
        labels.write_label_set(made, str(tmp_path / "bad"))
    labels.write_label_set(made.filter("target_id = 'm1'"), str(tmp_path / "good"))
    back = labels.read_label_set(spark, str(tmp_path / "good"))
    assert back.first().label_set_id == "ls-a" and dict(back.dtypes)["annotator"] == "string"
    sane = labels.label_sanity(made, rows).first()
    assert sane.error_code == "LB_R11_LABEL_SCORE_OUT_OF_DOMAIN"
    doubled = labels.label_sanity(made.unionAll(made), rows.unionAll(rows)).first()
    assert doubled.error_code == "LB_R11_DUPLICATE_TARGET_ID"
    short = labels.label_sanity(made, rows.unionAll(rows)).first()
    assert short.error_code == "LB_R10_ROW_COUNT_MISMATCH"


def test_table_fingerprint(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("k"))
    one = lineage.table_fingerprint(df).first()
    assert lineage.table_fingerprint(df.repartition(5).select("k", "id")).first() == one
    for other in (df.filter("id <> 3"), df.unionAll(df.filter("id = 3")), df.withColumn("k", F.col("k") + 1)):
        assert lineage.table_fingerprint(other).first().fingerprint != one.fingerprint
    twice = df.unionAll(df.filter("id = 3")).unionAll(df.filter("id = 3"))
    assert lineage.table_fingerprint(twice).first().fingerprint != one.fingerprint


def test_config_fingerprint_is_the_hash_of_sorted_json(spark):
    import hashlib
    import json

    fixed = {"seed": 42, "algorithm": "tfidf-ridge", "dataset_sha256": {}}
    column = lineage.config_fingerprint({"dataset_sha256.train": F.lit("aa"), "dataset_sha256.test": F.lit("bb")}, fixed)
    want = hashlib.sha256(
        json.dumps({**fixed, "dataset_sha256": {"train": "aa", "test": "bb"}}, sort_keys=True).encode()
    ).hexdigest()[:16]
    assert spark.range(1).select(column).first()[0] == want


def test_folder_is_not_readable(spark, tmp_path):
    base = tmp_path / "raw" / "synthetic"
    (base / "folder.jsonl").mkdir(parents=True)
    (base / "empty.jsonl").write_text("")
    paths = spark.createDataFrame([(f"file://{base}/{n}.jsonl",) for n in ("folder", "empty", "gone")], "path string")
    got = {r.corpus: r.code for r in corpus.path_errors(corpus.inspect_files(paths)).collect()}
    assert got == {"folder": "IG_R01_NOT_READABLE", "empty": "IG_R01_EMPTY_FILE", "gone": "IG_R01_FILE_NOT_FOUND"}


def test_file_fingerprint_reads_in_chunks(spark, tmp_path, monkeypatch):
    import hashlib

    body = bytes(range(256)) * 9000
    (tmp_path / "f").write_bytes(body)
    row = lineage.file_fingerprints(spark, str(tmp_path / "f")).first()
    assert (row.sha256, row.bytes) == (hashlib.sha256(body).hexdigest(), len(body))


def test_job_deletes_what_it_wrote(spark):
    import os

    from colloquy import session

    with session.job(spark):
        made = session.materialize(spark.range(3).toDF("id"), "scratch")
        path = made.inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path)
    assert not os.path.exists(path)
