"""Fingerprints, gates and reports."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.plans.registry import query
from colloquy.session import new_path
from colloquy.sources import lineage
from colloquy.sources.tables import table

_TABLES = ("conversations", "documents", "events", "lineitem", "orders")


@query(
    "table_fingerprints",
    " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n_rows, true AS same_after_shuffle, true AS differs_after_change FROM {t}" for t in _TABLES),
)
def table_fingerprints(spark, sf):
    """The same rows in another order give the same fingerprint; one row more
    does not."""
    result = None
    for name in _TABLES:
        df = table(spark, sf, name)
        mine = lineage.table_fingerprint(df)
        shuffled = lineage.table_fingerprint(df.repartition(*df.columns[:2])).select("fingerprint").scalar()
        longer = lineage.table_fingerprint(df.unionAll(df.orderBy(*df.columns[:2]).limit(1))).select("fingerprint").scalar()
        row = mine.select(
            F.lit(name).alias("name"),
            "n_rows",
            (F.col("fingerprint") == shuffled).alias("same_after_shuffle"),
            (F.col("fingerprint") != longer).alias("differs_after_change"),
        )
        result = row if result is None else result.unionAll(row)
    return result


@query(
    "file_fingerprints",
    "SELECT item_id, sha256(text || chr(10)) AS sha256, strlen(text) + 1 AS bytes FROM benchmark",
)
def file_fingerprints(spark, sf):
    """Every benchmark text written to a file of its own, and hashed there."""
    path = new_path(spark, "files")
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("item"), "text")
    items.repartition("item").write.partitionBy("item").text(path)
    files = lineage.file_fingerprints(spark, f"{path}/item=*")
    return files.select(F.regexp_extract("path", "item=([^/]+)/", 1).cast("long").alias("item_id"), "sha256", "bytes")


_CONFIG = {
    "feature_spec_version": "fs-1",
    "split_strategy": {"train_ratio": 0.7, "validation_ratio": 0.15, "test_ratio": 0.15, "seed": 42},
}


@query(
    "config_fingerprint",
    """SELECT source, substr(sha256('{"corpus_sha256": "' || sha256(source || count(*)) || '", "feature_spec_version": "fs-1", "label_set_sha256": "'
      || sha256(source || sum(n_chars)::BIGINT) || '", "split_strategy": {"seed": 42, "test_ratio": 0.15, "train_ratio": 0.7, "validation_ratio": 0.15}}'), 1, 16) AS fingerprint
    FROM documents GROUP BY source""",
)
def config_fingerprint(spark, sf):
    """Dataset identity per source, from the hashes of its corpus and labels."""
    by_source = table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))
    hashed = by_source.select(
        "source", F.sha2(F.concat("source", "n"), 256).alias("c"), F.sha2(F.concat("source", "chars"), 256).alias("l")
    )
    return hashed.select(
        "source",
        lineage.config_fingerprint({"corpus_sha256": F.col("c"), "label_set_sha256": F.col("l")}, _CONFIG).alias("fingerprint"),
    )


@query(
    "corpus_gate",
    """WITH c AS (SELECT source AS corpus, count(*) AS n FROM documents GROUP BY 1)
    SELECT corpus, CASE WHEN n % 5 = 0 THEN 'missing_report' WHEN n % 5 = 1 THEN 'status_not_ok' WHEN n % 5 = 2 THEN 'sha256_mismatch' END AS reason FROM c""",
)
def corpus_gate(spark, sf):
    current = table(spark, sf, "documents").groupBy(F.col("source").alias("corpus")).agg(F.count(F.lit(1)).alias("n"))
    current = current.withColumn("sha256", F.sha2(F.concat("corpus", "n"), 256))
    reports = current.filter("n % 5 <> 0").select(
        "corpus",
        F.when(F.col("n") % 5 == 1, "rejected").otherwise("ok").alias("status"),
        F.when(F.col("n") % 5 == 2, "old").otherwise(F.col("sha256")).alias("sha256"),
    )
    path = new_path(spark, "reports")
    lineage.write_report(reports, path)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("corpus", "status", "sha256")])
    return lineage.corpus_gate(lineage.read_report(spark, path, schema), current)


@query(
    "label_gate",
    """WITH c AS (SELECT source AS corpus, count(*) AS n FROM documents GROUP BY 1)
    SELECT corpus, CASE n % 5 WHEN 0 THEN 'missing_report' WHEN 1 THEN 'corpus_sha256_mismatch' WHEN 2 THEN 'label_set_missing'
      WHEN 3 THEN 'label_set_sha256_mismatch' END AS reason FROM c""",
)
def label_gate(spark, sf):
    base = table(spark, sf, "documents").groupBy(F.col("source").alias("corpus")).agg(F.count(F.lit(1)).alias("n"))
    base = base.withColumn("sha256", F.sha2(F.concat("corpus", "n"), 256))
    k = F.col("n") % 5
    reports = base.filter(k != 0).select(
        "corpus",
        F.when(k == 1, "old").otherwise(F.col("sha256")).alias("corpus_sha256"),
        F.concat(F.lit("ls-"), "corpus").alias("label_set_id"),
        F.lit("set").alias("label_set_sha256"),
    )
    sets = base.filter(k != 2).select(
        F.concat(F.lit("ls-"), "corpus").alias("label_set_id"), F.when(k == 3, "new").otherwise("set").alias("sha256")
    )
    return lineage.label_gate(reports, base, sets)


@query(
    "lineage_state",
    "SELECT source, CASE WHEN count(*) % 2 = 0 THEN 'reuse' ELSE 'conflict' END AS state FROM documents GROUP BY source",
)
def lineage_state(spark, sf):
    """A stamped table per source against the fingerprint it would get now."""
    docs = table(spark, sf, "documents")
    now = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n")).withColumn("now", F.sha2(F.concat("source", "n"), 256))
    stamped = lineage.stamped(now, F.when(F.col("n") % 2 == 0, F.col("now")).otherwise(F.sha2("source", 256)))
    return lineage.lineage_states(stamped.select("source", "fingerprint"), now.select("source", "now"), "source", "now")
