"""Label sets, examples and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.functions.text import join_context
from colloquy.operators import dataset, labels
from colloquy.operators.validation import check
from colloquy.plans import offline
from colloquy.plans.registry import query
from colloquy.plans.text_queries import _FEATURES
from colloquy.plans.validation_queries import CHECK_SQL
from colloquy.session import materialize, new_path
from colloquy.sources.tables import (
    EVENT_PREDICTIONS_SQL,
    MESSAGES_SQL,
    corpus_lines,
    event_predictions,
    messages,
    table,
)


def corpus_messages(spark, sf):
    m = messages(spark, sf)
    return m.withColumn("sent_at", F.date_format("sent_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def _labels(spark, sf):
    return labels.label_rows(corpus_messages(spark, sf), F.lit("corpus-a"))


_LABEL_SQL = """lab AS (SELECT 'ls-corpus-a' AS label_set_id, 'message' AS target_type, message_id AS target_id,
  generated_label AS label_score, '-1 to 1' AS scale, 'synthetic' AS label_source, NULL::VARCHAR AS annotator,
  strftime(make_timestamp(sent_s * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS labeled_at FROM msg WHERE role = 'customer')"""


@query("label_rows", f"WITH {MESSAGES_SQL}, {_LABEL_SQL} SELECT * FROM lab")
def label_rows(spark, sf):
    """Through the Parquet sink and back, with the fixed schema."""
    path = new_path(spark, "labels")
    labels.write_label_set(_labels(spark, sf), path)
    return labels.read_label_set(spark, path)


@query(
    "label_levels",
    f"""WITH {MESSAGES_SQL} SELECT l.level, count(m.message_id) AS n FROM (VALUES (-1.0::DOUBLE), (-0.5), (0), (0.5), (1)) l(level)
    LEFT JOIN msg m ON m.role = 'customer' AND m.generated_label = l.level GROUP BY 1""",
)
def label_levels(spark, sf):
    return labels.label_levels(_labels(spark, sf))


@query(
    "label_sanity",
    f"""WITH {MESSAGES_SQL} SELECT count(*) AS label_rows, count(DISTINCT message_id) AS distinct_targets, 0::BIGINT AS out_of_domain,
    count(*) AS expected_rows, NULL::VARCHAR AS error_code FROM msg WHERE role = 'customer'""",
)
def label_sanity(spark, sf):
    return labels.label_sanity(_labels(spark, sf), corpus_messages(spark, sf))


def _hash(column):
    """A number below 65,536 that SQL computes alike."""
    return F.conv(F.substring(F.md5(column), 1, 4), 16, 10).cast("int")


def _hash_sql(column):
    return f"('0x' || substr(md5({column}), 1, 4))::INT"


_LABEL_FAULTS = {
    "lost": ("LB_R10_ROW_COUNT_MISMATCH", 11),
    "repeated": ("LB_R11_DUPLICATE_TARGET_ID", 7),
    "no level": ("LB_R11_LABEL_SCORE_OUT_OF_DOMAIN", 5),
}


@query(
    "label_faults",
    f"""WITH {MESSAGES_SQL}, c AS (SELECT message_id, {_hash_sql('message_id')} AS h FROM msg WHERE role = 'customer'),
    f AS (SELECT * FROM c, (VALUES {", ".join(f"('{k}', {m})" for k, (_, m) in _LABEL_FAULTS.items())}) v(fault, m)),
    n AS (SELECT fault, count(*) FILTER (NOT (fault = 'lost' AND h % m = 0)) AS label_rows,
      count(DISTINCT CASE WHEN fault = 'repeated' AND h % m = 0 THEN 'same' ELSE message_id END)
        FILTER (NOT (fault = 'lost' AND h % m = 0)) AS distinct_targets,
      count(*) FILTER (fault = 'no level' AND h % m = 0) AS out_of_domain, count(*) AS expected_rows FROM f GROUP BY 1)
    SELECT *, CASE WHEN label_rows <> expected_rows THEN 'LB_R10_ROW_COUNT_MISMATCH'
      WHEN distinct_targets <> label_rows THEN 'LB_R11_DUPLICATE_TARGET_ID'
      WHEN out_of_domain > 0 THEN 'LB_R11_LABEL_SCORE_OUT_OF_DOMAIN' END AS error_code FROM n""",
)
def label_faults(spark, sf):
    """The report of label sets that lost rows, repeat a target, or hold a score that is no level."""
    made = materialize(_labels(spark, sf), "labels")
    found = None
    for fault, (_, m) in _LABEL_FAULTS.items():
        hit = _hash(F.col("target_id")) % m == 0
        broken = {
            "lost": made.filter(~hit),
            "repeated": made.withColumn("target_id", F.when(hit, "same").otherwise(F.col("target_id"))),
            "no level": made.withColumn("label_score", F.when(hit, 0.25).otherwise(F.col("label_score"))),
        }[fault]
        report = labels.label_sanity(broken, corpus_messages(spark, sf)).withColumn("fault", F.lit(fault))
        found = report if found is None else found.unionByName(report)
    return found


def _examples(spark, sf):
    m = messages(spark, sf).drop("generated_label", "received_at")
    return dataset.assemble_examples(dataset.feature_rows(m), _labels(spark, sf))


@query(
    "examples",
    _FEATURES
    + """SELECT message_id AS example_id, customer_id, conversation_id, persona, h[-1] AS text_clean,
    array_to_string(h[1:len(h) - 1], ' ') AS context, generated_label AS label_score FROM framed""",
)
def examples(spark, sf):
    rows = _examples(spark, sf)
    return rows.select(
        "example_id", "customer_id", "conversation_id", "persona", "text_clean",
        join_context(F.col("context_clean")).alias("context"), "label_score",
    )


def split_sql(source: str, key: str) -> str:
    return f"""ranked AS (SELECT {key}, row_number() OVER (ORDER BY md5({key} || '-42'), {key}) AS k, count(*) OVER () AS g
    FROM (SELECT DISTINCT {key} FROM {source})),
  assigned AS (SELECT {key}, CASE WHEN k <= ceil(ceil(0.3::DOUBLE * g) * 0.5) THEN 'test' WHEN k <= ceil(0.3::DOUBLE * g) THEN 'validation'
    ELSE 'train' END AS split FROM ranked)"""


@query(
    "grouped_split",
    f"""WITH {MESSAGES_SQL}, {split_sql("(SELECT * FROM msg WHERE role = 'customer')", 'customer_id')}
    SELECT message_id, customer_id, split FROM msg JOIN assigned USING (customer_id) WHERE role = 'customer'""",
)
def grouped_split(spark, sf):
    rows = dataset.customer_messages(messages(spark, sf)).select("message_id", "customer_id")
    return dataset.grouped_split(rows)


@query(
    "split_many_groups",
    f"""WITH {split_sql("(SELECT o_custkey::VARCHAR AS customer_id FROM orders)", 'customer_id')}
    SELECT split, count(*) AS n_rows, count(DISTINCT customer_id) AS customers FROM
    (SELECT o_custkey::VARCHAR AS customer_id FROM orders) JOIN assigned USING (customer_id) GROUP BY 1""",
)
def split_many_groups(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("customer_id"))
    counts = dataset.split_counts(dataset.grouped_split(rows))
    return counts


@query(
    "hash_split",
    """SELECT split, count(*) AS n FROM (SELECT CASE WHEN b < 7000 THEN 'train' WHEN b < 8500 THEN 'validation' ELSE 'test' END AS split
    FROM (SELECT ('0x' || substr(md5(o_custkey::VARCHAR || '-42'), 1, 8))::BIGINT % 10000 AS b FROM orders)) GROUP BY 1""",
)
def hash_split(spark, sf):
    key = F.col("o_custkey").cast("string")
    return table(spark, sf, "orders").groupBy(dataset.hash_split(key).alias("split")).agg(F.count(F.lit(1)).alias("n"))


def _split_examples(spark, sf):
    rows = event_predictions(spark, sf).select("example_id", "customer_id", "label_score")
    return dataset.grouped_split(rows)


_SPLIT_EVENTS = f"""WITH {EVENT_PREDICTIONS_SQL}, {split_sql('pred', 'customer_id')},
placed AS (SELECT * FROM pred JOIN assigned USING (customer_id))"""


@query(
    "split_dataset",
    _SPLIT_EVENTS + " SELECT split, count(*) AS n_rows, count(DISTINCT customer_id) AS customers FROM placed GROUP BY 1",
)
def split_dataset(spark, sf):
    """Written by split and read back."""
    path = new_path(spark, "dataset")
    dataset.write_dataset(_split_examples(spark, sf), path)
    back = spark.read.parquet(path).withColumn("split", F.col("split").cast("string"))
    return dataset.split_counts(back)


@query(
    "split_sanity",
    _SPLIT_EVENTS + """ SELECT count(*) AS example_rows, count(*) AS split_rows, 0::BIGINT AS leaked_customers,
    (SELECT count(*) FROM events) AS label_rows, NULL::VARCHAR AS error_code FROM placed""",
)
def split_sanity(spark, sf):
    placed = materialize(_split_examples(spark, sf), "split")
    return dataset.split_sanity(placed, table(spark, sf, "events"))


@query(
    "split_overlap",
    """SELECT l AS left_split, r AS right_split, (count(event_id) * 0)::BIGINT AS shared FROM events,
    (VALUES ('train', 'validation'), ('train', 'test'), ('validation', 'test')) p(l, r) GROUP BY 1, 2""",
)
def split_overlap(spark, sf):
    return dataset.split_overlap(materialize(_split_examples(spark, sf), "split"))


_FAULTY = f"""{_SPLIT_EVENTS}, hashed AS (SELECT *, {_hash_sql("example_id")} AS h, {_hash_sql("customer_id")} AS hc FROM placed),
faulty AS (SELECT *, CASE WHEN h % 97 = 0 THEN 'test' WHEN h % 89 = 0 THEN 'validation' ELSE split END AS leaky,
  CASE WHEN hc % 6 = 0 THEN 'none' ELSE split END AS gappy FROM hashed)"""


def _leaky(placed):
    h = _hash(F.col("example_id"))
    moved = F.when(h % 97 == 0, "test").when(h % 89 == 0, "validation").otherwise(F.col("split"))
    return placed.withColumn("split", moved)


@query(
    "split_faults",
    _FAULTY + """, r AS (
    SELECT 'lost' AS fault, count(*) FILTER (h % 31 <> 0) AS example_rows, count(*) FILTER (h % 31 <> 0) AS split_rows,
      0::BIGINT AS leaked_customers, count(*) AS label_rows FROM faulty
    UNION ALL SELECT 'leak', count(*), count(*), (SELECT count(*) FROM (SELECT customer_id FROM faulty GROUP BY 1
      HAVING count(DISTINCT leaky) > 1)), count(*) FROM faulty
    UNION ALL SELECT 'gap', count(*), count(*) FILTER (gappy <> 'none'), 0, count(*) FROM faulty)
    SELECT *, CASE WHEN example_rows <> label_rows THEN 'SP_R11_EXAMPLE_COUNT_MISMATCH'
      WHEN leaked_customers > 0 THEN 'SP_R12_CUSTOMER_ID_LEAK'
      WHEN split_rows <> example_rows THEN 'SP_R13_SPLIT_ROW_SUM_MISMATCH' END AS error_code FROM r""",
)
def split_faults(spark, sf):
    """The report of datasets that lost rows, leak a customer into another split, or leave rows without one."""
    placed = materialize(_split_examples(spark, sf), "split")
    gap = F.when(_hash(F.col("customer_id")) % 6 == 0, "none").otherwise(F.col("split"))
    broken = {
        "lost": placed.filter(_hash(F.col("example_id")) % 31 != 0),
        "leak": _leaky(placed),
        "gap": placed.withColumn("split", gap),
    }
    found = None
    for fault, rows in broken.items():
        report = dataset.split_sanity(rows, table(spark, sf, "events")).withColumn("fault", F.lit(fault))
        found = report if found is None else found.unionByName(report)
    return found


@query(
    "split_leaks",
    _FAULTY + """ SELECT l AS left_split, r AS right_split, (SELECT count(*) FROM
      (SELECT customer_id FROM faulty GROUP BY 1 HAVING bool_or(leaky = l) AND bool_or(leaky = r))) AS shared
    FROM (VALUES ('train', 'validation'), ('train', 'test'), ('validation', 'test')) p(l, r)""",
)
def split_leaks(spark, sf):
    """Customers in two splits, where some rows were moved."""
    return dataset.split_overlap(materialize(_leaky(_split_examples(spark, sf)), "split"))


@query(
    "split_gaps",
    _FAULTY + " SELECT example_id, split FROM faulty WHERE gappy = 'none'",
)
def split_gaps(spark, sf):
    """Examples that the union of the splits lacks, where some customers were left without one, and their split."""
    placed = materialize(_split_examples(spark, sf), "split")
    held = placed.filter(_hash(F.col("customer_id")) % 6 != 0)
    parts = [held.filter(F.col("split") == s) for s in dataset.SPLITS]
    return dataset.missing_from_union(placed, parts).join(placed.select("example_id", "split"), "example_id")


@query("split_union", "SELECT count(*) - count(*) AS missing, count(*) AS n_rows FROM events")
def split_union(spark, sf):
    placed = materialize(_split_examples(spark, sf), "split")
    parts = [placed.filter(F.col("split") == s) for s in dataset.SPLITS]
    missing = dataset.missing_from_union(event_predictions(spark, sf), parts)
    total = placed.agg(F.count(F.lit(1))).scalar()
    return missing.agg(F.count(F.lit(1)).alias("missing")).withColumn("n_rows", total)


@query(
    "review_sample",
    f"WITH {MESSAGES_SQL} SELECT message_id, role FROM msg WHERE role = 'customer' ORDER BY md5(message_id || '-42'), message_id LIMIT 50",
)
def review_sample(spark, sf):
    return dataset.review_sample(messages(spark, sf), 50).select("message_id", "role")


@query(
    "cycled_histories",
    """WITH pool AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id::VARCHAR) - 1 AS at, count(*) OVER () AS n FROM documents)
    SELECT r.at AS row, md5(r.text) AS trigger, md5(string_agg(t.text, '|' ORDER BY j.j)) AS context
    FROM pool r, range(30) j(j) JOIN pool t ON t.at = (r.at + j.j) % r.n WHERE r.at < 10 GROUP BY 1, 2""",
)
def cycled_histories(spark, sf):
    pool = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("example_id"), F.col("text").alias("text_clean"))
    rows = dataset.cycled_histories(pool)
    return rows.select("row", F.md5("text_clean").alias("trigger"), F.md5(F.array_join("context_clean", "|")).alias("context"))


@query(
    "dataset_from_corpus",
    f"""WITH {CHECK_SQL}, cust AS (SELECT *, count(*) OVER (PARTITION BY conversation_id ORDER BY sent_at, message_id
        ROWS BETWEEN 29 PRECEDING AND 1 PRECEDING) AS before FROM ok WHERE role = 'customer'),
    {split_sql('cust', 'customer_id')}
    SELECT split, count(*) AS n_rows, count(DISTINCT customer_id) AS customers, sum(before)::BIGINT AS context_messages,
      sum(label) AS label_sum FROM cust JOIN assigned USING (customer_id) GROUP BY 1""",
)
def dataset_from_corpus(spark, sf):
    """Corpus lines to split examples: only lines without an error get that far."""
    survivors = check(corpus_lines(spark, sf)).survivors
    placed = offline.build_examples(survivors)
    offline.require_sound(placed, survivors)
    return placed.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("customer_id").alias("customers"),
        F.sum(F.size("context_clean")).alias("context_messages"),
        F.sum("label_score").alias("label_sum"),
    )
