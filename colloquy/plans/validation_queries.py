"""Corpus validation over the conversations written as corpus lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.operators import validation as v
from colloquy.plans.registry import query
from colloquy.plans.text_queries import COUNT_SQL
from colloquy.session import new_path, spread
from colloquy.sources import corpus
from colloquy.sources.tables import (
    CORPUS_LINES_SQL,
    MESSAGES_SQL,
    corpus_lines,
    messages,
    table,
)

_FIELDS = (
    "['conversation_id', 'corpus_id', 'customer_id', 'generated_label', 'message_id', 'persona', 'role', 'sent_at', 'text']"
)
# Row rules, then the first-wins cascade as nested windows over the survivors.
CHECK_SQL = f"""
{CORPUS_LINES_SQL},
doc AS (SELECT corpus, line_no, value, CASE WHEN json_valid(value) THEN value::JSON END AS j FROM line WHERE trim(value) <> ''),
fields AS (SELECT corpus, line_no, j, json_type(j) AS top, CASE WHEN json_type(j) = 'OBJECT' THEN json_keys(j) END AS keys,
  j->>'$.corpus_id' AS corpus_id, j->>'$.conversation_id' AS conversation_id, j->>'$.customer_id' AS customer_id,
  j->>'$.message_id' AS message_id, j->>'$.role' AS role, j->>'$.text' AS text, j->>'$.sent_at' AS sent_at,
  j->>'$.persona' AS persona, json_type(j, '$.text') AS text_type, json_type(j, '$.generated_label') AS label_type,
  TRY_CAST(j->>'$.generated_label' AS DOUBLE) AS label FROM doc),
ruled AS (SELECT *, CASE
  WHEN j IS NULL THEN 'DC_R01_INVALID_JSON'
  WHEN top <> 'OBJECT' OR list_sort(list_distinct(keys)) <> {_FIELDS} OR text_type <> 'VARCHAR' OR role NOT IN ('customer', 'agent')
    OR trim(text) = '' OR length(text) > 1000 OR NOT regexp_full_match(sent_at, '\\d{{4}}-\\d\\d-\\d\\dT\\d\\d:\\d\\d:\\d\\dZ')
    OR NOT regexp_full_match(persona, '[a-z]+(_[a-z]+)*')
    OR label_type NOT IN ('DOUBLE', 'UBIGINT', 'BIGINT', 'NULL') THEN 'DC_R01_SCHEMA_VIOLATION'
  WHEN corpus_id <> corpus THEN 'IG_R03_CORPUS_ID_INCONSISTENT'
  WHEN NOT (conversation_id LIKE 'syn-%' AND customer_id LIKE 'syn-%' AND message_id LIKE 'syn-%') THEN 'DC_R03_ID_PREFIX_INVALID'
  WHEN role = 'customer' AND (label IS NULL OR label NOT IN (-1, -0.5, 0, 0.5, 1)) THEN 'DC_R07_LABEL_MISSING_OR_INVALID'
  WHEN role = 'agent' AND label_type <> 'NULL' THEN 'DC_R08_AGENT_LABEL_NOT_NULL' END AS rule FROM fields),
s0 AS (SELECT *, row_number() OVER (PARTITION BY corpus, message_id ORDER BY line_no) AS k FROM ruled WHERE rule IS NULL),
s1 AS (SELECT *, first_value(customer_id) OVER (PARTITION BY corpus, conversation_id ORDER BY line_no) AS owner FROM s0 WHERE k = 1),
s2 AS (SELECT *, first_value(persona) OVER (PARTITION BY corpus, customer_id ORDER BY line_no) AS first_persona FROM s1 WHERE owner = customer_id),
s3 AS (SELECT *, row_number() OVER (PARTITION BY corpus, conversation_id, sent_at ORDER BY line_no) AS m FROM s2 WHERE first_persona = persona),
checked AS (
  SELECT r.corpus, r.line_no, r.message_id, r.conversation_id, r.customer_id, r.role, r.persona, r.text, r.sent_at, r.label,
    CASE WHEN r.rule IS NOT NULL THEN r.rule WHEN s0.k > 1 THEN 'DC_R02_DUPLICATE_MESSAGE_ID'
         WHEN s1.owner <> s1.customer_id THEN 'DC_R04_CONVERSATION_MULTI_CUSTOMER'
         WHEN s2.first_persona <> s2.persona THEN 'DC_R05_CUSTOMER_MULTI_PERSONA'
         WHEN s3.m > 1 THEN 'DC_R06_SENT_AT_DUPLICATE' END AS code
  FROM ruled r LEFT JOIN s0 USING (corpus, line_no) LEFT JOIN s1 USING (corpus, line_no) LEFT JOIN s2 USING (corpus, line_no) LEFT JOIN s3 USING (corpus, line_no)),
ok AS (SELECT * FROM checked WHERE code IS NULL)"""


@query("row_rules", f"WITH {CHECK_SQL} SELECT corpus, line_no, rule FROM ruled")
def row_rules(spark, sf):
    return v.parse(corpus_lines(spark, sf)).select("corpus", "line_no", "rule")


@query("corpus_errors", f"WITH {CHECK_SQL} SELECT corpus, line_no, message_id, code FROM checked WHERE code IS NOT NULL")
def corpus_errors(spark, sf):
    return v.check(corpus_lines(spark, sf)).parsed.filter("code IS NOT NULL").select("corpus", "line_no", "message_id", "code")


@query(
    "error_list",
    f"""WITH {CHECK_SQL} SELECT corpus, line_no AS line, message_id, code FROM checked WHERE code IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY corpus ORDER BY line_no) <= 50""",
)
def error_list(spark, sf):
    return v.error_list(v.check(corpus_lines(spark, sf)).parsed).select("corpus", "line", "message_id", "code")


@query(
    "error_summary",
    f"""WITH {CHECK_SQL} SELECT corpus, count(code) AS errors, CASE WHEN count(code) > 0 THEN 'rejected' ELSE 'ok' END AS status,
    count(code) > 50 AS errors_truncated FROM checked GROUP BY 1""",
)
def error_summary(spark, sf):
    return v.error_summary(v.check(corpus_lines(spark, sf)).parsed)


@query(
    "unordered_conversations",
    f"""WITH {CHECK_SQL}, p AS (SELECT corpus, conversation_id, sent_at, lag(sent_at) OVER (PARTITION BY corpus, conversation_id ORDER BY line_no) AS b FROM ok)
    SELECT corpus, conversation_id, count(*) AS steps_back FROM p WHERE sent_at < b GROUP BY 1, 2""",
)
def unordered_conversations(spark, sf):
    return v.unordered_conversations(v.check(corpus_lines(spark, sf)).survivors)


@query(
    "corpus_counts",
    f"""WITH {CHECK_SQL} SELECT corpus, count(*) AS messages, count(*) FILTER (WHERE code IS NULL AND role = 'customer') AS messages_customer,
    count(*) FILTER (WHERE code IS NULL AND role = 'agent') AS messages_agent,
    count(DISTINCT CASE WHEN code IS NULL THEN conversation_id END) AS conversations,
    count(DISTINCT CASE WHEN code IS NULL THEN customer_id END) AS customers,
    count(DISTINCT CASE WHEN code IS NULL THEN persona END) AS personas FROM checked GROUP BY 1""",
)
def corpus_counts(spark, sf):
    return v.counts(v.check(corpus_lines(spark, sf)).parsed)


@query(
    "level_distribution",
    f"""WITH {MESSAGES_SQL} SELECT l.level, count(m.message_id) AS n,
    round(count(m.message_id) / (SELECT count(*) FROM msg WHERE role = 'customer'), 9) AS pct
    FROM (VALUES (-1.0::DOUBLE), (-0.5), (0), (0.5), (1)) l(level)
    LEFT JOIN msg m ON m.role = 'customer' AND m.generated_label = l.level GROUP BY 1""",
)
def level_distribution(spark, sf):
    return v.level_distribution(messages(spark, sf)).select("level", "n", F.round("pct", 9).alias("pct"))


@query(
    "persona_distribution",
    f"""WITH {MESSAGES_SQL} SELECT persona, count(DISTINCT customer_id) AS customers,
    round(count(DISTINCT customer_id) / (SELECT count(DISTINCT customer_id) FROM msg), 9) AS pct FROM msg GROUP BY 1""",
)
def persona_distribution(spark, sf):
    return v.persona_distribution(messages(spark, sf)).select("persona", "customers", F.round("pct", 9).alias("pct"))


@query(
    "length_distribution",
    f"""WITH {MESSAGES_SQL}, n AS (SELECT count(*) AS n FROM msg GROUP BY conversation_id)
    SELECT min(n) AS shortest, list_sort(list(n))[(count(*) // 2) + 1] AS p50, max(n) AS longest FROM n""",
)
def length_distribution(spark, sf):
    return v.length_distribution(messages(spark, sf))


@query(
    "length_errors",
    f"""WITH {MESSAGES_SQL}, n AS (SELECT conversation_id, count(*) AS n, count(DISTINCT role) AS roles FROM msg GROUP BY 1)
    SELECT conversation_id, n, 'DC_R15_CONVERSATION_LENGTH_INVALID' AS code FROM n WHERE n NOT BETWEEN 4 AND 20
    UNION ALL SELECT conversation_id, n, 'DC_R15_CONVERSATION_SINGLE_ROLE' FROM n WHERE roles < 2""",
)
def length_errors(spark, sf):
    return v.length_errors(messages(spark, sf))


@query(
    "mood_variation",
    f"""WITH {MESSAGES_SQL}, n AS (SELECT conversation_id, count(DISTINCT generated_label) AS k FROM msg GROUP BY 1)
    SELECT count(*) FILTER (WHERE k >= 2) AS varied, count(*) AS conversations,
    round(count(*) FILTER (WHERE k >= 2) / count(*), 9) AS ratio FROM n""",
)
def mood_variation(spark, sf):
    return v.mood_variation(messages(spark, sf)).withColumn("ratio", F.round("ratio", 9))


@query(
    "personal_data",
    f"""WITH d AS (SELECT {COUNT_SQL} FROM documents) SELECT sum(cpf)::BIGINT AS cpf, sum(phone)::BIGINT AS phone,
    sum(email)::BIGINT AS email, count(*) FILTER (WHERE cpf + phone + email > 0) AS messages_with_personal_data,
    round(count(*) FILTER (WHERE cpf + phone + email > 0) / count(*), 9) AS ratio FROM d""",
)
def personal_data(spark, sf):
    docs = spread(table(spark, sf, "documents").select("text")).withColumn("role", F.lit("customer"))
    return v.personal_data(docs).withColumn("ratio", F.round("ratio", 9))


def _outcome(value: str, bound: str, near: bool) -> str:
    warn = f"WHEN {value} < {bound} + 0.02::DOUBLE THEN 'warning' " if near else ""
    return f"{value}::DOUBLE AS observed, {bound}::DOUBLE AS bound, CASE WHEN {value} < {bound} THEN 'error' {warn}ELSE 'ok' END AS outcome"


COMPOSITION_SQL = f"""
{MESSAGES_SQL},
cust AS (SELECT * FROM msg WHERE role = 'customer'),
hit AS (SELECT avg((cpf + phone + email > 0)::INT::DOUBLE) AS r FROM (SELECT {COUNT_SQL} FROM cust)),
conv AS (SELECT conversation_id, count(*) AS n, count(DISTINCT role) AS roles, count(DISTINCT generated_label) AS k FROM msg GROUP BY 1),
lev AS (SELECT l.level, count(m.message_id) / (SELECT count(*) FROM cust) AS pct
        FROM (VALUES (-1.0::DOUBLE), (-0.5), (0), (0.5), (1)) l(level) LEFT JOIN cust m ON m.generated_label = l.level GROUP BY 1),
per AS (SELECT persona, count(DISTINCT customer_id) / (SELECT count(DISTINCT customer_id) FROM msg) AS pct FROM msg GROUP BY 1),
rules AS (
  SELECT 'DC_R14' AS rule, 'personal_data_ratio' AS subject, r AS observed, 0.05::DOUBLE AS bound,
    CASE WHEN r NOT BETWEEN 0.05 AND 0.15 THEN 'error' WHEN r < 0.07 OR r > 0.13 THEN 'warning' ELSE 'ok' END AS outcome FROM hit
  UNION ALL SELECT 'DC_R15', 'DC_R15_CONVERSATION_LENGTH_INVALID ' || conversation_id, n, 4, 'error' FROM conv WHERE n NOT BETWEEN 4 AND 20
  UNION ALL SELECT 'DC_R15', 'DC_R15_CONVERSATION_SINGLE_ROLE ' || conversation_id, n, 4, 'error' FROM conv WHERE roles < 2
  UNION ALL SELECT 'DC_R16', 'mood_variation', {_outcome("(count(*) FILTER (WHERE k >= 2) / count(*))", "0.3", False)} FROM conv
  UNION ALL SELECT 'DC_R09', 'customers', {_outcome("count(DISTINCT customer_id)", "150", False)} FROM msg
  UNION ALL SELECT 'DC_R09', 'conversations', {_outcome("count(DISTINCT conversation_id)", "300", False)} FROM msg
  UNION ALL SELECT 'DC_R09', 'customer_messages', {_outcome("count(*)", "2000", False)} FROM cust
  UNION ALL SELECT 'DC_R10', level::VARCHAR, {_outcome("pct", "0.1", True)} FROM lev
  UNION ALL SELECT 'DC_R11', 'personas', {_outcome("count(DISTINCT persona)", "4", False)} FROM msg
  UNION ALL SELECT 'DC_R11', persona, {_outcome("pct", "0.1", True)} FROM per)"""


@query("composition", f"WITH {COMPOSITION_SQL} SELECT rule, subject, round(observed, 9) AS observed, bound, outcome FROM rules")
def composition(spark, sf):
    return v.composition(messages(spark, sf)).withColumn("observed", F.round("observed", 9)).drop("corpus")


# The composition of each corpus's survivors, and how many of its rules fail.
STATUS_SQL = f"""{CHECK_SQL},
cust AS (SELECT * FROM ok WHERE role = 'customer'),
hit AS (SELECT corpus, avg((cpf + phone + email > 0)::INT::DOUBLE) AS r FROM (SELECT corpus, {COUNT_SQL} FROM cust) GROUP BY 1),
conv AS (SELECT corpus, conversation_id, count(*) AS n, count(DISTINCT role) AS roles, count(DISTINCT label) AS k FROM ok GROUP BY 1, 2),
bad AS (
  SELECT corpus, (r NOT BETWEEN 0.05 AND 0.15)::INT AS b FROM hit
  UNION ALL SELECT corpus, (n NOT BETWEEN 4 AND 20)::INT + (roles < 2)::INT FROM conv
  UNION ALL SELECT corpus, (count(*) FILTER (WHERE k >= 2) / count(*) < 0.3)::INT FROM conv GROUP BY 1
  UNION ALL SELECT corpus, (count(DISTINCT customer_id) < 150)::INT + (count(DISTINCT conversation_id) < 300)::INT
    + (count(*) FILTER (WHERE role = 'customer') < 2000)::INT + (count(DISTINCT persona) < 4)::INT FROM ok GROUP BY 1
  UNION ALL SELECT c.corpus, (count(m.label) / any_value(c.n) < 0.1)::INT
    FROM (SELECT corpus, count(*) AS n FROM cust GROUP BY 1) c CROSS JOIN (VALUES (-1), (-0.5), (0), (0.5), (1)) l(level)
    LEFT JOIN cust m ON m.corpus = c.corpus AND m.label = l.level GROUP BY c.corpus, l.level
  UNION ALL SELECT corpus, (count(DISTINCT customer_id) / any_value(n) < 0.1)::INT
    FROM ok JOIN (SELECT corpus, count(DISTINCT customer_id) AS n FROM ok GROUP BY 1) USING (corpus) GROUP BY corpus, persona),
summed AS (SELECT corpus, sum(b)::BIGINT AS b FROM bad GROUP BY 1),
lines AS (SELECT corpus, count(code) AS line_errors FROM checked GROUP BY 1)"""


@query(
    "corpus_status",
    f"""WITH {STATUS_SQL} SELECT corpus, line_errors, CASE WHEN line_errors = 0 THEN coalesce(b, 0) END AS composition_errors,
    CASE WHEN line_errors > 0 OR b > 0 THEN 'rejected' ELSE 'ok' END AS status,
    CASE WHEN line_errors > 0 THEN 'not_evaluated' ELSE 'evaluated' END AS composition FROM lines LEFT JOIN summed USING (corpus)""",
)
def corpus_status(spark, sf):
    checked = v.check(corpus_lines(spark, sf))
    return v.corpus_status(checked.parsed, v.composition(checked.survivors))


def _written(spark, sf) -> str:
    """The corpus lines as JSONL files in the shared folder."""
    path = f"{new_path(spark, 'corpus')}/raw/synthetic"
    corpus_lines(spark, sf).select("value").write.text(path)
    return path


@query(
    "scan_lines",
    f"""WITH {CORPUS_LINES_SQL} SELECT count(*) AS n_lines, count(*) FILTER (WHERE trim(value) = '') AS blank,
    0::BIGINT AS misnumbered, 0::BIGINT AS invalid FROM line""",
)
def scan_lines(spark, sf):
    lines = corpus.scan_lines(spark, _written(spark, sf))
    # numbers 1..n of each file, each exactly once
    per_file = lines.groupBy("path").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("line_no").alias("d"),
        F.min("line_no").alias("lo"),
        F.max("line_no").alias("hi"),
        F.count_if(F.trim("value") == "").alias("blank"),
        F.count_if(~F.is_valid_utf8("value")).alias("invalid"),
    )
    return per_file.agg(
        F.sum("n").alias("n_lines"),
        F.sum("blank").alias("blank"),
        F.count_if((F.col("d") != F.col("n")) | (F.col("lo") != 1) | (F.col("hi") != F.col("n"))).alias("misnumbered"),
        F.sum("invalid").alias("invalid"),
    )


@query(
    "load_corpus",
    f"""WITH {MESSAGES_SQL} SELECT conversation_id, count(*) AS n, count(generated_label) AS labels,
    sum(('0x' || substr(md5(message_id || role || sent_s || text), 1, 8))::BIGINT)::BIGINT AS digest FROM msg GROUP BY 1""",
)
def load_corpus(spark, sf):
    path = new_path(spark, "corpus")
    m = messages(spark, sf).withColumn("corpus_id", F.lit("corpus-a"))
    m = m.withColumn("sent_at", F.date_format("sent_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    corpus.write_canonical(m, path)
    back = corpus.load_corpus(spark, path)
    row = F.concat("message_id", "role", F.unix_timestamp(F.to_timestamp("sent_at")), "text")
    return back.groupBy("conversation_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("generated_label").alias("labels"),
        F.sum(F.conv(F.substring(F.md5(row), 1, 8), 16, 10).cast("long")).alias("digest"),
    )


@query(
    "path_policy",
    "SELECT count(*) AS n_lines, 1::BIGINT AS accepted, 1::BIGINT AS outside, 1::BIGINT AS missing FROM conversations",
)
def path_policy(spark, sf):
    """Folders of written lines, one where corpora belong and one elsewhere, and a
    path that is not there."""
    base = new_path(spark, "policy")
    lines = table(spark, sf, "conversations").select(F.to_json(F.struct("conv_id", "turn", "text")).alias("value"))
    written = None
    for folder in ("raw/synthetic", "raw/other"):
        lines.write.text(f"{base}/{folder}")
        found = corpus.files(spark, f"{base}/{folder}")
        written = found if written is None else written.unionAll(found)
    gone = written.limit(1).select(F.concat("path", F.lit(".jsonl")).alias("path"))
    inspected = corpus.inspect_files(written.unionAll(gone))
    # Spark names its text files .txt, the policy wants .jsonl
    named = inspected.withColumn("path", F.regexp_replace("path", r"\.txt$", ".jsonl"))
    folder = F.regexp_extract("path", "(.*)/", 1)
    n = spark.read.text(f"{base}/raw/synthetic").agg(F.count(F.lit(1))).scalar()

    def folders(condition):
        return F.count_distinct(F.when(condition, folder))

    return corpus.path_errors(named).agg(
        folders(F.col("code").isNull()).alias("accepted"),
        folders(F.col("code") == "IG_R02_PATH_OUTSIDE_SYNTHETIC").alias("outside"),
        F.count_if(F.col("code") == "IG_R01_FILE_NOT_FOUND").alias("missing"),
    ).withColumn("n_lines", n)


@query(
    "encoding_check",
    """SELECT count(*) AS n_lines, count(*) FILTER (WHERE conv_id % 9 = 4) AS invalid, true AS first_lines_found,
    true AS stops_there FROM conversations""",
)
def encoding_check(spark, sf):
    """Lines that are not UTF-8 among the written ones: the first of each file is
    reported, and the lines ahead of it are kept."""
    path = new_path(spark, "encoding")
    one_line = F.regexp_replace("text", "[\\n\\r]", " ")
    bad = F.concat(F.unhex(F.lit("FF")), F.to_binary(one_line, F.lit("utf-8"))).cast("string")
    value = F.when(F.col("conv_id") % 9 == 4, bad).otherwise(one_line)
    table(spark, sf, "conversations").select(value.alias("value")).write.text(path)
    lines = corpus.scan_lines(spark, path)
    errors = corpus.encoding_errors(lines, corpus.inspect_files(corpus.files(spark, path)))
    kept = corpus.readable_lines(lines, errors)
    counts = lines.agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(~F.is_valid_utf8("value")).alias("invalid"))
    reported = errors.agg(F.count(F.lit(1))).scalar()
    faulty = lines.filter(~F.is_valid_utf8("value")).agg(F.count_distinct("path")).scalar()
    return counts.withColumn("first_lines_found", reported == faulty).withColumn(
        "stops_there", kept.agg(F.count_if(~F.is_valid_utf8("value"))).scalar() == 0
    )
