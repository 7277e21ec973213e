"""Message, outcome and example frames over the given parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.session import spread

# 2024-01-01T00:00:00Z and the five label levels.
EPOCH = 1_704_067_200
LEVELS = (-1.0, -0.5, 0.0, 0.5, 1.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages_of(table(spark, sf_dir, "conversations"))


def messages_of(conversations: DataFrame) -> DataFrame:
    """Conversation turns as messages; one hour between conversations, a minute
    between turns, and an arrival delay that lets some turns overtake others.
    Row-local, so it reads a stream as well."""
    conv, turn = F.col("conv_id"), F.col("turn")
    sent = F.lit(EPOCH) + conv * 3600 + turn * 60
    delay = (conv * 7 + turn * 13) % 5 * 60 + turn
    return (
        conversations.filter(F.col("role") != "system")
        .select(
            F.concat(F.lit("m-"), conv, F.lit("-"), turn).alias("message_id"),
            F.concat(F.lit("c-"), conv).alias("conversation_id"),
            F.concat(F.lit("customer-"), conv % 40).alias("customer_id"),
            F.when(F.col("role") == "user", "customer").otherwise("agent").alias("role"),
            "text",
            F.timestamp_seconds(sent).alias("sent_at"),
            F.timestamp_seconds(sent + delay).alias("received_at"),
            F.concat(F.lit("persona_"), F.element_at(F.array(*[F.lit(c) for c in "abcde"]), (conv % 40 % 5 + 1).cast("int"))).alias("persona"),
            F.when(F.col("role") == "user", ((conv * 3 + turn) % 5 - 2) / 2.0).alias("generated_label"),
        )
    )


# The same frame for DuckDB, times as epoch seconds.
MESSAGES_SQL = f"""
msg AS (
  SELECT 'm-' || conv_id || '-' || turn AS message_id, 'c-' || conv_id AS conversation_id,
         'customer-' || (conv_id % 40) AS customer_id,
         CASE WHEN role = 'user' THEN 'customer' ELSE 'agent' END AS role, text,
         {EPOCH} + conv_id * 3600 + turn * 60 AS sent_s,
         {EPOCH} + conv_id * 3600 + turn * 60 + (conv_id * 7 + turn * 13) % 5 * 60 + turn AS recv_s,
         'persona_' || substr('abcde', (conv_id % 40 % 5 + 1)::INT, 1) AS persona,
         CASE WHEN role = 'user' THEN ((conv_id * 3 + turn) % 5 - 2) / 2.0::DOUBLE END AS generated_label
  FROM conversations WHERE role <> 'system')"""


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes_of(table(spark, sf_dir, "events"))


def outcomes_of(events: DataFrame) -> DataFrame:
    """Scoring outcomes from the event stream: an error is a failure, any other
    event a score. `seq` is the event id, which breaks ties in time."""
    kind = F.when(F.col("event_type") == "error", "failure").otherwise("score")
    return events.select(
        F.concat(F.lit("c-"), F.col("user_id")).alias("conversation_id"),
        F.concat(F.lit("customer-"), F.col("user_id") % 40).alias("customer_id"),
        F.col("event_id").alias("seq"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"),
        kind.alias("kind"),
        F.when(F.col("event_type") == "error", F.element_at(
            F.array(F.lit("timeout"), F.lit("ml_unavailable"), F.lit("invalid_response")),
            (F.col("event_id") % 3 + 1).cast("int"))).alias("error_code"),
        F.when(F.col("event_type") != "error",
               F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("value") / 50 - 1))).alias("score"),
        F.when(F.col("event_type") != "error",
               F.concat(F.lit("mood-2024.01."), F.col("event_id") % 12)).alias("model_version"),
    )


OUTCOMES_SQL = """
outcome AS (
  SELECT 'c-' || user_id AS conversation_id, 'customer-' || (user_id % 40) AS customer_id,
         event_id AS seq, epoch_us(ts) AS at_us,
         CASE WHEN event_type = 'error' THEN 'failure' ELSE 'score' END AS kind,
         CASE WHEN event_type = 'error'
              THEN (['timeout', 'ml_unavailable', 'invalid_response'])[(event_id % 3 + 1)::INT] END AS error_code,
         CASE WHEN event_type <> 'error' THEN greatest(-1.0, least(1.0, value / 50 - 1)) END AS score,
         CASE WHEN event_type <> 'error' THEN 'mood-2024.01.' || (event_id % 12) END AS model_version
  FROM events)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores_of(outcomes(spark, sf_dir))


def scores_of(outcomes_: DataFrame) -> DataFrame:
    """Successful outcomes as score records; stored one to three seconds after
    they were computed, computed times cut to the minute so that some tie."""
    at = F.col("at_us")
    return outcomes_.filter("kind = 'score'").select(
        F.concat(F.lit("s-"), F.col("seq")).alias("mood_id"),
        F.concat(F.lit("t-"), F.col("seq")).alias("trigger_message_id"),
        "customer_id", "conversation_id", "score", F.lit("-1 to 1").alias("scale"), "model_version",
        F.timestamp_micros(at - at % 60_000_000).alias("computed_at"),
        F.timestamp_micros(at + (F.col("seq") % 3 + 1) * 1_000_000).alias("persisted_at"),
    )


def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes(spark, sf_dir).filter("kind = 'failure'").select(
        F.concat(F.lit("f-"), F.col("seq")).alias("failure_id"),
        F.concat(F.lit("t-"), F.col("seq")).alias("trigger_message_id"),
        "conversation_id", "error_code",
        F.timestamp_micros("at_us").alias("occurred_at"),
    )


SCORES_SQL = (
    OUTCOMES_SQL
    + """,
score_rec AS (
  SELECT 's-' || seq AS mood_id, 't-' || seq AS trigger_message_id, customer_id, conversation_id, score,
         '-1 to 1' AS scale, model_version, at_us - at_us % 60000000 AS computed_us,
         at_us + (seq % 3 + 1) * 1000000 AS persisted_us
  FROM outcome WHERE kind = 'score'),
failure_rec AS (
  SELECT 'f-' || seq AS failure_id, 't-' || seq AS trigger_message_id, conversation_id, error_code,
         at_us AS occurred_us
  FROM outcome WHERE kind = 'failure')"""
)


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a quality label as regression examples: score -1 or 1,
    persona = language, group = source, context = the language's name."""
    return (
        spread(table(spark, sf_dir, "documents"))
        .join(table(spark, sf_dir, "labels"), "doc_id")
        .select(
            F.col("doc_id").cast("string").alias("example_id"),
            F.col("source").alias("customer_id"),
            F.col("lang").alias("persona"),
            "text",
            (F.col("quality") * 2.0 - 1.0).alias("label_score"),
        )
    )


def event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_messages_of(table(spark, sf_dir, "events"))


def event_messages_of(events: DataFrame) -> DataFrame:
    """Events as a long conversation per user, whose messages arrive up to four
    hours late; views are the agent's side."""
    ts_us = F.unix_micros(F.col("ts").cast("timestamp"))
    delay = F.col("event_id") * 7919 % 5 * 3_600_000_000 + F.col("event_id")
    return events.select(
        F.concat(F.lit("m-"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("message_id"),
        F.concat(F.lit("c-"), F.col("user_id")).alias("conversation_id"),
        F.concat(F.lit("customer-"), F.col("user_id") % 40).alias("customer_id"),
        F.when(F.col("event_type") == "view", "agent").otherwise("customer").alias("role"),
        F.concat_ws(" ", "event_type", "props").alias("text"),
        F.timestamp_micros(ts_us).alias("sent_at"),
        F.timestamp_micros(ts_us + delay).alias("received_at"),
    )


EVENT_MESSAGES_SQL = """
emsg AS (
  SELECT 'm-' || lpad(event_id::VARCHAR, 12, '0') AS message_id, 'c-' || user_id AS conversation_id,
         'customer-' || (user_id % 40) AS customer_id,
         CASE WHEN event_type = 'view' THEN 'agent' ELSE 'customer' END AS role,
         event_type || ' ' || props AS text, epoch_us(ts) AS sent_us,
         epoch_us(ts) + event_id * 7919 % 5 * 3600000000 + event_id AS recv_us
  FROM events)"""


def event_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as scored examples: a level as label, the value as prediction
    outside and inside [-1, 1], event type as persona, 0..3 context messages."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        e.cast("string").alias("example_id"),
        F.col("user_id").cast("string").alias("customer_id"),
        F.col("event_type").alias("persona"),
        ((e % 5 - 2) / 2.0).alias("label_score"),
        ((e % 5 - 2) / 4.0 + F.col("value") / 40 - 0.5).alias("prediction"),
        F.array_repeat(F.lit("x"), (e % 4).cast("int")).alias("context_clean"),
        F.concat(F.lit("mood-2024.0"), e % 2 + 1, F.lit("."), e % 6).alias("model_version"),
    )


EVENT_PREDICTIONS_SQL = """
pred AS (
  SELECT event_id::VARCHAR AS example_id, user_id::VARCHAR AS customer_id, event_type AS persona,
         (event_id % 5 - 2) / 2.0::DOUBLE AS label_score,
         greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (event_id % 5 - 2) / 4.0::DOUBLE + value / 40 - 0.5::DOUBLE)) AS prediction,
         event_id % 4 AS context_size,
         'mood-2024.0' || (event_id % 2 + 1) || '.' || (event_id % 6) AS model_version
  FROM events)"""

# Corpus lines in an SQL both engines read. One corpus has broken lines mixed in
# by line number, the other holds none but those its texts are too long for.
# Needs columns corpus, n (line number), conv_id, turn, role, text.
_BACKSLASH = "chr(92)"


def _json_string(column: str) -> str:
    """The whole text as a JSON string: the characters JSON cannot hold as they
    are get an escape."""
    sql = f"replace({column}, {_BACKSLASH}, {_BACKSLASH} || {_BACKSLASH})"
    for code, mark in ((34, "chr(34)"), (10, "'n'"), (13, "'r'"), (9, "'t'"), (8, "'b'"), (12, "'f'")):
        sql = f"replace({sql}, chr({code}), {_BACKSLASH} || {mark})"
    return f"chr(34) || {sql} || chr(34)"


_K = "CASE WHEN corpus = 'corpus-a' THEN n % 37 ELSE 0 END"
CORPUS_LINE_SQL = f"""
CASE
  WHEN k = 1 THEN '{{"corpus_id": "corpus-a", '
  WHEN k = 2 THEN '[1]'
  WHEN k = 3 THEN '{{"corpus_id": "corpus-a", "role": "customer"}}'
  WHEN k = 4 THEN '   '
  ELSE '{{"corpus_id": "' || CASE WHEN k = 5 THEN 'corpus-x' ELSE corpus END
    || '", "conversation_id": "syn-c' || conv_id
    || '", "customer_id": "syn-u' || CASE WHEN k = 6 THEN 999 ELSE conv_id % 40 END
    || '", "message_id": "' || CASE WHEN k = 7 THEN 'msg' ELSE 'syn-m' END || CASE WHEN corpus = 'corpus-c' THEN 'c' ELSE '' END
    || CASE WHEN k = 8 THEN n - 2 ELSE n END
    || '", "role": "' || CASE WHEN k = 9 OR role = 'system' THEN 'bot' WHEN role = 'user' THEN 'customer' ELSE 'agent' END
    || '", "text": ' || CASE WHEN k = 10 THEN '" "' WHEN k = 11 THEN '17' ELSE {_json_string("text")} END
    || ', "sent_at": "2024-01-' || CASE WHEN k = 12 THEN '' ELSE lpad(CAST(conv_id % 28 + 1 AS VARCHAR(9)), 2, '0') END
    || 'T00:' || lpad(CAST(CASE WHEN k = 13 THEN 0 WHEN k IN (14, 25) THEN 59 - turn ELSE turn END AS VARCHAR(9)), 2, '0') || ':00Z'
    || '", "persona": "' || CASE WHEN k = 15 THEN 'Bad Case' WHEN k = 16 THEN 'persona_z'
                                 ELSE 'persona_' || substr('abcde', CAST(conv_id % 40 % 5 + 1 AS INT), 1) END
    || '", ' || CASE WHEN k = 17 THEN '"extra": 1, ' WHEN k = 21 THEN '"corpus_id": "' || corpus || '", ' ELSE '' END || '"generated_label": '
    || CASE WHEN k = 18 THEN '"high"' WHEN k = 19 THEN '0.25' WHEN k = 20 THEN '1'
            WHEN role <> 'user' THEN 'null'
            WHEN (conv_id * 3 + turn) % 5 = 0 THEN '-1.0' WHEN (conv_id * 3 + turn) % 5 = 1 THEN '-0.5'
            WHEN (conv_id * 3 + turn) % 5 = 2 THEN '0' WHEN (conv_id * 3 + turn) % 5 = 3 THEN '0.5' ELSE '1.0' END
    || '}}'
END"""
_CORPUS = "CASE WHEN conv_id % 5 = 3 THEN 'corpus-c' ELSE 'corpus-a' END"


def corpus_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(corpus, line_no, value): all turns as lines of two corpora, whole texts.
    A system turn is a line whose role no rule admits."""
    from colloquy.operators.skew import with_position

    turns = table(spark, sf_dir, "conversations").withColumn("corpus", F.expr(_CORPUS))
    numbered = with_position(
        turns.withColumn("_at", F.col("conv_id") * 1_000_000 + F.col("turn")), ["corpus"], ["_at"], "n"
    )
    return numbered.withColumn("k", F.expr(_K)).select(
        "corpus", F.col("n").alias("line_no"), F.expr(CORPUS_LINE_SQL).alias("value")
    )


CORPUS_LINES_SQL = f"""
numbered AS (
  SELECT *, {_K} AS k FROM (
    SELECT corpus, row_number() OVER (PARTITION BY corpus ORDER BY conv_id, turn) AS n, conv_id, turn, role, text
    FROM (SELECT *, {_CORPUS} AS corpus FROM conversations))),
line AS (SELECT corpus, n AS line_no, {CORPUS_LINE_SQL} AS value FROM numbered)"""
