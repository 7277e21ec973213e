"""Row rules of messages, scores, responses and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.functions import scalars as s
from colloquy.operators import metrics, online, state
from colloquy.plans.registry import query
from colloquy.sources.tables import (
    MESSAGES_SQL,
    SCORES_SQL,
    messages,
    scores,
    table,
)

# Arrivals that fail in every way there is, in an SQL both engines read.
_ROLE = "CASE WHEN (conv_id + turn) % 23 = 1 THEN 'robot' WHEN role = 'user' THEN 'customer' ELSE 'agent' END"
_TEXT = "CASE WHEN (conv_id + turn) % 17 = 2 THEN '  ' ELSE text END"
_STAMP = (
    "'2024-01-01T0' || (turn % 10) || ':00:00' || CASE (conv_id + turn) % 13 WHEN 1 THEN '' WHEN 2 THEN '+02:00'"
    " WHEN 3 THEN '-03:30' ELSE 'Z' END"
)


@query(
    "admission_checks",
    f"""WITH a AS (SELECT conv_id, turn, {_ROLE} AS r, {_TEXT} AS t, {_STAMP} AS ts FROM conversations)
    SELECT conv_id, turn, CASE WHEN r NOT IN ('customer', 'agent') THEN 400 WHEN trim(t) = '' THEN 400
      WHEN length(t) > 1000 THEN 413 WHEN NOT regexp_matches(ts, '(Z|[+-][0-9][0-9]:[0-9][0-9])$') THEN 400 END::INT AS reject_code
    FROM a""",
)
def admission_checks(spark, sf):
    rows = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.expr(_ROLE).alias("r"), F.expr(_TEXT).alias("t"), F.expr(_STAMP).alias("ts")
    )
    return rows.select("conv_id", "turn", s.reject_code(F.col("r"), F.col("t"), F.col("ts")).alias("reject_code"))


@query(
    "utc_times",
    f"""WITH a AS (SELECT conv_id, turn, {_STAMP} AS ts, turn % 10 AS h, (conv_id + turn) % 13 AS z FROM conversations)
    SELECT conv_id, turn, CASE WHEN z = 1 THEN NULL ELSE
      strftime(TIMESTAMP '2024-01-01' + to_minutes((h * 60 - CASE z WHEN 2 THEN 120 WHEN 3 THEN -210 ELSE 0 END)::BIGINT),
               '%Y-%m-%dT%H:%M:%S.%g') || 'Z' END AS utc FROM a""",
)
def utc_times(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.expr(_STAMP).alias("ts"))
    return rows.select("conv_id", "turn", s.iso_millis(s.to_utc(F.col("ts"))).alias("utc"))


@query(
    "score_checks",
    """SELECT event_id, x BETWEEN -1 AND 1 AND NOT isnan(x) AS in_range,
      CASE WHEN isnan(x) THEN NULL ELSE round(greatest(-1, least(1, x)), 9) END AS clipped FROM (
      SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 'NaN'::DOUBLE ELSE value / 40 - 1.2::DOUBLE END AS x FROM events)""",
)
def score_checks(spark, sf):
    raw = F.when(F.col("event_id") % 50 == 0, float("nan")).otherwise(F.col("value") / 40 - 1.2)
    rows = table(spark, sf, "events").select("event_id", raw.alias("x"))
    return rows.select(
        "event_id",
        s.in_range(F.col("x")).alias("in_range"),
        F.round(F.nanvl(s.clip_score(F.col("x")), F.lit(None).cast("double")), 9).alias("clipped"),
    )


_BODY = (
    "CASE event_id % 7 WHEN 0 THEN 'oops' WHEN 1 THEN '{\"score\": 0.5}'"
    " ELSE '{\"score\": ' || CAST(CAST(event_id % 30 AS DOUBLE) / 10 - 1 AS VARCHAR(30)) ||"
    " ', \"scale\": \"-1 to 1\", \"model_version\": \"mood-2024.01.0\", \"computed_at\": \"2024-01-01T00:00:00Z\"}' END"
)
_OUTCOME = "CASE event_id % 11 WHEN 0 THEN 'timeout' WHEN 1 THEN 'unreachable' ELSE 'answered' END"
_STATUS = "CASE event_id % 13 WHEN 0 THEN 503 WHEN 1 THEN 422 ELSE 200 END"


@query(
    "response_errors",
    f"""SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'timeout' WHEN event_id % 11 = 1 THEN 'ml_unavailable'
      WHEN event_id % 13 = 0 THEN 'ml_unavailable' WHEN event_id % 13 = 1 THEN 'invalid_response'
      WHEN event_id % 7 < 2 THEN 'invalid_response'
      WHEN TRY_CAST(json_extract_string({_BODY}, '$.score') AS DOUBLE) NOT BETWEEN -1 AND 1 THEN 'score_out_of_range'
      END AS error_code FROM events""",
)
def response_errors(spark, sf):
    rows = table(spark, sf, "events").select(
        "event_id", F.expr(_OUTCOME).alias("outcome"), F.expr(_STATUS).alias("status"), F.expr(_BODY).alias("body")
    )
    return rows.select(
        "event_id", s.response_error(F.col("outcome"), F.col("status"), F.col("body")).alias("error_code")
    )


_MOOD = """CASE WHEN x IS NULL THEN '{0}' WHEN x <= -0.6 THEN '{1}' WHEN x <= -0.2 THEN '{2}' WHEN x < 0.2 THEN '{3}'
  WHEN x < 0.6 THEN '{4}' ELSE '{5}' END"""
_EMOJI_SQL = _MOOD.format("❔", "😠", "🙁", "😐", "🙂", "😄")
_LABEL_SQL = _MOOD.format("Sem dados de humor ainda", "Muito negativo", "Negativo", "Neutro", "Positivo", "Muito positivo")


@query(
    "mood_buckets",
    f"""WITH {SCORES_SQL}, v AS (SELECT mood_id, CASE WHEN substr(mood_id, -1) = '7' THEN NULL
      WHEN substr(mood_id, -1) = '8' THEN abs(score) * 2 - 1 ELSE score END AS x FROM score_rec)
    SELECT mood_id, {_EMOJI_SQL} AS emoji, {_LABEL_SQL} AS mood FROM v""",
)
def mood_buckets(spark, sf):
    last = F.substring("mood_id", -1, 1)
    rows = scores(spark, sf).select(
        "mood_id",
        F.when(last == "7", None).when(last == "8", F.abs("score")).otherwise(F.col("score")).alias("x"),
        F.when(last == "8", s.UNIT_SCALE).otherwise(s.SCALE).alias("scale"),
    )
    return rows.select(
        "mood_id",
        s.mood_emoji(F.col("x"), F.col("scale")).alias("emoji"),
        s.mood_label(F.col("x"), F.col("scale")).alias("mood"),
    )


@query(
    "display_rows",
    f"""WITH {MESSAGES_SQL},
    conv AS (SELECT conversation_id, arg_min(customer_id, (recv_s, message_id)) AS customer_id,
                    arg_max(sent_s, (recv_s, message_id)) AS last_s FROM msg GROUP BY 1),
    {SCORES_SQL},
    mood AS (SELECT conversation_id, score AS x FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id
             ORDER BY computed_us DESC, persisted_us DESC, mood_id DESC) AS rn FROM score_rec) WHERE rn = 1),
    j AS (SELECT conv.*, x, upper(substr(regexp_replace(customer_id, '^customer-', ''), 1, 4)) AS short
          FROM conv LEFT JOIN mood USING (conversation_id))
    SELECT conversation_id, customer_id, 'Hóspede ' || short AS customer_name, substr(short, 1, 2) AS initials,
      strftime(make_timestamp(last_s * 1000000), '%H:%M') AS last_seen, {_EMOJI_SQL} AS emoji, {_LABEL_SQL} AS mood FROM j""",
)
def display_rows(spark, sf):
    return state.display_rows(state.inbox(messages(spark, sf), scores(spark, sf)))


@query(
    "model_compatibility",
    f"""WITH {SCORES_SQL}, v AS (SELECT mood_id, split_part(model_version, '.', 3)::INT AS k FROM score_rec)
    SELECT mood_id, CASE WHEN k = 1 THEN 'feature_spec_version' WHEN k IN (2, 3) THEN 'history_window'
      WHEN k = 4 THEN 'history_scope' WHEN k = 5 THEN 'algorithm' END AS mismatch FROM v""",
)
def model_compatibility(spark, sf):
    records = scores(spark, sf)
    k = s.version_parts(F.col("model_version"))["number"]
    # one manifest per model version
    manifests = records.select("model_version").distinct().select(
        "model_version",
        F.when(k == 1, "fs-0").otherwise("fs-1").alias("feature_spec_version"),
        F.when(k.isin(2, 3), 10).otherwise(30).alias("history_window"),
        F.when(k.isin(3, 4), "customer").otherwise("conversation").alias("history_scope"),
        F.when(k == 5, "other").otherwise("tfidf-ridge").alias("algorithm"),
    )
    names = ("feature_spec_version", "history_window", "history_scope", "algorithm")
    return records.join(manifests, "model_version").select(
        "mood_id", s.incompatibility({n: F.col(n) for n in names}).alias("mismatch")
    )


@query(
    "next_versions",
    f"""WITH {SCORES_SQL} SELECT 2024 AS year, 1 AS month,
      'mood-2024.01.' || (max(split_part(model_version, '.', 3)::INT) + 1) AS next_version FROM score_rec""",
)
def next_versions(spark, sf):
    return metrics.next_version(scores(spark, sf))


@query(
    "admit_messages",
    f"""WITH {MESSAGES_SQL},
    a AS (SELECT *, CASE WHEN length(text) > 1000 THEN 413 END AS reject,
            CASE WHEN (sent_s // 60) % 6 = 5 THEN 'customer-x' ELSE customer_id END AS cust FROM msg),
    o AS (SELECT *, min(CASE WHEN reject IS NULL AND role = 'customer' THEN (recv_s, message_id) END)
                    OVER (PARTITION BY conversation_id) AS opened FROM a),
    w AS (SELECT *, max(CASE WHEN (recv_s, message_id) = opened THEN cust END) OVER (PARTITION BY conversation_id) AS owner FROM o)
    SELECT message_id, CASE WHEN reject IS NOT NULL THEN reject
      WHEN opened IS NULL OR (recv_s, message_id) < opened THEN 422 WHEN cust <> owner THEN 400 ELSE 200 END::INT AS status FROM w""",
)
def admit_messages(spark, sf):
    odd = F.floor(F.unix_timestamp("sent_at") / 60) % 6 == 5
    arrivals = messages(spark, sf).withColumn(
        "customer_id", F.when(odd, "customer-x").otherwise(F.col("customer_id"))
    )
    reject = F.when(F.length("text") > s.MAX_TEXT, 413)
    return online.admit(arrivals, reject, ["received_at", "message_id"]).select("message_id", "status")
