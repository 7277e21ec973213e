"""The streams over the given tables, with the SQL of their batch meaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.functions import scalars as s
from colloquy.functions.text import with_prepared
from colloquy.operators import online
from colloquy.plans import regression, rule_queries, state_queries  # noqa: F401  their SQL is used below
from colloquy.plans.registry import ORACLES, query
from colloquy.session import is_folder, materialize, new_path
from colloquy.sources import tables as t
from colloquy.streaming import pipelines as p


def _stream(spark, sf, name):
    """The table as a stream, whether it is one file or a folder of files."""
    schema = t.table(spark, sf, name).schema
    if is_folder(spark, f"{sf}/{name}.parquet"):
        return p.read_stream(spark, f"{sf}/{name}.parquet", schema)
    return p.read_stream(spark, sf, schema, pattern=f"{name}.parquet")


@query("stream_admission", ORACLES["admit_messages"])
def stream_admission(spark, sf):
    odd = F.floor(F.unix_timestamp("sent_at") / 60) % 6 == 5
    arrivals = t.messages_of(_stream(spark, sf, "conversations")).withColumn(
        "customer_id", F.when(odd, "customer-x").otherwise(F.col("customer_id"))
    )
    reject = F.when(F.length("text") > s.MAX_TEXT, 413)
    out = new_path(spark, "admission")
    p.admission(arrivals, reject, out, new_path(spark, "admission-checkpoint"))
    return p.read_batches(spark, out, p.STATUSES).select("message_id", "status")


@query("stream_histories", ORACLES["online_histories"])
def stream_histories(spark, sf):
    out = new_path(spark, "histories")
    p.histories(t.event_messages_of(_stream(spark, sf, "events")), out, new_path(spark, "histories-checkpoint"))
    rows = p.read_batches(spark, out, p.HISTORIES)
    return rows.select("message_id", F.size("history_ids").alias("size"), F.array_join("history_ids", ",").alias("history"))


@query("stream_quarantine", ORACLES["replay_quarantine"])
def stream_quarantine(spark, sf):
    outcomes = t.outcomes_of(_stream(spark, sf, "events"))
    mark = (F.col("kind") == "failure") & (F.col("seq") % 9 == 0)
    marked = outcomes.withColumn("error_code", F.when(mark, "quarantined").otherwise(F.col("error_code")))
    out = new_path(spark, "quarantine")
    p.quarantine(marked, out, new_path(spark, "quarantine-checkpoint"))
    return p.read_batches(spark, out, p.OUTCOMES).select("seq", "outcome")


@query("stream_current_mood", ORACLES["conversation_mood"])
def stream_current_mood(spark, sf):
    scores = t.scores_of(t.outcomes_of(_stream(spark, sf, "events")))
    out = new_path(spark, "current-mood")
    p.maintain_current_mood(scores, "conversation_id", out, new_path(spark, "current-mood-checkpoint"))
    rows = p.mood_table(out, "conversation_id", scores.schema).read(spark)
    return rows.select("conversation_id", "mood_id", "score", F.unix_micros("computed_at").alias("computed_us"))


_VERSION = "mood-2024.02.0"


def _number():
    return F.substring("message_id", 3, 12).cast("long")


def _arrivals(messages):
    """Event messages of which some come from another customer."""
    odd = _number() % 23 == 7
    return messages.withColumn("customer_id", F.when(odd, "customer-x").otherwise(F.col("customer_id")))


def _sometimes(model):
    """The model, but every fifth message times out and every eleventh gets a value out of range."""

    def score(rows):
        made = model.predict(rows)
        return made.withColumns(
            {
                "error_code": F.when(_number() % 5 == 2, "timeout"),
                "prediction": F.when(_number() % 11 == 4, 2.5).otherwise(s.clip_score(F.col("prediction"))),
            }
        )

    return score


@query(
    "stream_scores",
    f"""WITH {t.EVENT_MESSAGES_SQL}, m AS (SELECT *, substr(message_id, 3)::BIGINT AS k FROM emsg),
    a AS (SELECT message_id, conversation_id, role, recv_us, k, CASE WHEN k % 23 = 7 THEN 'customer-x' ELSE customer_id END AS customer_id,
      CASE WHEN k % 17 = 3 THEN 413 END AS no FROM m),
    opened AS (SELECT conversation_id, min(recv_us) AS opened_at, min_by(customer_id, recv_us) AS owner FROM a
      WHERE no IS NULL AND role = 'customer' GROUP BY 1),
    st AS (SELECT a.*, CASE WHEN no IS NOT NULL THEN no WHEN opened_at IS NULL OR recv_us < opened_at THEN 422
      WHEN customer_id <> owner THEN 400 ELSE 200 END AS status FROM a LEFT JOIN opened USING (conversation_id)),
    q AS (SELECT *, k % 5 = 2 OR k % 11 = 4 AS bad FROM st WHERE status = 200 AND role = 'customer'),
    f AS (SELECT *, sum(bad::INT) OVER w AS fails FROM q WINDOW w AS (PARTITION BY conversation_id ORDER BY recv_us)),
    r AS (SELECT *, fails - coalesce(max(CASE WHEN NOT bad THEN fails END) OVER w, 0) AS streak FROM f
      WINDOW w AS (PARTITION BY conversation_id ORDER BY recv_us)),
    h AS (SELECT *, coalesce(max((streak >= 3)::INT) OVER (PARTITION BY conversation_id ORDER BY recv_us
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS held FROM r),
    o AS (SELECT message_id, customer_id, CASE WHEN held THEN 'quarantined' WHEN k % 5 = 2 THEN 'timeout'
      WHEN k % 11 = 4 THEN 'score_out_of_range' ELSE 'scored' END AS outcome FROM h)
    SELECT st.message_id, st.conversation_id, CASE WHEN outcome = 'scored' THEN o.customer_id END AS customer_id, st.status::INT AS status, outcome,
      CASE WHEN outcome = 'scored' THEN '-1 to 1' END AS scale,
      CASE WHEN outcome IN ('scored', 'score_out_of_range') THEN '{_VERSION}' END AS model_version,
      CASE WHEN outcome = 'scored' THEN true END AS as_in_batch FROM st LEFT JOIN o USING (message_id)""",
)
def stream_scores(spark, sf):
    """Every message with its status and what became of it, scored by a text regression fitted before. `as_in_batch`
    says whether the score is the one that the batch operators give for the same message."""
    events = t.table(spark, sf, "events")
    rated = with_prepared(t.event_messages_of(events), "text", "text_clean").select(
        "message_id", "text_clean", F.array().cast("array<string>").alias("context_clean")
    ).join(
        events.select(
            F.concat(F.lit("m-"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("message_id"),
            s.clip_score(F.col("value") / 50 - 1).alias("label_score"),
        ),
        "message_id",
    )
    model = regression.fit(rated, width=1 << 12, tol=1e-3)
    reject = F.when(_number() % 17 == 3, 413)
    out = new_path(spark, "stream-scores")
    stream = _arrivals(t.event_messages_of(_stream(spark, sf, "events")))
    p.score_stream(stream, reject, _sometimes(model), _VERSION, out, new_path(spark, "stream-scores-checkpoint"))
    statuses, scores, failures = p.recorded(spark, out)
    admitted = online.admit(_arrivals(t.event_messages_of(events)), reject, p.ARRIVAL).filter(
        "status = 200 AND role = 'customer'"
    )
    # written, since histories read it several times
    windows = online.online_histories(materialize(with_prepared(admitted, "text", "text"), "prepared"))
    batch = model.predict(
        windows.select(
            "message_id", F.element_at("history_texts", -1).alias("text_clean"),
            F.slice("history_texts", F.lit(1), F.size("history_texts") - 1).alias("context_clean"),
        )
    ).select("message_id", s.clip_score(F.col("prediction")).alias("expected"))
    good = scores.withColumnRenamed("trigger_message_id", "message_id").join(batch, "message_id").select(
        "message_id", "customer_id", F.lit("scored").alias("outcome"), "scale", "model_version",
        (F.abs(F.col("score") - F.col("expected")) < 1e-9).alias("as_in_batch"),
    )
    bad = failures.select(
        F.col("trigger_message_id").alias("message_id"), F.col("error_code").alias("outcome"), "model_version"
    )
    return statuses.join(good.unionByName(bad, allowMissingColumns=True), "message_id", "left")


@query("stream_redelivery", f"WITH {t.MESSAGES_SQL} SELECT message_id, conversation_id FROM msg")
def stream_redelivery(spark, sf):
    """Every message delivered twice, the second time months late, comes out once."""
    messages = t.messages_of(_stream(spark, sf, "conversations")).select("message_id", "conversation_id", "received_at")
    late = F.col("received_at") + F.expr("INTERVAL 90 DAYS")
    twice = messages.withColumn("received_at", F.explode(F.array("received_at", late)))
    rows = p.without_redelivery(twice).select("message_id", "conversation_id")
    return p.collect_stream(rows, "redelivery")
