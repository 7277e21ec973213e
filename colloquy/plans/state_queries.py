"""Current mood, inbox, transcripts, erasure, coverage, quarantine."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.operators import online, state
from colloquy.plans.registry import query
from colloquy.session import new_path
from colloquy.sources.erasure import erase_rows
from colloquy.sources.lineage import migrate_legacy
from colloquy.sources.tables import (
    EVENT_MESSAGES_SQL,
    MESSAGES_SQL,
    OUTCOMES_SQL,
    SCORES_SQL,
    event_messages,
    failures,
    messages,
    outcomes,
    scores,
    table,
)


def _latest(key: str, name: str) -> str:
    return f"""{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key}
      ORDER BY computed_us DESC, persisted_us DESC, mood_id DESC) AS rn FROM score_rec) WHERE rn = 1)"""


_CONV = """conv AS (SELECT conversation_id, arg_min(customer_id, (recv_s, message_id)) AS customer_id,
  arg_min(sent_s, (recv_s, message_id)) AS started_s, arg_max(sent_s, (recv_s, message_id)) AS last_s FROM msg GROUP BY 1)"""


def _s(column: str):
    return F.unix_timestamp(column)


@query("conversation_mood", f"WITH {SCORES_SQL}, {_latest('conversation_id', 'l')} SELECT conversation_id, mood_id, score, computed_us FROM l")
def conversation_mood(spark, sf):
    rows = state.conversation_mood(scores(spark, sf))
    return rows.select("conversation_id", "mood_id", "score", F.unix_micros("computed_at").alias("computed_us"))


@query(
    "customer_mood",
    f"WITH {SCORES_SQL}, {_latest('customer_id', 'l')} SELECT customer_id, conversation_id, mood_id, score, scale, model_version FROM l",
)
def customer_mood(spark, sf):
    rows = state.customer_mood(scores(spark, sf))
    return rows.select("customer_id", "conversation_id", "mood_id", "score", "scale", "model_version")


@query(
    "transcripts",
    f"""WITH {EVENT_MESSAGES_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY sent_us, recv_us, message_id) AS k FROM emsg)
    SELECT conversation_id, (k - 1) // 20 AS page, count(*)::INT AS size, md5(string_agg(message_id || role || text, '|' ORDER BY k)) AS digest
    FROM p GROUP BY 1, 2""",
)
def transcripts(spark, sf):
    pages = state.transcripts(event_messages(spark, sf), 20)
    line = F.transform("messages", lambda m: F.concat(m["message_id"], m["role"], m["text"]))
    return pages.select(
        "conversation_id", "page", F.size("messages").alias("size"), F.md5(F.array_join(line, "|")).alias("digest")
    )


@query(
    "inbox",
    f"""WITH {MESSAGES_SQL}, {_CONV}, {SCORES_SQL}, {_latest('conversation_id', 'l')}
    SELECT conversation_id, conv.customer_id, last_s, score, scale FROM conv LEFT JOIN l USING (conversation_id)""",
)
def inbox(spark, sf):
    rows = state.inbox(messages(spark, sf), scores(spark, sf))
    return rows.select("conversation_id", "customer_id", _s("last_message_at").alias("last_s"), "score", "scale")


@query(
    "inbox_top",
    f"""WITH {MESSAGES_SQL}, {_CONV} SELECT conversation_id, last_s FROM conv ORDER BY last_s DESC, conversation_id LIMIT 20""",
)
def inbox_top(spark, sf):
    rows = state.inbox(messages(spark, sf), scores(spark, sf), 20)
    return rows.select("conversation_id", _s("last_message_at").alias("last_s"))


@query(
    "shown_mood",
    f"""WITH {MESSAGES_SQL}, {_CONV}, {SCORES_SQL}, {_latest('customer_id', 'l')}
    SELECT conversation_id, customer_id, score, scale FROM conv LEFT JOIN l USING (customer_id, conversation_id)""",
)
def shown_mood(spark, sf):
    rows = state.shown_mood(state.conversations(messages(spark, sf)), scores(spark, sf))
    return rows.select("conversation_id", "customer_id", "score", "scale")


@query(
    "conversation_dimension",
    f"""WITH {MESSAGES_SQL}, {_CONV}, top AS (SELECT conversation_id, max(sent_s) AS greatest_s FROM msg GROUP BY 1)
    SELECT conversation_id, customer_id, started_s, last_s, greatest_s, 'open' AS status FROM conv JOIN top USING (conversation_id)""",
)
def conversation_dimension(spark, sf):
    m = messages(spark, sf)
    greatest = state.conversations(m, "max").select("conversation_id", _s("last_message_at").alias("greatest_s"))
    rows = state.conversations(m).select(
        "conversation_id", "customer_id", _s("started_at").alias("started_s"), _s("last_message_at").alias("last_s"), "status"
    )
    return rows.join(greatest, "conversation_id")


@query(
    "customer_dimension",
    f"""WITH {MESSAGES_SQL} SELECT customer_id, arg_min(sent_s, (recv_s, message_id)) AS first_s,
    arg_max(sent_s, (recv_s, message_id)) AS last_s FROM msg GROUP BY 1""",
)
def customer_dimension(spark, sf):
    rows = state.customers(messages(spark, sf))
    return rows.select("customer_id", _s("first_seen_at").alias("first_s"), _s("last_message_at").alias("last_s"))


@query(
    "conversations_per_customer",
    f"WITH {MESSAGES_SQL}, {_CONV} SELECT customer_id, count(*) AS conversations FROM conv GROUP BY 1",
)
def conversations_per_customer(spark, sf):
    return state.conversations_per_customer(state.conversations(messages(spark, sf)))


_ERASE = f"""WITH {MESSAGES_SQL}, {_CONV}, {SCORES_SQL},
req AS (SELECT DISTINCT 'c-' || conv_id AS conversation_id FROM conversations WHERE conv_id % 40 < 5 OR conv_id % 7 = 0
        UNION SELECT DISTINCT 'x-' || conv_id FROM conversations),
keep AS (SELECT * FROM conv WHERE conversation_id NOT IN (SELECT conversation_id FROM req))"""


def _erased(spark, sf):
    convs = table(spark, sf, "conversations").select("conv_id").distinct()
    known = convs.filter("conv_id % 40 < 5 OR conv_id % 7 = 0").select(F.concat(F.lit("c-"), "conv_id").alias("conversation_id"))
    unknown = convs.select(F.concat(F.lit("x-"), "conv_id").alias("conversation_id"))
    m = messages(spark, sf)
    return state.erase(
        known.unionAll(unknown), m, scores(spark, sf), failures(spark, sf), state.conversations(m), state.customers(m)
    )


@query(
    "erase_conversations",
    _ERASE
    + """ SELECT 'messages' AS target, count(*) AS n FROM msg WHERE conversation_id NOT IN (SELECT conversation_id FROM req)
    UNION ALL SELECT 'scores', count(*) FROM score_rec WHERE conversation_id NOT IN (SELECT conversation_id FROM req)
    UNION ALL SELECT 'failures', count(*) FROM failure_rec WHERE conversation_id NOT IN (SELECT conversation_id FROM req)
    UNION ALL SELECT 'conversations', count(*) FROM keep
    UNION ALL SELECT 'customers', count(DISTINCT customer_id) FROM keep
    UNION ALL SELECT 'results', count(*) FROM req""",
)
def erase_conversations(spark, sf):
    result = None
    for name, df in _erased(spark, sf).items():
        n = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("target"), "n")
        result = n if result is None else result.unionAll(n)
    return result


@query(
    "erase_results",
    _ERASE + " SELECT conversation_id, CASE WHEN conversation_id IN (SELECT conversation_id FROM conv) THEN 204 ELSE 404 END::INT AS status FROM req",
)
def erase_results(spark, sf):
    return _erased(spark, sf)["results"]


@query(
    "erase_stored",
    f"WITH {MESSAGES_SQL} SELECT message_id, conversation_id, text FROM msg WHERE substr(conversation_id, 3)::BIGINT % 11 <> 4",
)
def erase_stored(spark, sf):
    """Messages in a stored table from which every eleventh conversation is erased."""
    path = new_path(spark, "stored-messages")
    messages(spark, sf).select("message_id", "conversation_id", "text").repartitionByRange(16, "conversation_id").write.parquet(path)
    everyone = table(spark, sf, "conversations").select("conv_id").distinct()
    wanted = everyone.filter("conv_id % 11 = 4").select(F.concat(F.lit("c-"), "conv_id").alias("conversation_id"))
    erase_rows(spark, path, wanted)
    return spark.read.parquet(path)


@query(
    "coverage",
    f"""WITH {EVENT_MESSAGES_SQL}, {SCORES_SQL},
    s AS (SELECT 'm-' || lpad(substr(trigger_message_id, 3), 12, '0') AS message_id FROM score_rec WHERE substr(mood_id, -1) <> '3'),
    f AS (SELECT 'm-' || lpad(substr(trigger_message_id, 3), 12, '0') AS message_id FROM failure_rec WHERE substr(failure_id, -1) <> '4')
    SELECT message_id, conversation_id, CASE WHEN message_id IN (SELECT message_id FROM s) THEN 'scored'
      WHEN message_id IN (SELECT message_id FROM f) THEN 'failed' ELSE 'missing' END AS outcome FROM emsg WHERE role = 'customer'""",
)
def coverage(spark, sf):
    def as_message(df, key, digit):
        mid = F.concat(F.lit("m-"), F.lpad(F.expr("substr(trigger_message_id, 3)"), 12, "0"))
        return df.filter(F.substring(key, -1, 1) != digit).withColumn("trigger_message_id", mid)

    return state.coverage(
        event_messages(spark, sf), as_message(scores(spark, sf), "mood_id", "3"), as_message(failures(spark, sf), "failure_id", "4")
    )


@query(
    "failures_after_success",
    f"""WITH {SCORES_SQL}, l AS (SELECT conversation_id, max(persisted_us) AS m FROM score_rec GROUP BY 1)
    SELECT failure_id, conversation_id, error_code FROM failure_rec LEFT JOIN l USING (conversation_id)
    WHERE m IS NULL OR occurred_us > m""",
)
def failures_after_success(spark, sf):
    rows = state.failures_after_success(scores(spark, sf), failures(spark, sf))
    return rows.select("failure_id", "conversation_id", "error_code")


@query(
    "stale_moods",
    f"""WITH {SCORES_SQL}, {_latest('conversation_id', 'l')} SELECT conversation_id,
    epoch_us(TIMESTAMP '2024-01-30 12:00:00') - computed_us > 43200000000 AS stale FROM l""",
)
def stale_moods(spark, sf):
    now = F.lit("2024-01-30 12:00:00").cast("timestamp")
    return state.staleness(scores(spark, sf), now, 43_200).select("conversation_id", "stale")


# Outcomes with some quarantine records among the failures.
_MARKED = f"""{OUTCOMES_SQL},
marked AS (SELECT * REPLACE (CASE WHEN kind = 'failure' AND seq % 9 = 0 THEN 'quarantined' ELSE error_code END AS error_code) FROM outcome),
counted AS (SELECT *, (kind = 'failure' AND error_code <> 'quarantined')::INT AS fail, (kind = 'score')::INT AS okay,
  sum((kind = 'score')::INT) OVER (PARTITION BY conversation_id ORDER BY at_us, seq) AS island FROM marked),
streak AS (SELECT *, sum(fail) OVER (PARTITION BY conversation_id, island ORDER BY at_us, seq)::BIGINT AS failures FROM counted),
before AS (SELECT *, coalesce(lag(failures) OVER (PARTITION BY conversation_id ORDER BY at_us, seq), 0)::BIGINT AS failures_before FROM streak)"""


def _marked(spark, sf):
    mark = (F.col("kind") == "failure") & (F.col("seq") % 9 == 0)
    return outcomes(spark, sf).withColumn("error_code", F.when(mark, "quarantined").otherwise(F.col("error_code")))


@query("failure_streaks", f"WITH {_MARKED} SELECT seq, failures FROM streak")
def failure_streaks(spark, sf):
    return online.failure_streaks(_marked(spark, sf)).select("seq", "failures")


@query("quarantine_state", f"WITH {_MARKED} SELECT seq, failures_before, failures_before >= 3 AS blocked FROM before")
def quarantine_state(spark, sf):
    return online.quarantine_state(_marked(spark, sf)).select("seq", "failures_before", "blocked")


@query(
    "replay_quarantine",
    f"""WITH {_MARKED}, hit AS (SELECT conversation_id, min((at_us, seq)) AS h FROM streak WHERE failures >= 3 GROUP BY 1)
    SELECT seq, CASE WHEN h IS NOT NULL AND (at_us, seq) > h THEN 'quarantined' WHEN kind = 'score' THEN 'scored'
      ELSE error_code END AS outcome FROM streak LEFT JOIN hit USING (conversation_id)""",
)
def replay_quarantine(spark, sf):
    return online.replay_quarantine(_marked(spark, sf)).select("seq", "outcome")


@query(
    "outcome_timeline",
    f"""WITH {SCORES_SQL} SELECT mood_id AS id, conversation_id, 'score' AS kind, persisted_us AS at_us, score, NULL AS error_code FROM score_rec
    UNION ALL SELECT failure_id, conversation_id, 'failure', occurred_us, NULL, error_code FROM failure_rec""",
)
def outcome_timeline(spark, sf):
    return online.timeline(scores(spark, sf), failures(spark, sf))


@query(
    "online_histories",
    f"""WITH {EVENT_MESSAGES_SQL}, cust AS (SELECT * FROM emsg WHERE role = 'customer'),
    earlier AS (SELECT t.message_id, o.message_id AS other, row_number() OVER (PARTITION BY t.message_id
        ORDER BY o.sent_us DESC, o.recv_us DESC, o.message_id DESC) AS rn
      FROM cust t JOIN cust o ON o.conversation_id = t.conversation_id AND o.recv_us < t.recv_us),
    h AS (SELECT message_id, string_agg(other, ',' ORDER BY rn DESC) AS prior, count(*) AS k FROM earlier WHERE rn <= 29 GROUP BY 1)
    SELECT message_id, (coalesce(k, 0) + 1)::INT AS size, concat_ws(',', prior, message_id) AS history FROM cust LEFT JOIN h USING (message_id)""",
)
def online_histories(spark, sf):
    rows = online.online_histories(event_messages(spark, sf), texts=False)
    return rows.select("message_id", F.size("history_ids").alias("size"), F.array_join("history_ids", ",").alias("history"))


@query(
    "migrate_legacy",
    f"""WITH {MESSAGES_SQL}
    SELECT 'customers' AS target, customer_id AS id, min(sent_s) AS first_s, max(sent_s) AS last_s FROM msg GROUP BY 2
    UNION ALL SELECT 'conversations', conversation_id, min(sent_s), max(sent_s) FROM msg GROUP BY 2, customer_id
    UNION ALL SELECT 'messages', message_id, sent_s, sent_s FROM msg""",
)
def migrate(spark, sf):
    legacy = messages(spark, sf).select(
        F.col("message_id").alias("id"), "conversation_id", "customer_id", "role",
        F.col("text").alias("message"), F.col("sent_at").alias("timestamp"),
    )
    t = migrate_legacy(legacy)
    return (
        t["customers"].select(F.lit("customers").alias("target"), F.col("customer_id").alias("id"),
                              _s("first_seen_at").alias("first_s"), _s("last_message_at").alias("last_s"))
        .unionAll(t["conversations"].select(F.lit("conversations"), "conversation_id", _s("started_at"), _s("last_message_at")))
        .unionAll(t["messages"].select(F.lit("messages"), "message_id", _s("sent_at"), _s("received_at")))
    )
