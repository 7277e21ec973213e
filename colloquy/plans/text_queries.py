"""Scalar text rules over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.functions import text as t
from colloquy.operators import dataset
from colloquy.plans.registry import query
from colloquy.session import spread
from colloquy.sources.tables import (
    EVENT_MESSAGES_SQL,
    MESSAGES_SQL,
    event_messages,
    messages,
    table,
)

# The whitespace class spelled out, for an engine whose \s is ASCII.
WS = (
    r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


def clean_sql(source: str, key: str, out: str = "cleaned") -> str:
    return f"""
stripped AS (SELECT *, regexp_replace(text, '^{WS}+|{WS}+$', '', 'g') AS st FROM {source}),
composed AS (SELECT *, nfc_normalize(regexp_replace(st, '{WS}+', ' ', 'g')) AS co FROM stripped),
visible AS (SELECT *, regexp_replace(co, '[\\p{{Cc}}\\p{{Cf}}]', '', 'g') AS vi FROM composed),
cleaned AS (SELECT * EXCLUDE (st, co, vi),
            CASE WHEN regexp_replace(vi, '{WS}+', '', 'g') = '' THEN st ELSE vi END AS {out} FROM visible)"""


def mask_sql(x: str) -> str:
    phone = rf"(?:\+55(?:{WS}|-)?)?(?:\(?\p{{Nd}}{{2}}\)?(?:{WS}|-)?)?9?\p{{Nd}}{{4}}-\p{{Nd}}{{4}}"
    for pattern, marker in (
        (r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "<EMAIL>"),
        (r"\p{Nd}{3}\.\p{Nd}{3}\.\p{Nd}{3}-\p{Nd}{2}", "<CPF>"),
        (phone, "<TEL>"),
        (r"\b\p{Nd}{10,11}\b", "<TEL>"),
    ):
        x = f"regexp_replace({x}, '{pattern}', '{marker}', 'g')"
    return x


def _count_sql(x: str) -> str:
    email = r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
    cpf = r"\p{Nd}{3}\.\p{Nd}{3}\.\p{Nd}{3}-\p{Nd}{2}"
    phone = rf"(?:\+55(?:{WS}|-)?)?(?:\(?\p{{Nd}}{{2}}\)?(?:{WS}|-)?)?9?\p{{Nd}}{{4}}-\p{{Nd}}{{4}}"
    raw = r"\b\p{Nd}{10,11}\b"
    a = f"regexp_replace({x}, '{email}', '<EMAIL>', 'g')"
    b = f"regexp_replace({a}, '{cpf}', '<CPF>', 'g')"
    c = f"regexp_replace({b}, '{phone}', '<TEL>', 'g')"
    return f"""len(regexp_extract_all({x}, '{email}'))::BIGINT AS email,
  len(regexp_extract_all({a}, '{cpf}'))::BIGINT AS cpf,
  (len(regexp_extract_all({b}, '{phone}')) + len(regexp_extract_all({c}, '{raw}')))::BIGINT AS phone"""


COUNT_SQL = _count_sql("text")


@query(
    "clean_text",
    f"WITH {clean_sql('documents', 'doc_id')} SELECT doc_id, length(cleaned)::INT AS n_chars, md5(cleaned) AS digest FROM cleaned",
)
def clean_text(spark, sf):
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    cleaned = t.with_clean(docs, "text", "cleaned")
    return cleaned.select("doc_id", F.length("cleaned").alias("n_chars"), F.md5("cleaned").alias("digest"))


@query("mask_text", f"SELECT doc_id, md5({mask_sql('text')}) AS digest FROM documents")
def mask_text(spark, sf):
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.md5(t.mask(F.col("text"))).alias("digest"))


@query("count_personal", f"SELECT doc_id, {COUNT_SQL} FROM documents")
def count_personal(spark, sf):
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return t.with_personal_counts(docs, "text").drop("text")


@query(
    "mask_idempotent",
    f"SELECT count(*) AS n, count(*) FILTER (WHERE {mask_sql(mask_sql('text'))} <> {mask_sql('text')}) AS changed FROM documents",
)
def mask_idempotent(spark, sf):
    docs = spread(table(spark, sf, "documents").select("text"))
    once = docs.select(t.mask(F.col("text")).alias("once"))
    twice = once.withColumn("twice", t.mask(F.col("once")))
    return twice.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("once") != F.col("twice")).alias("changed")
    )


_FEATURES = f"""
WITH {MESSAGES_SQL}, customer AS (SELECT * FROM msg WHERE role = 'customer'), {clean_sql('customer', 'message_id')},
prepared AS (SELECT *, {mask_sql('cleaned')} AS prep FROM cleaned),
framed AS (SELECT *, list(prep) OVER w AS h FROM prepared
           WINDOW w AS (PARTITION BY conversation_id ORDER BY sent_s, message_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
"""


@query(
    "feature_rows",
    _FEATURES
    + """SELECT message_id, h[-1] AS text_clean, (len(h) - 1)::INT AS n_context,
         md5(array_to_string(h[1:len(h) - 1], ' ')) AS context_digest FROM framed""",
)
def feature_rows(spark, sf):
    rows = dataset.feature_rows(messages(spark, sf))
    return rows.select(
        "message_id",
        "text_clean",
        F.size("context_clean").alias("n_context"),
        F.md5(t.join_context(F.col("context_clean"))).alias("context_digest"),
    )


@query(
    "history_windows",
    f"""WITH {EVENT_MESSAGES_SQL},
    framed AS (SELECT message_id, list(message_id) OVER (PARTITION BY conversation_id ORDER BY sent_us, message_id
               ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS h FROM emsg WHERE role = 'customer')
    SELECT message_id, len(h)::INT AS size, array_to_string(h, ',') AS history FROM framed""",
)
def history_windows(spark, sf):
    slim = event_messages(spark, sf).select("message_id", "conversation_id", "role", "sent_at")
    rows = dataset.history_windows(slim, F.col("message_id"))
    return rows.select(
        "message_id", F.size("history").alias("size"), F.array_join("history", ",").alias("history")
    )


@query(
    "join_context",
    f"""WITH {EVENT_MESSAGES_SQL},
    framed AS (SELECT message_id, list(text) OVER (PARTITION BY conversation_id ORDER BY sent_us, message_id
               ROWS BETWEEN 29 PRECEDING AND 1 PRECEDING) AS h FROM emsg WHERE role = 'customer')
    SELECT message_id, md5(coalesce(array_to_string(h, ' '), '')) AS digest FROM framed""",
)
def join_context(spark, sf):
    slim = event_messages(spark, sf).select("message_id", "conversation_id", "role", "sent_at", "text")
    rows = dataset.history_windows(slim, F.col("text"))
    _, earlier = t.split_history(F.col("history"))
    return rows.select("message_id", F.md5(t.join_context(earlier)).alias("digest"))


@query(
    "history_checks",
    """SELECT event_id, CASE WHEN event_id % 35 = 0 THEN 'history_empty'
         WHEN event_id % 35 > 30 THEN 'history_too_long'
         WHEN event_type = 'view' THEN 'history_role' END AS violation FROM events""",
)
def history_checks(spark, sf):
    events = table(spark, sf, "events")
    role = F.when(F.col("event_type") == "view", "agent").otherwise("customer")
    item = F.struct(role.alias("role"), F.col("props").alias("text"))
    history = F.array_repeat(item, (F.col("event_id") % 35).cast("int"))
    return events.select("event_id", t.history_violation(history).alias("violation"))
