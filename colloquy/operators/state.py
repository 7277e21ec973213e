"""Current mood, inbox, transcripts, erasure and coverage, all derived from the
append-only facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.scalars import clock, mood_emoji, mood_label, short_name, stale
from colloquy.operators.skew import lookup_join, with_position


def latest_by(scores: DataFrame, key: str) -> DataFrame:
    """Newest score record of each key by computed, then stored time, then id.

    `max_by` keeps one record per key and task, so a hot key costs no more than
    the others; a ranking window would sort all of its rows in one task."""
    record = F.struct(*scores.columns)
    recency = F.struct("computed_at", "persisted_at", "mood_id")
    return scores.groupBy(F.col(key).alias("_key")).agg(F.max_by(record, recency).alias("r")).select("r.*")


def conversation_mood(scores: DataFrame) -> DataFrame:
    return latest_by(scores, "conversation_id")


def customer_mood(scores: DataFrame) -> DataFrame:
    """One conversation's newest record per customer, never an average; a
    customer without a score has no row."""
    return latest_by(scores, "customer_id")


def conversations(messages: DataFrame, mode: str = "last_arrival") -> DataFrame:
    """Conversation dimension from the messages in arrival order. The last
    message time is that of the last arrival, so it can move back; `mode='max'`
    takes the greatest instead."""
    arrival = F.struct("received_at", "message_id")
    last = F.max("sent_at") if mode == "max" else F.max_by("sent_at", arrival)
    return (
        messages.groupBy("conversation_id")
        .agg(
            F.min_by("customer_id", arrival).alias("customer_id"),
            F.min_by("sent_at", arrival).alias("started_at"),
            last.alias("last_message_at"),
        )
        .withColumns({"status": F.lit("open"), "closed_at": F.lit(None).cast("timestamp")})
    )


def customers(messages: DataFrame, mode: str = "last_arrival") -> DataFrame:
    arrival = F.struct("received_at", "message_id")
    last = F.max("sent_at") if mode == "max" else F.max_by("sent_at", arrival)
    return messages.groupBy("customer_id").agg(
        F.min_by("sent_at", arrival).alias("first_seen_at"), last.alias("last_message_at")
    )


def transcripts(messages: DataFrame, page_size: int = 500, rows: int | None = None) -> DataFrame:
    """Messages of each conversation in order, as arrays of at most `page_size`.
    A usual conversation is one page; a very long one is many, and whole."""
    slim = messages.select("conversation_id", "message_id", "role", "text", "sent_at", "received_at")
    placed = with_position(
        slim, ["conversation_id"], ["sent_at", "received_at", "message_id"], "_p", rows
    )
    entry = F.struct(F.col("_p").alias("position"), "message_id", "role", "text", "sent_at")
    return (
        placed.withColumn("page", F.floor((F.col("_p") - 1) / page_size).cast("long"))
        .groupBy("conversation_id", "page")
        .agg(F.sort_array(F.collect_list(entry)).alias("messages"))
    )


def inbox(messages: DataFrame, scores: DataFrame, limit: int | None = None) -> DataFrame:
    """Conversations, newest message first, with their own current mood or null.
    With `limit` Spark keeps a top-k instead of a full sort."""
    mood = conversation_mood(scores).select("conversation_id", "score", "scale")
    rows = (
        conversations(messages)
        .select("conversation_id", "customer_id", "last_message_at")
        .join(mood, "conversation_id", "left")
        .orderBy(F.desc("last_message_at"), "conversation_id")
    )
    return rows.limit(limit) if limit is not None else rows


def shown_mood(conversations_: DataFrame, scores: DataFrame) -> DataFrame:
    """The customer's current mood on the one conversation it belongs to; null,
    not neutral, on the others."""
    mood = customer_mood(scores).select("customer_id", "conversation_id", "score", "scale")
    return conversations_.join(mood, ["customer_id", "conversation_id"], "left")


def display_rows(inbox_rows: DataFrame) -> DataFrame:
    short = short_name(F.col("customer_id"))
    scale = F.coalesce("scale", F.lit("-1 to 1"))
    return inbox_rows.select(
        "conversation_id",
        "customer_id",
        F.concat(F.lit("Hóspede "), short).alias("customer_name"),
        F.substring(short, 1, 2).alias("initials"),
        clock(F.col("last_message_at")).alias("last_seen"),
        mood_emoji(F.col("score"), scale).alias("emoji"),
        mood_label(F.col("score"), scale).alias("mood"),
    )


def conversations_per_customer(conversations_: DataFrame) -> DataFrame:
    return conversations_.groupBy("customer_id").agg(F.count(F.lit(1)).alias("conversations"))


def erase(
    requests: DataFrame,
    messages: DataFrame,
    scores: DataFrame,
    failures: DataFrame,
    conversations_: DataFrame,
    customers_: DataFrame,
    rows: int | None = None,
) -> dict[str, DataFrame]:
    """What remains of every table after the requested conversations are erased,
    customers left without a conversation included, and one result per request:
    204 when erased, 404 when unknown."""
    wanted = requests.select("conversation_id").distinct()

    def without(df: DataFrame) -> DataFrame:
        return lookup_join(df, wanted, ["conversation_id"], "left_anti", rows)

    remaining = conversations_.join(wanted, "conversation_id", "left_anti")
    erased_owners = conversations_.join(wanted, "conversation_id", "left_semi").select("customer_id").distinct()
    orphans = erased_owners.join(remaining.select("customer_id").distinct(), "customer_id", "left_anti")
    known = conversations_.select("conversation_id", F.lit(True).alias("_known"))
    return {
        "messages": without(messages),
        "scores": without(scores),
        "failures": without(failures),
        "conversations": remaining,
        "customers": customers_.join(orphans, "customer_id", "left_anti"),
        "results": wanted.join(known, "conversation_id", "left").select(
            "conversation_id", F.when(F.col("_known"), 204).otherwise(404).alias("status")
        ),
    }


def coverage(messages: DataFrame, scores: DataFrame, failures: DataFrame) -> DataFrame:
    """Each customer message with what became of it: scored, failed or nothing."""
    scored = scores.select(F.col("trigger_message_id").alias("message_id")).distinct()
    failed = failures.select(F.col("trigger_message_id").alias("message_id")).distinct()
    return (
        messages.filter(F.col("role") == "customer")
        .select("message_id", "conversation_id")
        .join(scored.withColumn("_scored", F.lit(True)), "message_id", "left")
        .join(failed.withColumn("_failed", F.lit(True)), "message_id", "left")
        .select(
            "message_id",
            "conversation_id",
            F.when(F.col("_scored"), "scored").when(F.col("_failed"), "failed").otherwise("missing").alias("outcome"),
        )
    )


def failures_after_success(
    scores: DataFrame, failures: DataFrame, keys: Sequence[str] = ("conversation_id",),
    rows: int | None = None,
) -> DataFrame:
    """Failures strictly later than their conversation's last stored score, or
    all of them where it has none."""
    last = scores.groupBy(*keys).agg(F.max("persisted_at").alias("_last"))
    joined = lookup_join(failures, last, list(keys), "left", rows)
    return joined.filter(
        (F.col("_last").isNull() | (F.col("occurred_at") > F.col("_last")))
        & (F.col("error_code") != "quarantined")
    ).drop("_last")


def staleness(scores: DataFrame, now: Column, seconds: int) -> DataFrame:
    return conversation_mood(scores).withColumn("stale", stale(now, F.col("computed_at"), seconds))
