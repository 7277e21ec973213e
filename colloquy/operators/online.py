"""Admission, the online history window and the quarantine rule in batch form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.scalars import HISTORY_WINDOW
from colloquy.operators.skew import lookup_join, running, with_position, with_segments
from colloquy.session import materialize

QUARANTINE_AFTER = 3


def admit(
    arrivals: DataFrame, reject: Column, order: list[str], rows: int | None = None, known: DataFrame | None = None
) -> DataFrame:
    """Arrivals with `status`: 200, or why each was turned away.

    A message that fails its own checks (`reject`) is never considered. An agent
    cannot open a conversation (422). The first admissible customer message opens
    it and fixes the owner; any other customer id is turned away from then on
    (400). Opening row and owner are one aggregate per conversation. `known` holds
    (conversation_id, owner) of conversations that were open before."""
    checked = arrivals.withColumn("_reject", reject)
    arrival = F.struct(*order)
    opened = _openings(checked, order)
    if known is not None:
        before_all = known.select("conversation_id", F.col("owner").alias("_known"))
        opened = opened.join(before_all, "conversation_id", "full").select(
            "conversation_id", F.coalesce("_known", "_owner").alias("_owner"),
            F.when(F.col("_known").isNull(), F.col("_opened")).alias("_opened"),
        )
    joined = lookup_join(checked, opened, ["conversation_id"], "left", rows)
    before = F.col("_owner").isNull() | F.coalesce(arrival < F.col("_opened"), F.lit(False))
    status = (
        F.when(F.col("_reject").isNotNull(), F.col("_reject"))
        .when(before, 422)
        .when(F.col("customer_id") != F.col("_owner"), 400)
        .otherwise(200)
    )
    return joined.withColumn("status", status).drop("_reject", "_opened", "_owner")


def _openings(checked: DataFrame, order: list[str]) -> DataFrame:
    opens = F.col("_reject").isNull() & (F.col("role") == "customer") & F.col("customer_id").isNotNull()
    arrival = F.struct(*order)
    return (
        checked.filter(opens)
        .groupBy("conversation_id")
        .agg(F.min_by("customer_id", arrival).alias("_owner"), F.min(arrival).alias("_opened"))
    )


def owners(arrivals: DataFrame, reject: Column, order: list[str]) -> DataFrame:
    """(conversation_id, owner) of the conversations that `arrivals` can open."""
    opened = _openings(arrivals.withColumn("_reject", reject), order)
    return opened.select("conversation_id", F.col("_owner").alias("owner"))


ENTRY = "struct<sent:bigint,received:bigint,message_id:string,text:string>"
SEGMENT = 64  # arrivals whose earlier ones in the segment are looked at one by one


def _entries(messages: DataFrame, texts: bool, keep: Sequence[str] = ()) -> DataFrame:
    """Customer messages as (conversation_id, message_id, _entry), entries being ordered by time."""
    text = F.col("text") if texts else F.lit(None).cast("string")
    entry = F.struct(
        F.unix_micros("sent_at").alias("sent"), F.unix_micros("received_at").alias("received"), "message_id",
        text.alias("text"),
    )
    customers = messages.filter(F.col("role") == "customer")
    return customers.select("conversation_id", "message_id", *keep, entry.alias("_entry"))


def _newest(entries: Column) -> Column:
    return F.slice(F.sort_array(entries, asc=False), 1, HISTORY_WINDOW - 1)


def _newest_before(items: DataFrame, most: int) -> DataFrame:
    """`items` (conversation_id, _place from 0, _top) with `_before`: the newest entries of all items of the
    conversation with a lesser place, of which there are at most `most`.

    The newest of two sets are the newest of their newest. So a conversation is cut into segments of SEGMENT places: an
    item looks at those before it in its segment, and at what is newest in all earlier segments, which is the same
    question about 64 times fewer items."""
    keys = ["conversation_id", "_seg"]
    placed = items.withColumn("_seg", F.floor(F.col("_place") / SEGMENT))
    earlier = Window.partitionBy(*keys).orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    inside = placed.withColumn("_inside", F.flatten(F.collect_list("_top").over(earlier)))
    if most <= SEGMENT:
        return inside.withColumn("_before", _newest(F.col("_inside"))).drop("_inside", "_seg")
    tops = placed.groupBy(*keys).agg(_newest(F.flatten(F.collect_list("_top"))).alias("_top"))
    far = _newest_before(tops.withColumnRenamed("_seg", "_place"), -(-most // SEGMENT)).select(
        "conversation_id", F.col("_place").alias("_seg"), F.col("_before").alias("_far")
    )
    both = _newest(F.concat("_inside", "_far"))
    return inside.join(far, keys).withColumn("_before", both).drop("_inside", "_far", "_seg")


def online_histories(
    messages: DataFrame, rows: int | None = None, known: DataFrame | None = None, texts: bool = True,
    keep: Sequence[str] = (),
) -> DataFrame:
    """What the scorer would have been sent for each customer message: the newest
    29 other customer messages that had arrived by then, by `sent_at`, then the
    message itself, last even when it is late.

    Arrival order and time order differ, so no window frame expresses this; see
    `_newest_before`. A segment holds 64 messages whatever the conversation has, so
    a long one is spread over many tasks. `known` holds (conversation_id, newest)
    of what arrived before all of `messages`; without `texts` only ids are kept;
    `keep` names further columns of the message that go along."""
    slim = _entries(messages, texts, keep).withColumns(
        {"_sent": F.col("_entry.sent"), "_received": F.col("_entry.received")}
    )
    most = slim.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    placed = with_position(slim, ["conversation_id"], ["_received", "message_id"], "_place", rows)
    items = placed.select(
        "conversation_id", "message_id", *keep, "_entry", (F.col("_place") - 1).alias("_place"), F.array("_entry").alias("_top")
    )
    found = _newest_before(items, most)
    if known is not None:
        found = lookup_join(found, known.select("conversation_id", "newest"), ["conversation_id"], "left", rows)
        none = F.array().cast(f"array<{ENTRY}>")
        found = found.withColumn("_before", _newest(F.concat("_before", F.coalesce("newest", none))))
    history = F.concat(F.reverse("_before"), F.array("_entry"))
    return found.select(
        "conversation_id", "message_id", *keep, history["message_id"].alias("history_ids"), history["text"].alias("history_texts")
    )


def newest_messages(messages: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(conversation_id, newest): the entries that the next message of each conversation will be scored with, those of
    `known` included where the conversation has new messages."""
    entries = _entries(messages, True).select("conversation_id", "_entry")
    if known is not None:
        before = known.join(entries.select("conversation_id").distinct(), "conversation_id", "left_semi")
        entries = entries.unionByName(before.select("conversation_id", F.explode("newest").alias("_entry")))
    recent = Window.partitionBy("conversation_id").orderBy(F.desc("_entry"))
    top = entries.withColumn("_n", F.row_number().over(recent)).filter(F.col("_n") < HISTORY_WINDOW)
    return top.groupBy("conversation_id").agg(F.collect_list("_entry").alias("newest"))


def _counted() -> Column:
    return (F.col("kind") == "failure") & ~F.coalesce(F.col("error_code") == "quarantined", F.lit(False))


_KEYS, _ORDER = ["conversation_id"], ["at_us", "seq"]


def _segmented(outcomes: DataFrame, rows: int | None) -> DataFrame:
    # each running value below reads the segments again, so they are written once
    return materialize(with_segments(outcomes, _KEYS, _ORDER, rows), "outcome-segments")


def _streaks(segmented: DataFrame, inclusive: bool, out: str) -> DataFrame:
    """Failures so far minus failures so far at the last success: two running
    values, so no conversation has to fit into one task."""
    total = running(segmented, _KEYS, _ORDER, {"_failed": ("sum", _counted().cast("long"))}, inclusive)
    reset = F.when(F.col("kind") == "score", F.col("_failed"))
    at_success = running(total, _KEYS, _ORDER, {"_reset": ("max", reset)}, inclusive)
    return at_success.withColumn(out, F.col("_failed") - F.coalesce("_reset", F.lit(0))).drop("_failed", "_reset")


def failure_streaks(outcomes: DataFrame, rows: int | None = None) -> DataFrame:
    """`failures`: failures since the conversation's last success, this outcome
    included. Quarantine records themselves do not count. Order: (`at_us`, `seq`)."""
    return _streaks(_segmented(outcomes, rows), True, "failures").drop("_seg", "_split")


def quarantine_state(outcomes: DataFrame, rows: int | None = None) -> DataFrame:
    """What the gate saw before each outcome: `failures_before` since the last
    success, and whether that blocks the call."""
    before = _streaks(_segmented(outcomes, rows), False, "failures_before").drop("_seg", "_split")
    return before.withColumn("blocked", F.col("failures_before") >= QUARANTINE_AFTER)


def replay_quarantine(outcomes: DataFrame, rows: int | None = None, known: DataFrame | None = None) -> DataFrame:
    """`outcome` of each row when a conversation is quarantined after its third
    failure in a row: everything later becomes `quarantined`, for good. `known`
    holds (conversation_id, failures) since the last success before all rows."""
    streaks = _replayed(outcomes, rows, known)
    return streaks.withColumn(
        "outcome",
        F.when(F.col("_reached") == 1, "quarantined")
        .when(F.col("kind") == "score", "scored")
        .otherwise(F.col("error_code")),
    ).drop("_reached", "_seg", "_split", "_before")


def _replayed(outcomes: DataFrame, rows: int | None, known: DataFrame | None) -> DataFrame:
    seg = _segmented(outcomes, rows)
    total = running(seg, _KEYS, _ORDER, {"_failed": ("sum", _counted().cast("long"))})
    reset = F.when(F.col("kind") == "score", F.col("_failed"))
    since = running(total, _KEYS, _ORDER, {"_reset": ("max", reset)})
    if known is None:
        since = since.withColumn("_before", F.lit(0))
    else:
        before = known.select("conversation_id", F.col("failures").alias("_before"))
        since = lookup_join(since, before, _KEYS, "left", rows)
    carried = F.when(F.col("_reset").isNull(), F.coalesce("_before", F.lit(0))).otherwise(-F.col("_reset"))
    streaks = since.withColumn("failures", F.col("_failed") + carried).drop("_failed", "_reset")
    reached = (F.col("failures") >= QUARANTINE_AFTER).cast("int")
    earlier = running(streaks, _KEYS, _ORDER, {"_reached": ("max", reached)}, inclusive=False)
    blocked = F.coalesce(F.col("_before") >= QUARANTINE_AFTER, F.lit(False)).cast("int")
    return earlier.withColumn("_reached", F.greatest(blocked, F.coalesce("_reached", F.lit(0))))


def streak_ends(outcomes: DataFrame, rows: int | None = None, known: DataFrame | None = None) -> DataFrame:
    """(conversation_id, failures) after all rows, for the next call's `known`. A conversation that was blocked at any
    row keeps the count that blocks it."""
    last = F.max_by("failures", F.struct(*_ORDER))
    blocked = F.max((F.col("failures") >= QUARANTINE_AFTER) | (F.col("_reached") == 1))
    return _replayed(outcomes, rows, known).groupBy("conversation_id").agg(
        F.when(blocked, F.greatest(last, F.lit(QUARANTINE_AFTER))).otherwise(last).cast("long").alias("failures")
    )


def timeline(scores: DataFrame, failures: DataFrame) -> DataFrame:
    """Scores and failures as one outcome stream."""
    good = scores.select(
        F.col("mood_id").alias("id"), "conversation_id", F.lit("score").alias("kind"),
        F.unix_micros("persisted_at").alias("at_us"), "score",
    )
    bad = failures.select(
        F.col("failure_id").alias("id"), "conversation_id", F.lit("failure").alias("kind"),
        F.unix_micros("occurred_at").alias("at_us"), "error_code",
    )
    return good.unionByName(bad, allowMissingColumns=True)
