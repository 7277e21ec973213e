"""Row-local rules of the score and message records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy.functions.text import is_blank

# Limits, score scale, buckets, error codes and compatibility.
MAX_TEXT = 1000
SCALE = "-1 to 1"
UNIT_SCALE = "0 to 1"
BUCKETS = (
    # upper bound, bound included, emoji, label
    (-0.6, True, "😠", "Muito negativo"),
    (-0.2, True, "🙁", "Negativo"),
    (0.2, False, "😐", "Neutro"),
    (0.6, False, "🙂", "Positivo"),
    (None, False, "😄", "Muito positivo"),
)
EMPTY_BUCKET = ("❔", "Sem dados de humor ainda")
FEATURE_VERSION = "fs-1"
HISTORY_WINDOW = 30
HISTORY_SCOPE = "conversation"
ALGORITHMS = ("tfidf-ridge", "embeddings-ft")
ZONED = r"(?:[Zz]|[+-]\d{2}:?\d{2})$"


def clip_score(score: Column) -> Column:
    """Into [-1, 1]; NaN stays NaN so that it cannot pass for a score."""
    return F.when(F.isnan(score), score).otherwise(
        F.greatest(F.lit(-1.0), F.least(F.lit(1.0), score))
    )


def in_range(score: Column) -> Column:
    """True only for a number in [-1, 1]; null and NaN are not."""
    return F.coalesce(~F.isnan(score) & score.between(-1.0, 1.0), F.lit(False))


def _bucket(score: Column, scale: Column, empty: str, pick: int) -> Column:
    value = F.when(scale == UNIT_SCALE, score * 2 - 1).otherwise(score)
    chosen = F.when(score.isNull(), F.lit(empty))
    for bucket in BUCKETS[:-1]:
        bound, included = bucket[0], bucket[1]
        chosen = chosen.when(value <= bound if included else value < bound, F.lit(bucket[pick]))
    return chosen.otherwise(F.lit(BUCKETS[-1][pick]))


def mood_emoji(score: Column, scale: Column) -> Column:
    return _bucket(score, scale, EMPTY_BUCKET[0], 2)


def mood_label(score: Column, scale: Column) -> Column:
    return _bucket(score, scale, EMPTY_BUCKET[1], 3)


def short_name(customer_id: Column) -> Column:
    """First four characters of the id without its prefix, upper case."""
    return F.upper(F.substring(F.regexp_replace(customer_id, "^customer-", ""), 1, 4))


def clock(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm")


def to_utc(text: Column) -> Column:
    """Instant of an ISO timestamp with an offset; null where it has none."""
    return F.when(text.rlike(ZONED), F.try_to_timestamp(text))


def iso_millis(ts: Column) -> Column:
    """`yyyy-MM-ddTHH:mm:ss.SSSZ`, milliseconds cut off, in the session's UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def reject_code(role: Column, text: Column, timestamp: Column) -> Column:
    """HTTP-like code of a message that cannot be admitted by itself, or null."""
    return (
        F.when(role.isNull() | ~role.isin("customer", "agent"), F.lit(400))
        .when(text.isNull() | is_blank(text), F.lit(400))
        .when(F.length(text) > MAX_TEXT, F.lit(413))
        .when(to_utc(timestamp).isNull(), F.lit(400))
    )


RESPONSE = "struct<score:double,scale:string,mood_label:string,model_version:string,computed_at:string>"


def response_error(outcome: Column, status: Column, body: Column) -> Column:
    """Error code of a scorer's answer, or null when a score can be read.

    `outcome` is 'timeout', 'unreachable' or 'answered'."""
    parsed = F.from_json(body, RESPONSE)
    complete = (
        parsed["score"].isNotNull()
        & parsed["scale"].isNotNull()
        & parsed["model_version"].isNotNull()
        & F.try_to_timestamp(parsed["computed_at"]).isNotNull()
    )
    return (
        F.when(outcome == "timeout", F.lit("timeout"))
        .when(outcome == "unreachable", F.lit("ml_unavailable"))
        .when(status == 503, F.lit("ml_unavailable"))
        .when(status != 200, F.lit("invalid_response"))
        .when(~F.coalesce(complete, F.lit(False)), F.lit("invalid_response"))
        .when(~in_range(parsed["score"]), F.lit("score_out_of_range"))
    )


def incompatibility(manifest: dict[str, Column]) -> Column:
    """First manifest field that does not fit this code, or null."""
    return (
        F.when(~manifest["feature_spec_version"].eqNullSafe(F.lit(FEATURE_VERSION)), F.lit("feature_spec_version"))
        .when(~manifest["history_window"].eqNullSafe(F.lit(HISTORY_WINDOW)), F.lit("history_window"))
        .when(~manifest["history_scope"].eqNullSafe(F.lit(HISTORY_SCOPE)), F.lit("history_scope"))
        .when(~F.coalesce(manifest["algorithm"].isin(*ALGORITHMS), F.lit(False)), F.lit("algorithm"))
    )


VERSION = r"^mood-(\d{4})\.(\d{2})\.(\d+)$"


def version_parts(version: Column) -> dict[str, Column]:
    """Year, month and number of a model version; null where it has another form."""
    return {
        name: F.when(version.rlike(VERSION), F.regexp_extract(version, VERSION, i).cast("int"))
        for i, name in enumerate(("year", "month", "number"), start=1)
    }


def stale(now: Column, computed_at: Column, seconds: int) -> Column:
    return F.unix_micros(now) - F.unix_micros(computed_at) > F.lit(seconds * 1_000_000)
