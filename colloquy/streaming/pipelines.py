"""Streaming queries: admission, histories, quarantine, current mood, scoring.

A micro-batch runs the batch operators over its rows and the state that earlier
batches left (`keyed`): an owner, a failure count or the 29 newest messages per
conversation. The operators put arrivals in order with windows that are cut where a
key is hot, so a key may bring any share of a batch, and nothing of a batch has to
fit into one task. Rows of a batch are read in arrival order; what a later batch
brings counts as arrived later, however late it was sent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.functions.scalars import SCALE, in_range
from colloquy.functions.text import with_prepared
from colloquy.operators import online
from colloquy.session import job, materialize, new_path
from colloquy.streaming.keyed import KeyedTable

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

ARRIVAL = ["received_at", "message_id"]
OWNERS = "conversation_id string, owner string"
NEWEST = f"conversation_id string, newest array<{online.ENTRY}>"
STREAKS = "conversation_id string, failures long"

STATUSES = "conversation_id string, message_id string, status int"
HISTORIES = "conversation_id string, message_id string, history_ids array<string>, history_texts array<string>"
OUTCOMES = "conversation_id string, seq long, outcome string"
SCORES = (
    "mood_id string, request_id string, customer_id string, conversation_id string, trigger_message_id string,"
    " score double, scale string, mood_label string, model_version string, computed_at timestamp, persisted_at timestamp"
)
FAILURES = (
    "failure_id string, request_id string, trigger_message_id string, conversation_id string, model_version string,"
    " error_code string, detail string, occurred_at timestamp"
)

Step = Callable[[DataFrame, int], None]


def read_stream(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    pattern: str | None = None,
    bytes_per_trigger: int = 8 << 30,
    files_per_trigger: int | None = None,
) -> DataFrame:
    """Parquet files of a folder as a stream, those whose name fits `pattern`; a
    micro-batch is bounded, by files if given, else by bytes."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    else:
        reader = reader.option("maxBytesPerTrigger", bytes_per_trigger)
    if pattern is not None:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(folder)


def _run(writer, checkpoint: str, spark: SparkSession) -> None:
    """Start with RocksDB state and run to the end of what is there now."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def run_to_table(rows: DataFrame, out: str, checkpoint: str) -> None:
    """Append the stream's rows as Parquet, exactly once."""
    _run(rows.writeStream.format("parquet").outputMode("append").option("path", out), checkpoint, rows.sparkSession)


def run_each_batch(rows: DataFrame, sink: Step, checkpoint: str, mode: str = "append") -> None:
    """`sink` for every batch; what it wrote for the time being is deleted after it."""

    def step(batch: DataFrame, batch_id: int) -> None:
        with job(batch.sparkSession):
            sink(batch, batch_id)

    _run(rows.writeStream.outputMode(mode).foreachBatch(step), checkpoint, rows.sparkSession)


def collect_stream(rows: DataFrame, name: str) -> DataFrame:
    """Run the stream into a new table of the shared folder and read it."""
    spark = rows.sparkSession
    out = new_path(spark, name)
    run_to_table(rows, out, new_path(spark, f"{name}-checkpoint"))
    return spark.read.schema(rows.schema).parquet(out)


def write_batch(rows: DataFrame, out: str, batch_id: int) -> None:
    """A batch's rows in a folder of their own; a batch that is run again replaces
    its folder, so nothing is doubled."""
    rows.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")


def read_batches(spark: SparkSession, out: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("basePath", out).parquet(f"{out}/batch=*").drop("batch")


def _of(state: DataFrame, rows: DataFrame) -> DataFrame:
    """The state of the conversations that `rows` has."""
    return state.join(rows.select("conversation_id").distinct(), "conversation_id", "left_semi")


def admit_batch(arrivals: DataFrame, batch_id: int, reject: Column, owners: KeyedTable) -> DataFrame:
    """`arrivals` with their status; remembers the owners of new conversations."""
    known = materialize(_of(owners.read(arrivals.sparkSession, batch_id), arrivals), "owners")
    opened = online.owners(arrivals, reject, ARRIVAL).join(known, "conversation_id", "left_anti")
    owners.write(batch_id, opened)
    return online.admit(arrivals, reject, ARRIVAL, known=known)


def history_batch(
    messages: DataFrame, batch_id: int, newest: KeyedTable, keep: tuple[str, ...] = ()
) -> DataFrame:
    """What each customer message is scored with; remembers the newest messages."""
    known = materialize(_of(newest.read(messages.sparkSession, batch_id), messages), "newest")
    newest.write(batch_id, online.newest_messages(messages, known))
    return online.online_histories(messages, known=known, keep=keep)


def quarantine_batch(outcomes: DataFrame, batch_id: int, streaks: KeyedTable) -> DataFrame:
    """`outcomes` with what becomes of them; remembers the failures in a row."""
    known = materialize(_of(streaks.read(outcomes.sparkSession, batch_id), outcomes), "streaks")
    streaks.write(batch_id, online.streak_ends(outcomes, known=known))
    return online.replay_quarantine(outcomes, known=known)


def admission(messages: DataFrame, reject: Column, out: str, checkpoint: str) -> None:
    """Writes the status of each arriving message (STATUSES)."""
    owners = KeyedTable(f"{out}-owners", "conversation_id", OWNERS)
    slim = messages.select(*{*ARRIVAL, "conversation_id", "customer_id", "role"}, reject.alias("_no"))

    def sink(batch: DataFrame, batch_id: int) -> None:
        arrivals = materialize(batch, "arrivals")
        made = admit_batch(arrivals, batch_id, F.col("_no"), owners)
        write_batch(made.select("conversation_id", "message_id", "status"), out, batch_id)

    run_each_batch(slim, sink, checkpoint)


def histories(messages: DataFrame, out: str, checkpoint: str) -> None:
    """Writes the history each arriving customer message is scored with (HISTORIES)."""
    newest = KeyedTable(f"{out}-newest", "conversation_id", NEWEST)
    slim = messages.filter(F.col("role") == "customer").select(
        "conversation_id", "message_id", "role", "text", "sent_at", "received_at"
    )

    def sink(batch: DataFrame, batch_id: int) -> None:
        write_batch(history_batch(materialize(batch, "arrivals"), batch_id, newest), out, batch_id)

    run_each_batch(slim, sink, checkpoint)


def quarantine(outcomes: DataFrame, out: str, checkpoint: str) -> None:
    """Writes what becomes of each outcome (OUTCOMES)."""
    streaks = KeyedTable(f"{out}-streaks", "conversation_id", STREAKS)
    rows = outcomes.select("conversation_id", "at_us", "seq", "kind", "error_code")

    def sink(batch: DataFrame, batch_id: int) -> None:
        made = quarantine_batch(materialize(batch, "outcomes"), batch_id, streaks)
        write_batch(made.select("conversation_id", "seq", "outcome"), out, batch_id)

    run_each_batch(rows, sink, checkpoint)


def without_redelivery(messages: DataFrame, event_time: str | None = None, delay: str | None = None) -> DataFrame:
    """Drops messages whose id was seen before, at any time: the ids are kept in
    RocksDB for good. With `event_time` and `delay` an id is forgotten when the
    watermark has passed it by `delay`, and what is later than that is dropped.
    Off unless called: by default every delivery counts."""
    if delay is None:
        return messages.dropDuplicates(["message_id"])
    return messages.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["message_id"])


def mood_table(out: str, key: str, schema: T.StructType, every: int = 16) -> KeyedTable:
    """The newest score record per `key`, by computed, then stored time, then id."""
    return KeyedTable(out, key, schema, ("computed_at", "persisted_at", "mood_id"), every)


def maintain_current_mood(scores: DataFrame, key: str, out: str, checkpoint: str, every: int = 16) -> None:
    """Keeps the newest score record per key in a table whose size is that of the
    keys; `mood_table(...).read` gives it."""
    kept = mood_table(out, key, scores.schema, every)
    record = F.struct(*scores.columns)
    recency = F.struct("computed_at", "persisted_at", "mood_id")

    def sink(batch: DataFrame, batch_id: int) -> None:
        newest = batch.groupBy(F.col(key).alias("_key")).agg(F.max_by(record, recency).alias("r")).select("r.*")
        kept.write(batch_id, newest)

    run_each_batch(scores, sink, checkpoint)


def _record_id(kind: str) -> Column:
    """The same id whenever the batch is run again."""
    digest = F.md5(F.concat_ws("|", F.lit(kind), "conversation_id", "message_id", "received_at"))
    parts = [F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat_ws("-", *parts)


def score_stream(
    messages: DataFrame,
    reject: Column,
    model: Callable[[DataFrame], DataFrame],
    model_version: str,
    out: str,
    checkpoint: str,
    clock: Column | None = None,
) -> None:
    """The way of a message: admission, quarantine, history, model, range check, record.

    `reject` is null for a message that passes its own checks. Text is cleaned and
    masked once, before it is kept. A customer message of a conversation that was
    blocked when the batch began is not sent to the model. `model` gets
    (conversation_id, message_id, customer_id, received_at, text_clean,
    context_clean) and adds `prediction`, and `error_code` and `detail` where it
    failed; it is called once per batch. A value outside [-1, 1], NaN or null is a
    failure, never a score. After three failures in a row every later message of
    the conversation is recorded as quarantined.

    Writes below `out` the folders status (STATUSES), scores (SCORES) and failures
    (FAILURES), by batch; `recorded` reads them."""
    owners = KeyedTable(f"{out}/state-owners", "conversation_id", OWNERS)
    newest = KeyedTable(f"{out}/state-newest", "conversation_id", NEWEST)
    streaks = KeyedTable(f"{out}/state-streaks", "conversation_id", STREAKS)
    slim = messages.select(
        "conversation_id", "message_id", "customer_id", "role", "text", "sent_at", "received_at", reject.alias("_no")
    )
    now = F.current_timestamp() if clock is None else clock
    keep = ("customer_id", "received_at")

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        admitted = materialize(admit_batch(materialize(batch, "arrivals"), batch_id, F.col("_no"), owners), "admitted")
        write_batch(admitted.select("conversation_id", "message_id", "status"), f"{out}/status", batch_id)
        taken = admitted.filter((F.col("status") == 200) & (F.col("role") == "customer"))
        prepared = materialize(with_prepared(taken, "text", "text"), "prepared")
        windows = history_batch(prepared, batch_id, newest, keep).select(
            "conversation_id", "message_id", *keep,
            F.element_at("history_texts", -1).alias("text_clean"),
            F.slice("history_texts", F.lit(1), F.size("history_texts") - 1).alias("context_clean"),
        )
        blocked = _of(streaks.read(spark, batch_id), prepared).filter(F.col("failures") >= online.QUARANTINE_AFTER)
        blocked = materialize(blocked.select("conversation_id"), "blocked")
        made = model(windows.join(blocked, "conversation_id", "left_anti"))
        for name in ("error_code", "detail"):
            if name not in made.columns:
                made = made.withColumn(name, F.lit(None).cast("string"))
        outside = ~F.coalesce(in_range(F.col("prediction")), F.lit(False))
        code = F.coalesce("error_code", F.when(outside, "score_out_of_range"))
        said = F.when(outside, F.concat(F.lit("score "), F.coalesce(F.col("prediction").cast("string"), F.lit("null")), F.lit(" outside [-1.0, 1.0]")))
        answers = materialize(
            made.select(
                "conversation_id", "message_id", *keep, F.col("prediction").cast("double").alias("score"),
                F.when(F.col("error_code").isNull(), F.lit(model_version)).alias("model_version"),
                F.when(F.col("error_code").isNull(), said).otherwise(F.col("detail")).alias("detail"),
                code.alias("error_code"), F.when(code.isNull(), "score").otherwise("failure").alias("kind"),
                F.unix_micros("received_at").alias("at_us"), F.col("message_id").alias("seq"),
            ),
            "answers",
        )
        closed = prepared.join(blocked, "conversation_id", "left_semi").select("conversation_id", "message_id", *keep)
        replayed = quarantine_batch(answers, batch_id, streaks)
        outcomes = replayed.unionByName(closed.withColumn("outcome", F.lit("quarantined")), allowMissingColumns=True)
        done = materialize(outcomes.withColumn("now", now), "outcomes")
        common = {"trigger_message_id": F.col("message_id"), "request_id": _record_id("request")}
        good = done.filter("outcome = 'scored'").withColumns(
            common
            | {
                "mood_id": _record_id("mood"), "scale": F.lit(SCALE), "mood_label": F.lit(None).cast("string"),
                "computed_at": F.col("now"), "persisted_at": F.col("now"),
            }
        )
        held = F.col("outcome") == "quarantined"
        bad = done.filter("outcome <> 'scored'").withColumns(
            common
            | {
                "failure_id": _record_id("failure"), "error_code": F.col("outcome"),
                "model_version": F.when(~held, F.col("model_version")),
                "detail": F.when(held, "quarantined after failures in a row").otherwise(F.col("detail")),
                "occurred_at": F.col("now"),
            }
        )
        for rows, schema, name in ((good, SCORES, "scores"), (bad, FAILURES, "failures")):
            write_batch(rows.select(*T.StructType.fromDDL(schema).names), f"{out}/{name}", batch_id)

    run_each_batch(slim, sink, checkpoint)


def recorded(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The statuses, score records and failure records that `score_stream` wrote."""
    kinds = (("status", STATUSES), ("scores", SCORES), ("failures", FAILURES))
    statuses, scores, failures = (read_batches(spark, f"{out}/{name}", schema) for name, schema in kinds)
    return statuses, scores, failures
