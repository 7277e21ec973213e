"""Chat formatting by columnar byte assembly.

A turn becomes `<s>[INST] role [/INST] text</s>`. A control string inside a role or a text gets a backslash after its
first character (one more if it has some already), which `unescape` takes out again. For a batch of turns the lengths
of all segments are computed first, their sums give each segment's place, and one gather copies headers, roles and texts
into a preallocated Arrow buffer.

Rows are range-partitioned and sorted by conversation and turn, so a long conversation spreads over many tasks; each
task writes pieces of whole turns, numbered in order. A piece ends with its batch, so no task holds a whole
conversation. `read_back` streams the pieces of a conversation in order and keeps only the state of its hashes.

Defined cases: null texts and roles are empty; a null id is a conversation of its own; turns of equal number are ordered
by role, then by a hash of their text, then by the text; repeated rows are turns of their own; an empty table gives no
rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm.registry import query, table
from colloquy.llm.textbytes import text_buffers
from colloquy.session import materialize

OPEN, MIDDLE, CLOSE = "<s>[INST] ", " [/INST] ", "</s>"
CONTROL = r"(/?(?:s>|INST\]))"
LOSS_ROLE = "assistant"
PIECE_BYTES = 4 << 20  # a piece is closed at the first turn after so many bytes

PIECES = (
    "conv_id long, n_turns long, formatted string, formatted_chars long, loss array<struct<start:long,end:long>>"
)

_ESCAPED = re.compile(r"([<\[])\\(\\*)" + CONTROL)
_TURN = re.compile(
    re.escape(OPEN) + "(.*?)" + re.escape(MIDDLE) + "(.*?)" + re.escape(CLOSE), re.DOTALL
)


def escape(column: pa.Array) -> pa.Array:
    """A backslash after the first character of every control string."""
    return pc.replace_substring_regex(column, r"([<\[])(\\*)" + CONTROL, r"\1\\\2\3")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def _gather(pool: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[pa.Buffer, np.ndarray]:
    """The segments of `pool` one after another in one buffer, and their places in it."""
    place = np.concatenate([[0], np.cumsum(length)])
    buffer = pa.allocate_buffer(int(place[-1]))
    index = np.repeat(start - place[:-1], length) + np.arange(place[-1])
    np.take(pool, index, out=np.frombuffer(buffer, np.uint8)) if place[-1] else None
    return buffer, place


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[pa.Buffer, np.ndarray, np.ndarray, np.ndarray]:
    """Formatted turns in one buffer: the buffer, byte offsets of the turns, and the code points of each turn before
    its text and in all."""
    role, text = escape(roles), escape(texts)
    role_data, role_at = text_buffers(role)
    text_data, text_at = text_buffers(text)
    marks = [np.frombuffer(m.encode(), np.uint8) for m in (OPEN, MIDDLE, CLOSE)]
    pool = np.concatenate([*marks, role_data, text_data])
    bases = np.cumsum([0, *map(len, marks), len(role_data)])
    n = len(role)
    start, length = np.empty((n, 5), np.int64), np.empty((n, 5), np.int64)
    for k, mark in ((0, 0), (2, 1), (4, 2)):
        start[:, k], length[:, k] = bases[mark], len(marks[mark])
    start[:, 1], length[:, 1] = bases[3] + role_at[:-1], np.diff(role_at)
    start[:, 3], length[:, 3] = bases[4] + text_at[:-1], np.diff(text_at)
    buffer, place = _gather(pool, start.ravel(), length.ravel())
    before = np.asarray(pc.utf8_length(role)).astype(np.int64) + len(OPEN) + len(MIDDLE)
    total = before + np.asarray(pc.utf8_length(text)).astype(np.int64) + len(CLOSE)
    return buffer, place[::5], before, total


def _pieces(batch: pa.RecordBatch) -> pa.RecordBatch:
    ids, roles, texts = (batch.column(c) for c in ("conv_id", "role", "text"))
    n = len(ids)
    buffer, offsets, before, total = assemble(roles, texts)
    key = np.asarray(ids.fill_null(0)).astype(np.int64)
    null = np.asarray(ids.is_null())
    full = offsets[:-1] // PIECE_BYTES
    new = np.ones(n, bool)
    new[1:] = (key[1:] != key[:-1]) | (null[1:] != null[:-1]) | (full[1:] != full[:-1])
    first = np.flatnonzero(new)
    stop = np.append(first[1:], n)
    chars = np.concatenate([[0], np.cumsum(total)])
    piece = np.repeat(np.arange(len(first)), stop - first)
    loss = np.asarray(pc.equal(roles, LOSS_ROLE)).astype(bool)
    begin = (chars[:-1] - chars[first][piece] + before)[loss]
    end = (chars[1:] - chars[first][piece] - len(CLOSE))[loss]
    spans = pa.StructArray.from_arrays([pa.array(begin), pa.array(end)], names=["start", "end"])
    bounds = np.append(np.searchsorted(np.flatnonzero(loss), first), loss.sum())
    text = pa.LargeStringArray.from_buffers(
        len(first), pa.py_buffer(np.append(offsets[first], offsets[-1]).astype(np.int64)), buffer
    )
    return pa.RecordBatch.from_arrays(
        [
            ids.take(pa.array(first)).cast(pa.int64()),
            pa.array(stop - first, pa.int64()),
            text.cast(pa.string()),
            pa.array(chars[stop] - chars[first], pa.int64()),
            pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), spans),
        ],
        names=["conv_id", "n_turns", "formatted", "formatted_chars", "loss"],
    )


def format_conversations(turns: DataFrame) -> DataFrame:
    """Pieces of formatted conversations: `formatted`, the loss mask as spans of code points, and `piece`, which rises
    along a conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _pieces(batch)

    order = ["conv_id", "turn", "role", "_tie"]
    ready = turns.select(
        F.col("conv_id").cast("long"), "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("_tie", F.xxhash64("text"))
    ranged = ready.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    made = ranged.select("conv_id", "role", "text").mapInArrow(run, PIECES)
    return materialize(made.withColumn("piece", F.monotonically_increasing_id()), "chat")


class _Digest:
    """What is known of one conversation so far."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.turns, self.loss_chars, self.chars = conv_id, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, text: str, spans: list[dict]) -> None:
        self.chars += len(text)
        for m in _TURN.finditer(text):
            self.turns += 1
            self.all.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
        for s in spans:
            told = unescape(text[s["start"] : s["end"]])
            self.loss_chars += len(told)
            self.loss.update(told.encode())


READ_BACK = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)


def read_back(pieces: DataFrame) -> DataFrame:
    """Per conversation, what the formatted pieces say: turns and their digest, text under the loss mask and its digest."""

    def rows(done: list[_Digest]) -> pa.RecordBatch:
        columns = [
            [d.conv_id for d in done], [d.turns for d in done], [d.all.hexdigest() for d in done],
            [d.loss_chars for d in done], [d.loss.hexdigest() for d in done], [d.chars for d in done],
        ]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
            names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            done = []
            for conv_id, text, spans in zip(*(batch.column(c) for c in ("conv_id", "formatted", "loss")), strict=True):
                conv_id = conv_id.as_py()
                if now is None or conv_id != now.conv_id:
                    if now:
                        done.append(now)
                    now = _Digest(conv_id)
                now.add(text.as_py(), spans.as_py())
            if done:
                yield rows(done)
        if now:
            yield rows([now])

    ordered = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    return ordered.select("conv_id", "formatted", "loss").mapInArrow(run, READ_BACK)


_PROBE = "</s>[INST] ok [/INST]"
_ESC = r"regexp_replace({c}, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\\\2\3', 'g')"
_SQL = f"""
WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '{_PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{_PROBE}')
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (WHERE role = '{LOSS_ROLE}'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role) FILTER (WHERE role = '{LOSS_ROLE}'), '')) AS loss_sha256,
    CAST(sum(length({_ESC.format(c="role")}) + length({_ESC.format(c="text")}) + {len(OPEN + MIDDLE + CLOSE)})
        AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""


@query("op4_chat_formatting", _SQL)
def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", _PROBE), (-1, 1, "assistant", _PROBE)], turns.schema)
    return read_back(format_conversations(turns.unionByName(probe)))
