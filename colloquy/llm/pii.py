"""Personal data by anchor expansion.

An Aho-Corasick automaton finds at-signs, address schemes and identifier cues in one pass over a text; deterministic
local parsers grow each anchor to the left and right and validate what they get. Numbers are their own anchors: runs of
digits are cut into addresses, cards and phones. Every parser reads a character a bounded number of times, so a text of
any length takes linear time. Spans are in code points, ends exclusive.

Base kinds (leftmost, not overlapping within a kind, failing matches dropped): email, ip, card, phone. Added kinds: url
(scheme anchors), account (IBANs that pass mod 97, and 6 to 17 digits after an account cue), secret (a value of eight or
more characters after a credential cue, or an access key id).

Defined cases: a null or empty text has no spans; repeated rows get the same spans; other columns pass through, and
columns named as the results are replaced.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.llm.arrowmap import with_columns
from colloquy.llm.registry import query, table

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "account", "secret")

SPANS = T.StructType(
    [
        T.StructField(
            "spans",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("kind", T.StringType()),
                        T.StructField("start", T.LongType()),
                        T.StructField("end", T.LongType()),
                    ]
                )
            ),
        )
    ]
)

SCHEMES = ("http://", "https://", "ftp://", "mailto:")
ACCOUNT_CUES = ("account", "acct", "iban", "konto", "cuenta", "compte")
SECRET_CUES = ("password", "passwd", "pwd", "token", "secret", "api_key", "apikey")
KEY_PREFIX = "AKIA"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile("[0-9]")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_SPACED = re.compile("[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_URL = re.compile(r"""[^\s<>"'{}|\\^`]+""")
_ACCOUNT = re.compile(r"(?: ?(?:no|nr|number|num)\b\.?)?[ :#=.]{0,3}([0-9](?:[ -]?[0-9])+)(?![0-9])")
_IBAN = re.compile(r"[ :#=.]{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{1,4}){3,8})(?![A-Za-z0-9])")
_SECRET = re.compile(r"""["']?\s{0,2}[=:]\s{0,2}["']?([A-Za-z0-9+/_=-]{8,})""")
_KEY = re.compile(r"[0-9A-Z]{16}(?![0-9A-Za-z])")


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, words in (("at", "@"), ("scheme", SCHEMES), ("account", ACCOUNT_CUES), ("secret", SECRET_CUES), ("key", (KEY_PREFIX,))):
        for word in words:
            forms = {word} if kind in ("at", "key") else {word, word.upper(), word.capitalize()}
            for form in forms:
                found.add_word(form, (kind, len(form)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    """The check sum of card numbers."""
    values = [int(d) for d in reversed(digits)]
    return not (sum(values[0::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10


def _iban(code: str) -> bool:
    turned = code[4:] + code[:4]
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _numbers(text: str, out: list) -> None:
    """ip, card and phone spans."""
    for m in _DOTTED.finditer(text):
        if m.end() - m.start() < 7:
            continue
        parts = m.group().split(".")
        at = m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append(("ip", at, end))
            at = end + 1
    for m in _SPACED.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGIT.findall(m.group())) <= 15:
            out.append(("phone", m.start(), m.end()))


def _email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """The address around the at-sign, its local part not reaching below `floor`."""
    domain = _DOMAIN.match(text, at + 1)
    if not domain:
        return None
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    return (start, domain.end()) if start < at else None


def _cued(text: str, kind: str, start: int, after: int) -> tuple[str, int, int] | None:
    """The span that an anchor other than an at-sign leads to."""
    if start and text[start - 1] in _ALNUM:
        return None
    if kind == "scheme":
        m = _URL.match(text, after)
        end = after + len(m.group().rstrip(".,;:!?)]")) if m else after
        return ("url", start, end) if end > after else None
    if kind == "key":
        m = _KEY.match(text, after)
        return ("secret", start, m.end()) if m else None
    if kind == "secret":
        m = _SECRET.match(text, after)
        return ("secret", m.start(1), m.end(1)) if m else None
    m = _IBAN.match(text, after)
    if m and _iban(m.group(1).replace(" ", "")):
        return ("account", m.start(1), m.end(1))
    m = _ACCOUNT.match(text, after)
    if m and 6 <= len(_DIGIT.findall(m.group(1))) <= 17:
        return ("account", m.start(1), m.end(1))
    return None


def find(text: str, automaton: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """All spans of a text by start, then kind."""
    out: list[tuple[str, int, int]] = []
    floor = taken = 0
    for last, (kind, length) in automaton.iter(text):
        start = last + 1 - length
        if kind == "at":
            span = _email(text, last, floor)
            if span:
                out.append(("email", *span))
                floor = span[1]
        elif start >= taken:  # not inside what an earlier anchor led to
            span = _cued(text, kind, start, last + 1)
            if span:
                out.append(span)
                taken = span[2]
    if _DIGIT.search(text):
        _numbers(text, out)
    out.sort(key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return out


def find_personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` without its text, with `spans`."""

    def run(column: pa.Array) -> dict[str, pa.Array]:
        automaton = _automaton()
        each = [find(t, automaton) if t else [] for t in column.to_pylist()]
        flat = [s for spans in each for s in spans]
        values = pa.StructArray.from_arrays(
            [
                pa.array([s[0] for s in flat], pa.string()),
                pa.array([s[1] for s in flat], pa.int64()),
                pa.array([s[2] for s in flat], pa.int64()),
            ],
            names=["kind", "start", "end"],
        )
        offsets = np.concatenate([[0], np.cumsum([len(s) for s in each])])
        return {"spans": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)}

    return with_columns(docs, text, run, SPANS)


def _joined(spans: str) -> str:
    return f"concat_ws(',', transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.end)))"


@query("op2_pii")
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = ", ".join(f"'{k}'" for k in BASE_KINDS)
    return found.select(
        "doc_id",
        *(F.expr(f"CAST(size(filter(spans, s -> s.kind = '{k}')) AS BIGINT)").alias(f"n_{k}") for k in BASE_KINDS),
        F.expr(f"sha2({_joined(f'filter(spans, s -> s.kind IN ({base}))')}, 256)").alias("base_sha256"),
        F.expr(_joined("spans")).alias("spans"),
    )
