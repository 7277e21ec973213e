"""Cleaning, masking and feature text as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The whitespace, digit and word classes the rules are defined on.
# Java's \s without (?U) is ASCII only, and with it leaves out U+001C..U+001F.
SPACE = r"[\s\x1c-\x1f]"
DIGIT = r"\p{Nd}"
WORD = r"[\p{L}\p{N}_]"

# Personal-data patterns, in the order they are applied.
EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
CPF = rf"{DIGIT}{{3}}\.{DIGIT}{{3}}\.{DIGIT}{{3}}-{DIGIT}{{2}}"
PHONE_MARKED = rf"(?U)(?:\+55[\s\x1c-\x1f-]?)?(?:\(?{DIGIT}{{2}}\)?[\s\x1c-\x1f-]?)?9?{DIGIT}{{4}}-{DIGIT}{{4}}"
PHONE_RAW = rf"(?<!{WORD}){DIGIT}{{10,11}}(?!{WORD})"
PASSES = (
    ("email", EMAIL, "<EMAIL>"),
    ("cpf", CPF, "<CPF>"),
    ("phone", PHONE_MARKED, "<TEL>"),
    ("phone", PHONE_RAW, "<TEL>"),
)

MAX_HISTORY = 30


def strip(text: Column) -> Column:
    """Unicode whitespace removed from both ends."""
    return F.regexp_replace(text, rf"(?U)\A{SPACE}+|{SPACE}+\z", "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(rf"(?U)[^\s\x1c-\x1f]")


@F.pandas_udf(T.StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda s: unicodedata.normalize("NFC", s), na_action="ignore")


def with_clean(df: DataFrame, column: str, out: str) -> DataFrame:
    """Strip, collapse whitespace, compose to NFC, drop control and format
    characters; the stripped text is kept where nothing visible would be left.

    One column per step, so that each pattern runs once per row. Text below
    U+0300 is already composed: only rows holding a character from there on carry
    their text to Python."""
    return (
        df.withColumn("_stripped", strip(F.col(column)))
        .withColumn("_one_line", F.regexp_replace("_stripped", rf"(?U){SPACE}+", " "))
        .withColumn(
            "_composed",
            _nfc(F.when(F.col("_one_line").rlike(r"[^\x{0}-\x{2ff}]"), F.col("_one_line"))),
        )
        .withColumn(
            "_visible",
            F.regexp_replace(F.coalesce("_composed", "_one_line"), r"[\p{Cc}\p{Cf}]", ""),
        )
        .withColumn(out, F.when(is_blank(F.col("_visible")), F.col("_stripped")).otherwise(F.col("_visible")))
        .drop("_stripped", "_one_line", "_composed", "_visible")
    )


def with_prepared(df: DataFrame, column: str, out: str) -> DataFrame:
    """Clean, then mask: the one text path for training and scoring."""
    return with_clean(df, column, out).withColumn(out, mask(F.col(out)))


def mask(text: Column) -> Column:
    """E-mail, CPF and phone numbers replaced by markers."""
    for _, pattern, marker in PASSES:
        text = F.regexp_replace(text, pattern, marker)
    return text


def with_personal_counts(df: DataFrame, column: str) -> DataFrame:
    """Columns `email`, `cpf` and `phone`: occurrences by kind. Each pass counts
    in the text the passes before left, which is a column of its own so that it
    is made once."""
    kinds = list(dict.fromkeys(kind for kind, _, _ in PASSES))
    df = df.withColumn("_text_0", F.col(column))
    for i, (_, pattern, marker) in enumerate(PASSES):
        text = F.col(f"_text_{i}")
        df = df.withColumns(
            {
                f"_found_{i}": F.regexp_count(text, F.lit(pattern)).cast("long"),
                f"_text_{i + 1}": F.regexp_replace(text, pattern, marker),
            }
        )
    totals = {
        kind: sum((F.col(f"_found_{i}") for i, p in enumerate(PASSES) if p[0] == kind), F.lit(0).cast("long"))
        for kind in kinds
    }
    steps = [f"_found_{i}" for i in range(len(PASSES))] + [f"_text_{i}" for i in range(len(PASSES) + 1)]
    return df.withColumns(totals).drop(*steps)


def join_context(context: Column) -> Column:
    """Context messages as one text; empty for a missing or empty list."""
    return F.coalesce(F.array_join(context, " "), F.lit(""))


def split_history(history: Column) -> tuple[Column, Column]:
    """(last item, the items before it) of a prepared history."""
    return (
        F.element_at(history, -1),
        F.slice(history, F.lit(1), F.size(history) - 1),
    )


def history_violation(history: Column) -> Column:
    """Why a history of (role, text) structs cannot be used, or null."""
    size = F.size(history)
    return (
        F.when(history.isNull() | (size == 0), F.lit("history_empty"))
        .when(size > MAX_HISTORY, F.lit("history_too_long"))
        .when(F.exists(history, lambda m: m["role"] != "customer"), F.lit("history_role"))
    )


def words(text: Column) -> Column:
    """Lower-case tokens of two or more word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"({WORD}{{2,}})"), 1)


def word_ngrams(tokens: Column, low: int = 1, high: int = 2) -> Column:
    """Word n-grams of a token array column, terms joined by a space."""
    grams, joined = [], tokens
    for n in range(1, high + 1):
        if n > 1:
            # the n-gram at i is the (n-1)-gram at i and the token at i + n - 1
            joined = F.zip_with(
                joined, F.slice(tokens, F.lit(n), F.greatest(F.size(tokens), F.lit(0))),
                lambda left, last: F.concat(left, F.lit(" "), last),
            )
            # zip_with pads the shorter side, which leaves a null at the end
            joined = F.filter(joined, lambda g: g.isNotNull())
        if n >= low:
            grams.append(joined)
    return F.concat(*grams)


def char_ngrams(text: Column, low: int = 2, high: int = 5) -> Column:
    """Character n-grams inside words padded by one space on each side."""
    padded = F.transform(
        F.filter(F.split(F.lower(text), rf"(?U){SPACE}+"), lambda w: w != ""),
        lambda w: F.concat(F.lit(" "), w, F.lit(" ")),
    )

    def grams(word: Column, n: int) -> Column:
        return F.when(
            F.length(word) >= n,
            F.transform(
                F.sequence(F.lit(1), F.length(word) - (n - 1)), lambda i: F.substring(word, i, F.lit(n))
            ),
        ).otherwise(F.array().cast("array<string>"))

    return F.flatten(
        F.transform(padded, lambda w: F.concat(*[grams(w, n) for n in range(low, high + 1)]))
    )
