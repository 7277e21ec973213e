"""Cleaning, masking, counting and n-grams against plain Python."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from colloquy.functions import text as t


def py_clean(s):
    stripped = s.strip()
    if not stripped:
        return stripped
    one_line = unicodedata.normalize("NFC", re.sub(r"\s+", " ", stripped))
    visible = "".join(c for c in one_line if unicodedata.category(c) not in ("Cc", "Cf"))
    return visible if visible.strip() else stripped


ALPHABET = (
    list("abc XYZ09._@-()+") + ["\t", "\n", "\x1c", "\x85", " ", " ", "​", "‍", "é", "é",
    "̀", "Å", "\U0001f600", "﻿", "\x07", "أ", "가", "가"]
)


def _random_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(ALPHABET, k=rng.randrange(0, 14))) for _ in range(n)]


def test_clean_equals_python(spark):
    texts = _random_texts(1500, 4) + ["", "   ", "​", " ​‍ ", "a ​ b", "ok 😀!"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    got = {r.i: r.c for r in t.with_clean(df, "s", "c").collect()}
    for i, s in enumerate(texts):
        assert got[i] == py_clean(s), repr(s)


@pytest.mark.parametrize(
    "text, masked",
    [
        ("write to ana.b+c@mail.example.org now", "write to <EMAIL> now"),
        ("cpf 123.456.789-09.", "cpf <CPF>."),
        ("call (11) 91234-5678", "call <TEL>"),
        ("call +55 11 91234-5678 today", "call <TEL> today"),
        ("call 1234-5678", "call <TEL>"),
        ("raw 11912345678 end", "raw <TEL> end"),
        ("bare cpf 12345678909", "bare cpf <TEL>"),
        ("order 123456789 stays", "order 123456789 stays"),
        ("x@y.co 123.456.789-09 1234-5678", "<EMAIL> <CPF> <TEL>"),
        ("é1191234567 inside a word", "é1191234567 inside a word"),
    ],
)
def test_mask(spark, text, masked):
    df = spark.createDataFrame([(text,)], "s string").withColumn("m", t.mask(F.col("s")))
    row = t.with_personal_counts(df.withColumn("again", t.mask(F.col("m"))), "s").first()
    assert row.m == masked and row.again == masked
    assert row.email == masked.count("<EMAIL>")
    assert row.cpf == masked.count("<CPF>")
    assert row.phone == masked.count("<TEL>")


def test_unicode_digits_are_digits(spark):
    arabic = "١٢٣٤-١٢٣٤"
    assert spark.createDataFrame([(arabic,)], "s string").select(t.mask(F.col("s"))).first()[0] == "<TEL>"


def py_char_ngrams(s, low, high):
    out = []
    for word in s.lower().split():
        w = f" {word} "
        for n in range(low, high + 1):
            out += [w[i : i + n] for i in range(len(w) - n + 1)]
    return sorted(out)


def test_ngrams(spark):
    texts = _random_texts(200, 8) + ["one", "one two three", "a b c", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    rows = df.withColumn("w", t.words(F.col("s"))).select(
        "i", t.word_ngrams(F.col("w")).alias("words"), t.word_ngrams(F.col("w"), 2, 3).alias("long"),
        t.char_ngrams(F.col("s")).alias("chars"),
    )
    for r in rows.collect():
        tokens = re.findall(r"\b\w\w+\b", texts[r.i].lower())
        if "̀" not in texts[r.i] and "́" not in texts[r.i]:
            pairs = [" ".join(p) for p in zip(tokens, tokens[1:])]
            triples = [" ".join(p) for p in zip(tokens, tokens[1:], tokens[2:])]
            assert list(r.words) == tokens + pairs
            assert list(r.long) == pairs + triples
        assert sorted(r.chars) == py_char_ngrams(texts[r.i], 2, 5)


def test_history_violations(spark):
    def history(n, role="customer"):
        return [(role if i == 0 else "customer", f"t{i}") for i in range(n)]

    rows = [(0, []), (1, history(1)), (2, history(30)), (3, history(31)), (4, history(5, "agent")), (5, None)]
    df = spark.createDataFrame(rows, "i int, h array<struct<role:string,text:string>>")
    got = dict(df.select("i", t.history_violation(F.col("h"))).collect())
    assert got == {0: "history_empty", 1: None, 2: None, 3: "history_too_long", 4: "history_role", 5: "history_empty"}
    last, earlier = t.split_history(F.col("h"))
    one = df.filter("i = 1").select(last["text"].alias("l"), F.size(earlier).alias("n"), t.join_context(earlier["text"]).alias("j")).first()
    assert (one.l, one.n, one.j) == ("t0", 0, "")
