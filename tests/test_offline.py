"""The whole way from lines to the gate, on a corpus where words give the label
away and on one where they do not."""

import json
import random

import pytest

from pyspark.sql import functions as F

from colloquy.plans import offline

PHRASES = {-1.0: "terrible broken awful", -0.5: "slow late annoying", 0.0: "what time please",
           0.5: "good helpful thanks", 1.0: "excellent perfect wonderful"}


def _lines(spark, signal, customers=60, seed=4):
    rng = random.Random(seed)
    filler = "alpha beta gamma delta epsilon zeta".split()
    out, n = [], 0
    for u in range(customers):
        for c in range(2):
            for m in range(6):
                n += 1
                customer = m != 1
                level = rng.choice(list(PHRASES))
                words = rng.choices(filler, k=4) + ([PHRASES[level]] if signal and customer else [])
                if n % 10 == 0:
                    words.append("a@b.co")
                out.append(json.dumps({
                    "corpus_id": "syn-x", "conversation_id": f"syn-c{u}-{c}", "customer_id": f"syn-u{u}",
                    "message_id": f"syn-m{n}", "role": "customer" if customer else "agent", "text": " ".join(words),
                    "sent_at": f"2024-01-01T00:{m:02d}:00Z", "persona": f"persona_{'abcd'[u % 4]}",
                    "generated_label": level if customer else None,
                }))
    return spark.createDataFrame([("syn-x", i, s) for i, s in enumerate(out, 1)], "corpus string, line_no long, value string")


@pytest.mark.parametrize("signal", [True, False])
def test_gate(spark, signal):
    result = offline.run(_lines(spark, signal), skip_minimums=True, width=1 << 10, tol=1e-6)
    assert result.gate.first().passed is signal
    assert result.predictions.filter("text_clean like '%@%'").isEmpty()
    assert result.by_persona.count() <= 4
    context = result.by_context.first()
    assert context.with_context_rows + context.no_context_rows == result.errors.first().n
    if signal:
        assert result.spearman.first().spearman > 0.8


def test_small_corpus_is_rejected(spark):
    with pytest.raises(offline.NotApproved, match="status_not_ok"):
        offline.run(_lines(spark, True, customers=5))


def test_one_report_per_corpus(spark, tmp_path):
    """Files with nothing wrong, with warnings, with a bad line, with a bad composition, and that stop being readable."""
    good = [r.value for r in _lines(spark, True).orderBy("line_no").collect()]

    def named(corpus, lines):
        return [line.replace("syn-x", corpus) for line in lines]

    files = {
        "fine": named("fine", good),
        "warned": ["", *named("warned", [good[1], good[0], *good[2:]]), "  "],
        "broken": [*named("broken", good[:-1]), "{nope"],
        "short": named("short", good[:3]),
        "marked": named("marked", good),
        "cut": named("cut", good),
    }
    for name, lines in files.items():
        data = "\n".join(lines).encode()
        if name == "marked":
            data = b"\xef\xbb\xbf" + data
        if name == "cut":
            data = data.replace(b"broken", b"br\xffken", 1) if b"broken" in data else data + b"\n\xff"
        (tmp_path / f"{name}.jsonl").write_bytes(data)
    made = offline.check_files(spark, str(tmp_path), skip_minimums=True)
    got = {r.corpus: r for r in made.report.collect()}
    assert {c: (r.status, r.composition) for c, r in got.items()} == {
        "fine": ("ok", "evaluated"), "warned": ("ok", "evaluated"), "broken": ("rejected", "not_evaluated"),
        "short": ("rejected", "evaluated"), "marked": ("rejected", "not_evaluated"), "cut": ("rejected", "not_evaluated"),
    }
    assert list(got["fine"].warnings) == [] and list(got["warned"].warnings) == ["blank_lines_skipped", "file_unordered"]
    assert (got["warned"].blank_lines, got["warned"].unordered_conversations) == (2, 1)
    listed = {}
    for r in made.errors.collect():
        listed.setdefault(r.corpus, []).append(r.code)
    assert listed["marked"] == ["IG_R04_ENCODING_INVALID"] and listed["broken"] == ["DC_R01_INVALID_JSON"]
    assert "IG_R04_ENCODING_INVALID" in listed["cut"] and {c[:6] for c in listed["short"]} <= {"DC_R14", "DC_R15", "DC_R16"}
    assert {c: len(codes) for c, codes in listed.items()} == {c: r.errors for c, r in got.items() if r.errors}
    assert made.status == "rejected"
