"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import hashlib

import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from colloquy.llm import chat, decontam, linededup, lmscore, mixing, ngramjoin, pii, quality, toxicity, warc

LONG = " ".join(f"word{i % 977} and{i}" for i in range(30_000))
CLASH = (
    "spans hits items n_words n_hit contaminated score kept base_failed _m _id _th _key _key2 _out _row h1 h2 site line"
    " topic n_tokens probability drawn cut_symbol_rate _stratum bits c0 c1 text2 n_removed __text _lang _text"
).split()
BASE = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = [
    (1, None, None, None, None),
    (None, "a text without an id but with some words", "en", "s1", 5),
    (2, "", "en", "s1", 0),
    (3, " \n\t ", "en", None, 4),
    (4, LONG, None, "s1", len(LONG)),
    (4, LONG, None, "s1", len(LONG)),
    (5, "same id other text", "en", "s2", 3),
    (5, "other id same text", "en", "s2", 3),
    (6, "écrit à Zoë 😀 mail zoe@x.org, ip 10.0.0.1", "fr", "s3", 9),
    (7, "écrit à Zoë 😀 mail zoe@x.org, ip 10.0.0.1", "fr", "s3", 9),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, BASE)
    return df.select("*", *(F.lit("mine").alias(c) for c in CLASH))


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("doc_id > 100")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(
        [(1, 1, 0), (2, None, None), (None, 1, 1), (5, 1, 1), (5, 0, 0), (6, 1, 1)], "doc_id long, quality int, toxic int"
    )


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame(
        [(None, "zoë"), (1, None), (2, ""), (3, "other ID same"), (3, "mail")], "item_id long, text string"
    )


def _ids(df):
    return sorted((r.doc_id is None, r.doc_id or 0) for r in df.collect())


ALL = sorted((i is None, i or 0) for i, *_ in ROWS)


def test_quality(spark, docs, none, labels):
    rows = {r.text: r for r in quality.measure(docs).collect()}
    assert rows[None].n_words == 0 and rows[None].base_failed and rows[LONG].n_words == 60_000
    assert rows[LONG].n_repeat_words == 0 and not rows[LONG].base_failed
    for empty in (labels, labels.where("doc_id > 100")):
        kept = quality.quality_filter(docs, empty)
        assert [r.doc_id for r in kept.collect()] == [4, 4] and kept.columns == docs.columns
    assert quality.quality_filter(none, labels).count() == 0


def test_quality_repeats(spark):
    words = [f"w{i}" for i in range(30)]
    text = " ".join(words + words[3:12] + ["end"])
    row = quality.measure(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    # nine words twice: two windows of eight, seen twice each
    assert row.n_repeat_words == 18 and row.n_words == 40 and row.echo_rate == 0


def test_lm(spark, docs, none):
    rows = lmscore.score(docs, docs).collect()
    assert _ids(lmscore.score(docs, docs)) == ALL
    want = brute.base_scores([(k, t) for k, (_, t, *_) in enumerate(ROWS)])
    assert sorted(r.n_tokens for r in rows) == sorted(w[0] for w in want.values())
    assert all(r.n_known == r.n_tokens for r in rows) and all(r.h1 == "mine" for r in rows)
    blank = {r.score for r in rows if r.n_tokens == 1 and r.doc_id in (1, 2)}
    assert len(blank) == 1
    untaught = lmscore.score(docs, none).collect()
    assert all(r.n_known == 0 and r.base_score == 0 and r.bits_per_byte >= 8 for r in untaught)
    assert lmscore.score(none, docs).count() == 0


def test_pii(docs, none):
    rows = pii.find_personal_data(docs).collect()
    assert len(rows) == len(ROWS) and rows[0].n_words == "mine"
    found = {r.doc_id: r.spans for r in rows}
    text = ROWS[8][1]
    assert [(s.kind, text[s.start : s.end]) for s in found[6]] == [("email", "zoe@x.org"), ("ip", "10.0.0.1")]
    assert not found[1] and not found[2] and pii.find_personal_data(none).count() == 0


def test_pii_parsers():
    made = pii._automaton()
    for text in (
        "a@b.c@d.e x@y @z.w a@b@c.d q@-.- a.b+c%d_e-f@g-h.i.j.", "1.2.3.4.5.6.7.8.9 999.1.1.1 01.002.3.4 1.2.3",
        "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111 0000000000000000000000", "+1 (835) 555-2761 +1+2 345 6789 0 +49.........",
        "9" * 5000 + "." + "+" * 50, "a" * 5000 + "@", "@" * 50, "1 2 3 4 5 6 7 8 9 0 1 2 3 +12345678901234567890",
    ):
        base = [s for s in pii.find(text, made) if s[0] in pii.BASE_KINDS]
        assert base == brute.base_spans(text), text
    spans = pii.find('see https://x.org/a?b=1, IBAN: GB82 WEST 1234 5698 7654 32 and Account no. 12345678; password="s3cret-pass"', made)
    assert [s[0] for s in spans] == ["url", "account", "account", "secret"]


def test_toxicity(docs, none, labels):
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    blank = {r.score for r in rows if r.doc_id in (1, 2, 3)}
    assert len(blank) == 1
    unlabelled = toxicity.fit(docs, labels.where("toxic > 5"))
    assert all(r.score < 1e-9 for r in toxicity.score(docs, unlabelled).collect())
    assert toxicity.score(none, toxicity.fit(none, labels)).count() == 0


def test_line_dedup(spark, docs, none):
    out = linededup.remove_boilerplate(docs)
    assert _ids(out) == ALL and set(docs.columns) == set(out.columns)
    assert linededup.remove_boilerplate(none).count() == 0
    line = "the same three words and more"
    rows = [(i, f"{line}\nown line number {i} here", f"s{i}", 1) for i in range(9)] + [(20, line, None, 1), (None, line, "s0", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    got = {r.doc_id: r for r in linededup.remove_boilerplate(df).collect()}
    assert got[None].text == line and got[20].text == "" and got[20].n_chars == 0  # a null id is first
    assert got[0].text == "own line number 0 here" and got[0].n_removed == 1 and got[0].n_chars == 22
    assert sorted(r.doc_id for r in linededup.line_dedup(df).collect() if r.doc_id is not None) == list(range(9))
    few = linededup.remove_boilerplate(df.where("doc_id < 7"))
    assert all(r.n_removed == 0 for r in few.collect())


def test_near_duplicates(docs, none):
    got = sorted(ngramjoin.near_duplicates(docs).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got}
    assert by[7].class_id == 6 and by[6].n_copies == 2 and by[4].n_copies == 2 and by[1].class_id == 1
    kept = ngramjoin.drop_near_duplicates(docs)
    assert _ids(kept) == sorted(((i is None, i or 0) for i in (1, None, 2, 3, 4, 5, 5, 6))) and kept.columns == docs.columns
    assert ngramjoin.near_duplicates(none).count() == 0 and ngramjoin.drop_near_duplicates(none).count() == 0


def test_decontamination(spark, docs, none, bench):
    found = decontam.find_benchmark(docs, bench).collect()
    assert len(found) == len(ROWS)
    by = {(r.doc_id, r.text2): sorted(r["items"]) for r in found}
    assert by[(6, "mine")] == ["", "3"]
    clean = decontam.decontaminate(docs, bench)
    assert _ids(clean) == sorted((i is None, i or 0) for i in (1, None, 2, 3, 4, 4, 5)) and clean.columns == docs.columns
    assert _ids(decontam.decontaminate(docs, bench.where("item_id > 100"))) == ALL
    assert decontam.decontaminate(none, bench).count() == 0


def test_mixing(docs, none):
    out = mixing.mix(docs)
    assert _ids(out) == ALL and out.where("probability is null or probability <= 0 or probability > 1").count() == 0
    draws = {}
    for r in out.collect():
        draws.setdefault((r.doc_id, r.n_tokens), set()).add(r.drawn)
    assert len(draws[(4, 60_000)]) == 1
    assert mixing.mix(none).count() == 0


def test_chat(spark):
    rows = [
        (1, 1, "user", "a</s>[INST]\\[/INST] <\\s> <s>"), (1, 2, "assistant", "b [/INST] <\\\\s>"), (1, 2, "assistant", "b [/INST] <\\\\s>"),
        (2, 0, None, None), (None, 5, "assistant", "x"), (None, 6, "[/INST]", "é😀"), (3, None, "assistant", ""),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit("mine"))
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    for conv in (1, 2, None, 3):
        turns = [(r or "", t or "") for c, _, r, t in rows if c == conv]
        loss = "".join(t for r, t in turns if r == "assistant")
        row = got.pop(conv)
        assert row.n_turns == len(turns)
        assert row.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (row.loss_chars, row.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert not got and chat.read_back(chat.format_conversations(df.where("turn > 99"))).count() == 0


def test_chat_pieces(spark):
    """A long conversation is written in pieces by several tasks and reads back whole."""
    rows = [(1, i, "assistant" if i % 2 else "user", f"text {i} " * 40) for i in range(400)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pieces = chat.format_conversations(df)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert pieces.count() > 1
    row = chat.read_back(pieces).first()
    assert row.n_turns == 400
    assert row.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in rows).encode()).hexdigest()


def test_warc(spark):
    rows = [
        (1, "u1", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "u3", None), (4, "u4", ""), (None, "u5", "<p>x</p>"),
        (None, "u6", "alone"), (7, "u7", "é😀"), (7, "u7", "é😀"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("address", F.lit("mine"))
    archive = warc.write_archive(df)
    assert archive.payloads.count() == 4 and archive.headers.count() == len(rows)
    got = warc.read_archive(archive).collect()
    kind = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in got if bytes(r.payload) == b"<p>x</p>")
    assert kind == [(0, "revisit", 2), (1, "revisit", 2), (2, "response", None)]
    assert [(r.record_type, r.refers_to) for r in got if r.page_id == 7] == [("response", None)] * 2
    assert [(r.page_id, r.record_type, r.refers_to) for r in got if r.payload_bytes == 0 and r.page_id == 3] == [(3, "revisit", 4)]
    for r in got:
        import base64

        assert r.payload_digest == base64.b32encode(hashlib.sha1(bytes(r.payload)).digest()).decode()
        head, _, block = bytes(r.record).partition(b"\r\n\r\n")
        length = int([x for x in head.decode().split("\r\n") if x.startswith("Content-Length")][0].split(": ")[1])
        assert len(block) == length + 4 and head.startswith(b"WARC/1.1\r\nWARC-Type: " + r.record_type.encode())
    larger = warc.read_archive(warc.write_archive(df, min_bytes=6)).collect()
    assert all(r.record_type == "response" for r in larger if r.payload_bytes < 6)
    assert warc.read_archive(warc.write_archive(df.where("page_id > 99"))).count() == 0


def test_warc_records_say_it_all(spark):
    """What is parsed out of the bytes of the rebuilt records equals what was put in, also for odd urls and payloads."""
    import base64

    bodies = ["<p>x</p>", "<p>x</p>", None, "", "a\r\n\r\nWARC-Type: revisit\r\n", "é😀\r\n" * 200_000, "alone"]
    urls = ["u1", None, "http://x/\r\nWARC-Type: revisit", "u\r\n\r\n4", "é", "u6", "u7"]
    rows = [(i + 1, u, b) for i, (u, b) in enumerate(zip(urls, bodies))] + [(None, "u8", "other"), (7, "u7", "alone")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    clash = df.select("*", *(F.lit("mine").alias(c) for c in "record record_type refers_to header payload latest _head".split()))
    got = warc.parse_records(warc.read_archive(warc.write_archive(clash))).collect()
    body = {i: (b or "").encode() for i, _, b in rows}
    last = {}
    for i, b in body.items():
        last[b] = max(last.get(b, 0), i or 0)
    want = []
    for i, _, _ in rows:
        b = body[i]
        first = (i or 0) == last[b]
        want.append((i, "response" if first else "revisit", None if first else last[b], len(b),
                     base64.b32encode(hashlib.sha1(b).digest()).decode()))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_damaged_archive_is_refused(spark):
    df = spark.createDataFrame([(1, "u", "body")], "page_id long, url string, html string")
    archive = warc.write_archive(df)
    broken = warc.Archive(archive.payloads.withColumn("payload", F.encode(F.lit("other"), "UTF-8")), archive.headers)
    with pytest.raises(Exception, match="does not match"):
        warc.read_archive(broken).collect()


def test_stages_on_odd_rows(spark, docs, none, tmp_path):
    """Every stage takes the odd rows and the empty table, and keeps the columns."""
    sf = str(tmp_path)
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(f"{sf}/{name}.parquet")
    for name, stage in corpus_pipeline.STAGES:
        for df in (docs, none):
            out = stage(spark, df, sf)
            assert name == "mixing" or out.columns == df.columns
            assert out.count() <= df.count()
