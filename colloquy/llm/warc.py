"""A content-addressed WARC archive.

Payload bytes are stored once under their SHA-256; the exact record headers are kept in a table of their own with the
address of the payload. On writing, all payloads of one address must agree in length and in a second digest (SHA-1); on
reading, every stored payload is hashed again and must match its address. Original records, header and block byte for
byte, come back by a join on the address.

Of the records with equal payloads of at least `min_bytes` bytes, the one with the largest page id is a `response`, the
others are `revisit` records that refer to it; smaller payloads are always `response`.

Payload bytes are shuffled once, after equal ones met in their task; the copies of one page, however many, travel as
slim header rows.

Defined cases: a null payload is empty; null urls are empty; a null page id ranks below all others, and its row is a
`response` only if no other row of that payload has an id; rows repeated with the same id and payload get equal records;
an empty table gives an empty archive; other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm.registry import query, table
from colloquy.session import materialize

MIN_BYTES = 0
DATE = "1970-01-01T00:00:00Z"  # the tables name no capture time
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: five bytes are eight digits, twenty bytes four such groups."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", ALPHABET)


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def _one_line(url: Column) -> Column:
    """A line break would end the header field."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    return F.replace(F.replace(text, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def _http_head(length: Column) -> Column:
    return F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "),
        length.cast("string"), F.lit("\r\n\r\n"),
    )


def _header(kind: Column, head: Column) -> Column:
    """Header of a record: the block of a revisit is the HTTP head alone."""
    block = F.length(head) + F.when(kind == "response", F.col("payload_bytes")).otherwise(F.lit(0))
    revisit = F.concat(
        F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "),
        _record_id(F.col("refers_to")), F.lit("\r\n"),
    )
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), kind, F.lit("\r\nWARC-Record-ID: "), _record_id(F.col("page_id")),
        F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), _one_line(F.col("url")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("payload_digest"), F.lit("\r\n"),
        F.when(kind == "revisit", revisit).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), block.cast("string"),
        F.lit("\r\n\r\n"),
    )


@dataclass
class Archive:
    """payloads: address, payload. headers: page_id, record_type, refers_to, header, http_head, address."""

    payloads: DataFrame
    headers: DataFrame


def write_archive(pages: DataFrame, payload: str = "html", min_bytes: int = MIN_BYTES) -> Archive:
    """Write a record for every row of `pages` (page_id, url, payload)."""
    rows = pages.select(
        "page_id", "url", F.encode(F.coalesce(F.col(payload).cast("string"), F.lit("")), "UTF-8").alias("payload")
    ).withColumn("address", F.unhex(F.sha2("payload", 256)))
    stored = rows.groupBy("address").agg(
        F.first("payload").alias("payload"), F.max("page_id").alias("latest"),
        F.min(F.sha1("payload")).alias("low"), F.max(F.sha1("payload")).alias("high"),
    )
    sound = stored.where(
        F.when(F.col("low") == F.col("high"), True).otherwise(F.raise_error(F.lit("two payloads of one address")))
    )
    payloads = materialize(sound.drop("low", "high"), "warc-payloads")
    slim = rows.select(
        "page_id", "url", "address", F.length("payload").cast("long").alias("payload_bytes"),
        base32_sha1(F.col("payload")).alias("payload_digest"),
    )
    kind = F.when(
        (F.col("payload_bytes") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("latest")), "revisit"
    ).otherwise("response")
    typed = (
        slim.join(payloads.select("address", "latest"), "address")
        .withColumn("record_type", kind)
        .withColumn("refers_to", F.when(F.col("record_type") == "revisit", F.col("latest")))
        .withColumn("http_head", _http_head(F.col("payload_bytes")))
    )
    headers = typed.select(
        "page_id", "record_type", "refers_to", _header(F.col("record_type"), F.col("http_head")).alias("header"),
        "http_head", "address",
    )
    return Archive(payloads, materialize(headers, "warc-headers"))


def read_archive(archive: Archive) -> DataFrame:
    """The records: page_id, record_type, refers_to, header, the whole payload (that of a revisit is found by its
    address), its length and digest computed from the stored bytes, and `record`, the bytes of the record."""
    checked = archive.payloads.select(
        "address",
        F.when(F.unhex(F.sha2("payload", 256)) == F.col("address"), F.length("payload").cast("long"))
        .otherwise(F.raise_error(F.lit("a stored payload does not match its address")))
        .alias("payload_bytes"),
        base32_sha1(F.col("payload")).alias("payload_digest"),
        "payload",
    )
    block = F.concat(
        F.encode("http_head", "UTF-8"),
        F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b"")),
    )
    return archive.headers.join(checked, "address").withColumn(
        "record", F.concat(F.encode("header", "UTF-8"), block, F.lit(b"\r\n\r\n"))
    )


def parse_records(records: DataFrame, id_type: str = "long") -> DataFrame:
    """What the bytes `record` of `read_archive` say: page_id, record_type, refers_to, payload_bytes and payload_digest.
    Length and digest of a response are those of the bytes in its block; a revisit has no payload of its own, so they are
    those of the stored payload that its address leads to."""
    end = F.lit("\r\n\r\n")
    # one character a byte
    text = records.select(
        F.decode("record", "ISO-8859-1").alias("_text"), F.col("payload_bytes").alias("_bytes"),
        F.col("payload_digest").alias("_digest"),
    )
    cut = text.withColumn("_head", F.substring_index("_text", "\r\n\r\n", 1))

    def field(name: str, pattern: str) -> Column:
        return F.nullif(F.regexp_extract("_head", f"(?:^|\r\n){name}: {pattern}(?:\r\n|$)", 1), F.lit(""))

    block = F.substring(
        F.col("_text"), F.length("_head") + F.length(end) + 1, field("Content-Length", r"(\d+)").cast("int")
    )
    fields = cut.select(
        field("WARC-Record-ID", "<urn:page:(.*)>").cast(id_type).alias("page_id"),
        field("WARC-Type", r"(\S+)").alias("record_type"),
        field("WARC-Refers-To", "<urn:page:(.*)>").cast(id_type).alias("refers_to"),
        block.alias("_block"), "_bytes", "_digest",
    )
    own = F.substr(F.col("_block"), F.locate("\r\n\r\n", F.col("_block")) + F.length(end))
    payload = fields.withColumn("_own", F.when(F.col("record_type") == "response", F.encode(own, "ISO-8859-1")))
    return payload.select(
        "page_id", "record_type", "refers_to",
        F.coalesce(F.length("_own").cast("long"), F.col("_bytes")).alias("payload_bytes"),
        F.coalesce(base32_sha1(F.col("_own")), F.col("_digest")).alias("payload_digest"),
    )


_DIGITS = " || ".join(
    f"substr('{ALPHABET}', CAST(1 + ((g{k} >> {35 - 5 * j}) & 31) AS INTEGER), 1)" for k in range(4) for j in range(8)
)
_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
g AS (SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes, t, {", ".join(
    f"CAST('0x' || substr(sha1(t), {1 + 10 * k}, 10) AS BIGINT) AS g{k}" for k in range(4)
)}, max(page_id) OVER (PARTITION BY t) AS latest FROM p)
SELECT page_id, payload_bytes, {_DIGITS} AS payload_digest,
    CASE WHEN payload_bytes >= {MIN_BYTES} AND page_id <> latest THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= {MIN_BYTES} AND page_id <> latest THEN latest END AS refers_to
FROM g
"""


@query("op8_warc", _SQL)
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = parse_records(read_archive(write_archive(table(spark, sf_dir, "pages"))))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
