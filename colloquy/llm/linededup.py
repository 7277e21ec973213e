"""Removal of lines that spread over many sites.

Per line (by a 128-bit hash of its text) a HyperLogLog sketch of the sites it stands on is built and merged by
aggregation. Lines whose estimate is clearly above MIN_SITES are boilerplate, those clearly below are not; for the lines
near the threshold the sites are counted exactly. Of a boilerplate line the first place, by document id and line number,
stays; every other place is taken out. A line of fewer than MIN_WORDS words is never boilerplate.

Lines travel as hashes. Counts and sketches are combined before the shuffle, so a line that holds a third of all rows
arrives as a row per task; the table of boilerplate lines is written first, so that its size decides how it is joined,
and the join's hot keys can be split.

Defined cases: a null text stays null and has no lines; a null site is a site of its own; a null id ranks before all
others; rows repeated with the same id and text are one document for the choice of the first place; an empty table gives
an empty result; other columns pass through, and n_chars, if there is one, follows the new text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm.arrowmap import by_place
from colloquy.llm.registry import query, table
from colloquy.session import materialize

MIN_SITES = 8
MIN_WORDS = 3
SKETCH_BITS = 10  # 2^10 registers: a relative error of 3 %
NEAR = 3  # standard errors within which sites are counted exactly

_LINE = ["h1", "h2"]
_DOC = ["_id", "_th"]
_WORDY = " +".join(["[^ ]+"] * MIN_WORDS).replace("[^ ]", r"[^\\x20\\x09-\\x0D]").replace(" +", r"[\\x20\\x09-\\x0D]+")


def _lines(docs: DataFrame, text: str, site: str, id_col: str) -> DataFrame:
    """A row of numbers and hashes per line that may be boilerplate."""
    numbered = docs.select(
        F.col(id_col).alias("_id"), F.xxhash64(text).alias("_th"), F.xxhash64(site, F.col(site).isNull()).alias("site"),
        F.posexplode(F.split(text, "\n")).alias("line", "t"),
    )
    return numbered.where(F.expr(f"t rlike '{_WORDY}'")).select(
        *_DOC, "site", "line", F.xxhash64("t").alias("h1"), F.xxhash64("t", F.lit(1)).alias("h2")
    )


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Lines on at least `min_sites` sites with their first place."""
    margin = max(1.0, NEAR * 1.04 / 2 ** (SKETCH_BITS / 2) * min_sites)
    sketched = lines.groupBy(*_LINE).agg(
        F.count(F.lit(1)).alias("n"), F.hll_sketch_agg("site", F.lit(SKETCH_BITS)).alias("sketch"),
        F.min(F.struct(F.col("_id").isNotNull().alias("known"), "_id", "line", "_th")).alias("first"),
    )
    # A line has no more sites than places.
    judged = sketched.where(F.col("n") >= min_sites).select(
        *_LINE, "first", F.hll_sketch_estimate("sketch").alias("sites")
    )
    maybe = materialize(judged.where(F.col("sites") >= min_sites - margin), "spread")
    near = maybe.where(F.col("sites") <= min_sites + margin).select(*_LINE)
    counted = lines.join(near, _LINE).groupBy(*_LINE).agg(F.count_distinct("site").alias("exact"))
    sure = maybe.where(F.col("sites") > min_sites + margin).select(*_LINE, "first")
    exact = maybe.join(counted.where(F.col("exact") >= min_sites).select(*_LINE), _LINE).select(*_LINE, "first")
    return materialize(sure.unionByName(exact), "boilerplate")


def remove_boilerplate(
    docs: DataFrame, text: str = "text", site: str = "source", id_col: str = "doc_id", min_sites: int = MIN_SITES
) -> DataFrame:
    """`docs` without boilerplate lines, and `n_removed`, the lines taken out."""
    lines = _lines(docs, text, site, id_col)
    known = boilerplate(lines, min_sites)
    hit = lines.join(known, _LINE).where(
        ~(F.col("_id").eqNullSafe(F.col("first._id")) & (F.col("line") == F.col("first.line")))
    )
    places = hit.groupBy(*_DOC).agg(F.collect_set("line").alias("_out"))  # no more than the text has lines
    kept = docs.drop("n_removed")
    placed, place, back = by_place(kept.withColumn("n_removed", F.lit(0).cast("long")))
    body, hit_here = place(text), F.col("_out").isNotNull()
    joined = placed.join(
        places, placed[place(id_col)].eqNullSafe(places["_id"]) & (F.xxhash64(placed[body]) == places["_th"]), "left"
    )
    rest = (
        f"transform(array(split(`{body}`, '\\n')), l -> array_join(transform("
        "array_except(sequence(0, size(l) - 1), _out), i -> l[i]), '\\n'))[0]"
    )
    out = joined.withColumn(body, F.when(hit_here, F.expr(rest)).otherwise(F.col(body)))
    if "n_chars" in kept.columns:
        n = place("n_chars")
        out = out.withColumn(n, F.when(hit_here, F.length(body)).otherwise(F.col(n)))
    return back(out.withColumn(place("n_removed"), F.when(hit_here, F.size("_out").cast("long")).otherwise(0)))


def line_dedup(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` without boilerplate lines; documents of which nothing but white space is left go."""
    placed, place, back = by_place(docs)
    names = {place(c): c for c in ("doc_id", "source", "n_chars") if c in docs.columns}
    named = placed.withColumnsRenamed(names)
    kept = remove_boilerplate(named, place(text)).where(
        (F.col("n_removed") == 0) | F.col(place(text)).rlike("[^\\x20\\x09-\\x0D]")
    )
    return back(kept.withColumnsRenamed({c: p for p, c in names.items()}))


_SQL = f"""
WITH l AS (SELECT doc_id, source, i - 1 AS line, ls[i] AS t FROM (
        SELECT doc_id, source, ls, unnest(range(1, len(ls) + 1)) AS i
        FROM (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL))),
wordy AS (SELECT * FROM l WHERE regexp_matches(t, '{_WORDY.replace(chr(92) * 2, chr(92))}')),
bad AS (SELECT t, min({{'id': doc_id, 'line': line}}) AS first FROM wordy GROUP BY t
        HAVING count(DISTINCT coalesce('s' || source, '')) >= {MIN_SITES}),
out AS (SELECT w.doc_id, w.line FROM wordy w JOIN bad USING (t)
        WHERE w.doc_id <> bad.first.id OR w.line <> bad.first.line),
rest AS (SELECT l.doc_id, coalesce(string_agg(t, chr(10) ORDER BY l.line) FILTER (WHERE out.line IS NULL), '') AS text,
        count(out.line) AS n_removed
    FROM l LEFT JOIN out ON l.doc_id = out.doc_id AND l.line = out.line GROUP BY l.doc_id)
SELECT d.doc_id, d.source, rest.text, coalesce(n_removed, 0) AS n_removed FROM documents d LEFT JOIN rest USING (doc_id)
"""


@query("op7_line_dedup", _SQL)
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return remove_boilerplate(docs).select("doc_id", "source", "text", "n_removed")
