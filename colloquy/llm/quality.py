"""Quality rules with risk-controlled cutoffs, in DataFrame and SQL functions only.

Every document is measured: words, symbols, repeated lines and passages. Fixed base limits reject first. Beyond them a
rule (a measure in thousandths with a grid of cutoffs) may reject only where labelled data allow it: for each stratum,
rule and cutoff the labelled good documents that the cutoff would reject are counted, and the cutoff is admitted when the
exact binomial test says that its true false-rejection rate is below `risk / rules`, at level
`error / (strata * rules)`. Along the cutoffs of one rule the test runs from loose to strict and stops at the first
failure (fixed-sequence testing; the count grows with strictness, so the strictest admitted cutoff is the answer). With
probability `1 - error` all rules together reject fewer than `risk` of the good documents of every stratum.

Defined cases: a null or empty text has no words and fails the base limits; a null stratum is a stratum of its own; null
labels are ignored; repeated label rows of a document count once, and it is good only if all of them say so; a stratum
with too few labels admits no cutoff, so nothing beyond the base limits is rejected there; repeated rows are measured
alike; an empty table gives an empty result; other columns pass through, and columns of the same names as the measures
are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm.arrowmap import by_place
from colloquy.llm.registry import query, table
from colloquy.session import materialize

# Measure in thousandths -> cutoffs, loose to strict. A document is rejected at or above an admitted cutoff.
RULES: dict[str, tuple[int, ...]] = {
    "symbol_rate": (400, 300, 200, 150, 100, 80, 60),
    "echo_rate": (600, 500, 400, 300, 200, 150),
    "dup_line_rate": (700, 600, 500, 400),
}
RISK = 0.03
ERROR = 0.05
BASE_WORDS = 20
BASE_REPEAT_PERCENT = 30
WINDOW = 8

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MEASURES = [*COUNTS, *RULES, "base_failed"]

_SPACE = r"[\\x20\\x09-\\x0D]+"


def _let(value: str, name: str, body: str) -> str:
    """SQL that evaluates `value` once and uses it as `name` in `body`."""
    return f"transform(array({value}), {name} -> {body})[0]"


# Words in windows seen twice: sort (hash, position) pairs, keep those with an equal neighbour and add up the ground
# that their windows cover. Texts whose windows all differ, nearly all of them, stop at the first comparison.
# Hashes of all windows by doubling: of two words, of four, of eight.
_HASHES = (
    f"slice({_let('transform(w, (x, i) -> xxhash64(x, get(w, i + 1)))', 'b', 'D2')}, 1, size(w) - {WINDOW - 1})".replace(
        "D2",
        _let(
            "transform(b, (x, i) -> xxhash64(x, get(b, i + 2)))", "q", "transform(q, (x, i) -> xxhash64(x, get(q, i + 4)))"
        ),
    )
)
_TWICE = "filter(s, (e, i) -> coalesce(get(s, i - 1).h = e.h, false) OR coalesce(get(s, i + 1).h = e.h, false))"
_COVERED = (
    f"aggregate(array_sort(transform({_TWICE}, e -> e.i)), named_struct('n', 0L, 'stop', 0),"
    f" (a, p) -> named_struct('n', a.n + p + {WINDOW} - greatest(a.stop, p), 'stop', p + {WINDOW}), a -> a.n)"
)
_PAIRS = "array_sort(transform(h, (x, i) -> named_struct('h', x, 'i', i)))"
_REPEATED = (
    f"CASE WHEN size(w) <= {WINDOW} THEN 0L ELSE "
    + _let(_HASHES, "h", f"CASE WHEN size(array_distinct(h)) = size(h) THEN 0L ELSE {_let(_PAIRS, 's', _COVERED)} END")
    + " END"
)
_COUNTED = (
    "named_struct('n_words', CAST(size(w) AS BIGINT),"
    " 'word_chars', aggregate(w, 0L, (a, x) -> a + length(x)),"
    " 'n_symbols', CAST(size(split(t, '[#*$%&|<>]')) - 1 AS BIGINT),"
    " 'n_lines', CAST(size(l) AS BIGINT),"
    " 'n_dup_lines', CAST(size(l) - size(array_distinct(l)) AS BIGINT),"
    " 'n_echoes', CAST(size(filter(w, (x, i) -> coalesce(get(w, i - 1) = x, false))) AS BIGINT),"
    f" 'n_repeat_words', {_REPEATED})"
)
_RATED = (
    "named_struct(" + ", ".join(f"'{c}', c.{c}" for c in COUNTS) + ","
    " 'symbol_rate', 1000 * c.n_symbols DIV greatest(c.word_chars, 1),"
    " 'echo_rate', 1000 * c.n_echoes DIV greatest(c.n_words, 1),"
    " 'dup_line_rate', 1000 * c.n_dup_lines DIV greatest(c.n_lines, 1),"
    f" 'base_failed', c.n_words < {BASE_WORDS} OR 100 * c.n_repeat_words > {BASE_REPEAT_PERCENT} * c.n_words)"
)


def _measured(text: str) -> str:
    """SQL struct of all measures of a text column; each array is built once."""
    words = f"filter(split(t, '{_SPACE}'), x -> x != '')"
    lines = rf"filter(split(t, '\\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')"
    counted = _let(words, "w", _let(lines, "l", _COUNTED))
    return _let(f"coalesce(CAST(`{text}` AS STRING), '')", "t", _let(counted, "c", _RATED))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with the columns MEASURES."""
    held = docs.drop(*MEASURES, "_m").withColumn("_m", F.expr(_measured(text)))
    return held.select("*", *(F.col("_m")[c].alias(c) for c in MEASURES)).drop("_m")


def _log_gamma(x: str) -> str:
    """SQL of ln gamma(x), x >= 1: Stirling's series eight steps up."""
    z = f"({x} + 8)"
    steps = " + ".join(f"ln({x} + {i})" for i in range(8))
    series = f"1 / (12 * {z}) - 1 / (360 * power({z}, 3)) + 1 / (1260 * power({z}, 5))"
    return f"(({z} - 0.5D) * ln({z}) - {z} + 0.5D * ln(2 * pi()) + {series} - ({steps}))"


def _binomial_tail(k: str, n: str, p: float) -> str:
    """SQL of P(X <= k) for X binomial (n, p); 1 where k / n >= p. The terms fall from k on, and those that a sum of
    doubles can still see are fewer than 60 standard deviations."""
    lk, ln, lnk = (_log_gamma(f"CAST({x} + 1 AS DOUBLE)") for x in (k, n, f"{n} - {k}"))
    at_k = f"exp({ln} - {lk} - {lnk} + {k} * ln({p}D) + ({n} - {k}) * ln(1 - {p}D))"
    ratio = f"(({k}) - i) / (({n}) - ({k}) + 1D + i) * {(1 - p) / p}D"
    total = (
        f"aggregate(sequence(0L, least({k}, CAST(60 * sqrt({n}) AS BIGINT) + 60)),"
        f" named_struct('s', 0D, 'x', 1D),"
        f" (a, i) -> named_struct('s', a.s + a.x, 'x', a.x * {ratio}), a -> a.s)"
    )
    return f"CASE WHEN {n} = 0 OR {k} >= {p}D * {n} THEN 1D ELSE {at_k} * {total} END"


def cutoffs(
    measured: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, error: float = ERROR,
    id_col: str = "doc_id", label: str = "quality",
) -> DataFrame:
    """One row per labelled stratum: the admitted cutoff of each rule (null: none) as `cut_<rule>`, and `n_good`, the
    holdout of good documents that pass the base limits."""
    good = (
        labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.min(label).alias("_good"))
    )
    held = (
        measured.select(F.col(id_col).alias("_id"), F.col(stratum).cast("string").alias("_stratum"), *MEASURES)
        .join(good, "_id")
        .where("_good = 1 AND NOT base_failed")
    )
    hits = [
        F.count_if(F.col(rule) >= c).alias(f"k_{rule}_{c}") for rule, grid in RULES.items() for c in grid
    ]
    counts = held.groupBy("_stratum").agg(F.count(F.lit(1)).alias("n_good"), *hits)
    counts = materialize(counts, "holdout")
    level = error / (max(counts.count(), 1) * len(RULES))
    each = risk / len(RULES)
    chosen = []
    for rule, grid in RULES.items():
        admitted = [
            F.expr(f"CASE WHEN {_binomial_tail(f'k_{rule}_{c}', 'n_good', each)} <= {level!r}D THEN {c}L END")
            for c in grid
        ]
        chosen.append(F.least(*admitted).alias(f"cut_{rule}"))
    return counts.select("_stratum", "n_good", *chosen)


def _verdict(struct: str) -> str:
    """SQL: the measures in `struct` pass the base limits and the admitted cutoffs of the row."""
    return f"NOT {struct}base_failed" + "".join(f" AND coalesce({struct}{r} < cut_{r}, true)" for r in RULES)


def _with_cutoffs(df: DataFrame, cuts: DataFrame, stratum: str) -> DataFrame:
    """The table of cutoffs, a row per stratum, is written first, so its size decides how it is joined."""
    cuts = materialize(cuts.drop("n_good"), "cutoffs")
    return df.join(cuts, df[stratum].cast("string").eqNullSafe(cuts["_stratum"]), "left")


def judge(measured: DataFrame, cuts: DataFrame, stratum: str = "lang") -> DataFrame:
    """`measured` with `kept`."""
    mine = ("kept", "_stratum", *(f"cut_{r}" for r in RULES))
    held = _with_cutoffs(measured.drop(*mine), cuts, stratum).withColumn("kept", F.expr(_verdict("")))
    return held.drop("_stratum", *(f"cut_{r}" for r in RULES))


def quality_filter(docs: DataFrame, labels: DataFrame, text: str = "text", stratum: str = "lang") -> DataFrame:
    """The rows of `docs` that the rules keep, with their columns. Measures are written without the texts to find the
    cutoffs; the texts are then measured again where they are, which needs no shuffle of texts."""
    slim = docs.select(F.col("doc_id"), F.col(stratum).alias("_lang"), F.col(text).alias("_text"))
    slim = materialize(measure(slim, "_text").drop("_text"), "measures")
    placed, place, back = by_place(docs)
    held = _with_cutoffs(placed, cutoffs(slim, labels, "_lang"), place(stratum))
    return back(held.where(F.expr(_let(_measured(place(text)), "m", _verdict("m.")))))


_N_RULES = len(RULES)
_TAIL = """CASE WHEN n_good = 0 OR k >= {p} * n_good THEN 1 ELSE
    (SELECT sum(exp(lgamma(n_good + 1) - lgamma(j + 1) - lgamma(n_good - j + 1) + j * ln({p}) + (n_good - j) * ln(1 - {p})))
     FROM (SELECT unnest(range(0, k + 1)) AS j)) END"""
_SQL = f"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, lang, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
win AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + {WINDOW - 1}), ' ') AS g
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM w WHERE len(w) >= {WINDOW})),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS j FROM twice)
        GROUP BY doc_id),
c AS (SELECT w.doc_id, lang, CAST(len(w) AS BIGINT) AS n_words,
        CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, len(l) AS n_lines,
        CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
        len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_echoes
      FROM w LEFT JOIN rep USING (doc_id)),
m AS (SELECT *, 1000 * n_symbols // greatest(word_chars, 1) AS symbol_rate,
        1000 * n_echoes // greatest(n_words, 1) AS echo_rate, 1000 * n_dup_lines // greatest(n_lines, 1) AS dup_line_rate,
        n_words < {BASE_WORDS} OR 100 * n_repeat_words > {BASE_REPEAT_PERCENT} * n_words AS base_failed FROM c),
good AS (SELECT m.* FROM m JOIN labels USING (doc_id) WHERE quality = 1 AND NOT base_failed),
grid AS (SELECT * FROM (VALUES {", ".join(f"('{r}', {c})" for r, g in RULES.items() for c in g)}) g(rule, cut)),
tested AS (SELECT lang, rule, cut, count(*) AS n_good, count(*) FILTER (WHERE
        CASE rule {" ".join(f"WHEN '{r}' THEN {r}" for r in RULES)} END >= cut) AS k FROM good, grid GROUP BY ALL),
admitted AS (SELECT lang, rule, min(cut) AS cut FROM (SELECT *, {_TAIL.format(p=RISK / _N_RULES)} AS tail FROM tested)
        WHERE tail <= {ERROR} / (SELECT {_N_RULES} * count(DISTINCT coalesce(lang, '<null>')) FROM good) GROUP BY ALL),
hit AS (SELECT DISTINCT m.doc_id FROM m JOIN admitted a ON m.lang IS NOT DISTINCT FROM a.lang
        AND CASE a.rule {" ".join(f"WHEN '{r}' THEN {r}" for r in RULES)} END >= a.cut)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM hit) AS kept FROM m
"""


@query("op9_quality_rules", _SQL)
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    slim = materialize(measure(docs).drop("text"), "measures")
    kept = judge(slim, cutoffs(slim, table(spark, sf_dir, "labels")))
    return kept.select("doc_id", *COUNTS, "base_failed", "kept")
