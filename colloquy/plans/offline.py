"""From corpus lines to an evaluated model: check, label, window, split, fit,
measure. Each step is one of the operators; tables are written between them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators import dataset, labels, metrics, validation
from colloquy.plans import regression
from colloquy.session import materialize
from colloquy.sources import corpus


class NotApproved(Exception):
    """A gate did not let the next step run."""


@dataclass
class Corpus:
    """`report` and `errors` have a row per corpus and per listed error."""

    checked: validation.Checked
    composition: DataFrame
    report: DataFrame
    errors: DataFrame

    @property
    def status(self) -> str:
        """`ok` if all corpora are; `rejected` also where there is none."""
        found = self.report.agg(F.count_if(F.col("status") != "ok"), F.count(F.lit(1))).first()
        return "ok" if found[0] == 0 and found[1] else "rejected"


def check_corpus(lines: DataFrame, skip_minimums: bool = False, encoding: DataFrame | None = None) -> Corpus:
    """Validate lines (corpus, line_no, value). `encoding` holds the errors
    (corpus, line_no, code, detail) that kept further lines from being read."""
    checked = validation.check(lines)
    composed = materialize(validation.composition(checked.survivors, skip_minimums), "composition")
    made = materialize(validation.report(lines, checked, composed, encoding), "corpus-report")
    whole = composed.join(made.filter("composition = 'evaluated'").select("corpus"), "corpus", "left_semi")
    return Corpus(checked, composed, made, validation.error_list(checked.parsed, encoding=encoding, composed=whole))


def check_files(spark: SparkSession, path: str, skip_minimums: bool = False) -> Corpus:
    """Validate the corpora in the files of `path`, each file being one. A file is
    read up to its first line that is not UTF-8, and not at all if it starts with a
    byte order mark."""
    lines = corpus.scan_lines(spark, path)
    faults = materialize(corpus.encoding_errors(lines, corpus.inspect_files(corpus.files(spark, path))), "encoding")
    named = faults.withColumn("corpus", corpus.stem(F.col("path"))).drop("path")
    kept = corpus.readable_lines(lines, faults).select("corpus", "line_no", "value")
    return check_corpus(materialize(kept, "lines"), skip_minimums, named)


def build_examples(messages: DataFrame, **shares) -> DataFrame:
    """Split examples from the valid messages of a corpus, written once."""
    made = labels.label_rows(messages, F.col("corpus"))
    examples = dataset.assemble_examples(dataset.feature_rows(messages.drop("generated_label")), made)
    return materialize(dataset.grouped_split(examples, **shares), "examples")


def require_sound(examples: DataFrame, messages: DataFrame) -> None:
    made = labels.label_rows(messages, F.col("corpus"))
    for report in (labels.label_sanity(made, messages), dataset.split_sanity(examples, made)):
        code = report.first().error_code
        if code is not None:
            raise NotApproved(code)


@dataclass
class Evaluation:
    model: regression.TextRegression
    predictions: DataFrame
    errors: DataFrame
    spearman: DataFrame
    by_persona: DataFrame
    by_context: DataFrame
    gate: DataFrame
    validation: DataFrame


def evaluate(examples: DataFrame, alpha: float = 1.0, width: int = 1 << 18, tol: float = 1e-7) -> Evaluation:
    """Fit on the training split, measure on the validation and the test split."""
    train, validation, test = (examples.filter(F.col("split") == s) for s in ("train", "validation", "test"))
    model = regression.fit(train, alpha, width, tol)
    if metrics.non_finite(model.predict(train)).first().non_finite:
        raise NotApproved("TN_R14_NON_FINITE_PREDICTION")
    predictions = materialize(model.predict(test), "predictions")
    return Evaluation(
        model,
        predictions,
        metrics.errors(predictions),
        metrics.spearman(predictions),
        metrics.errors(predictions, ("persona",)),
        metrics.context_breakdown(predictions),
        metrics.quality_gate(predictions, metrics.mean_baseline(train, test)),
        metrics.errors(model.predict(validation)),
    )


def run(lines: DataFrame, skip_minimums: bool = False, **settings) -> Evaluation:
    """All steps; stops at a corpus that is rejected or a dataset that is not sound."""
    made = check_corpus(lines, skip_minimums)
    if made.status != "ok":
        raise NotApproved("status_not_ok")
    messages = made.checked.survivors
    examples = build_examples(messages)
    require_sound(examples, messages)
    return evaluate(examples, **settings)
