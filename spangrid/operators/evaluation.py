"""Evaluation of layouts against expected texts, with the deterministic rule over plain text as the engine.

A text is rendered, measured and rendered again as array expressions on its own row; nothing is exploded before counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import layout

# Extensions of the languages that training leaves out.
UNSEEN = ("go", "cpp", "cs", "rb", "kt", "swift")


def formatted(documents: DataFrame, text: str, out: str, decide: Callable[[Column, Column], Column]) -> DataFrame:
    """Adds `out`: the text with decide(left line, right line) blank lines at every boundary.

    What stands before the first and after the last nonblank line stays; a text without nonblank lines stays whole.
    """
    held = F.col(text)
    d = documents.withColumn("nb", F.filter(layout.line_structs(text), lambda x: ~x["blank"]))
    steps = F.when(F.size("nb") > 1, F.sequence(F.lit(0), F.size("nb") - 2)).otherwise(F.array().cast("array<int>"))
    d = d.withColumn("labels", F.transform(steps, lambda i: decide(F.get("nb", i), F.get("nb", i + 1))))
    head, tail = F.regexp_extract(held, r"^((?:[ \t\r]*\n)*)", 1), F.regexp_extract(held, r"(\r?\n[ \t\r\n]*)\z", 1)
    whole = F.concat(head, layout.rendered("labels[i]"), tail)
    return d.withColumn(out, F.when(F.size("nb") > 0, whole).otherwise(held)).drop("nb", "labels")


def shape_of(text: str) -> Column:
    """(value, gap after it) of every nonblank line; the last gap is null."""
    spots = F.filter(layout.line_structs(text), lambda x: ~x["blank"])
    after = F.slice(spots, F.lit(2), F.greatest(F.size(spots) - 1, F.lit(0)))
    return F.zip_with(spots, after, lambda x, y: F.struct(x["value"].alias("value"), (y["line_no"] - x["line_no"] - 1).alias("gap"), x["line_no"].alias("line_no")))


def regression(cases: DataFrame, actual: str, repeated: str, source: str, expected: str, *keep: str) -> DataFrame:
    """keep, exact_output, nonblank_preserved, idempotent, gaps_total, gaps_correct of every case."""
    d = cases.withColumn("e", shape_of(expected)).withColumn("a", shape_of(actual)).withColumn("s", shape_of(source))
    values = lambda c: F.transform(c, lambda x: x["value"])
    same = F.zip_with("e", "a", lambda e, a: (e["gap"] == a["gap"]) & e["gap"].isNotNull())
    return d.select(
        *keep, (F.col(actual) == F.col(expected)).alias("exact_output"), (values(F.col("a")) == values(F.col("s"))).alias("nonblank_preserved"), (F.col(repeated) == F.col(actual)).alias("idempotent"),
        F.greatest(F.size("e") - 1, F.lit(0)).alias("gaps_total"), F.size(F.filter(same, lambda x: x)).alias("gaps_correct"),
    )


def regression_sums(measured: DataFrame, *by: str) -> DataFrame:
    """Cases and the sums of what `regression` measures, per group."""
    flags = [F.count_if(c).alias(c) for c in ("exact_output", "nonblank_preserved", "idempotent")]
    return measured.groupBy(*by).agg(F.count("*").alias("cases"), *flags, F.sum("gaps_total").alias("gaps_total"), F.sum("gaps_correct").alias("gaps_correct"))


def regression_gate(sums: DataFrame, model_digest: str, report_digest: str, confidence: float, report_confidence: float) -> DataFrame:
    """Adds passed: every case exact, preserved and idempotent, and the report is of this model at this confidence."""
    of_model = F.lit(model_digest == report_digest and confidence == report_confidence)
    whole = (F.col("cases") > 0) & (F.col("exact_output") == F.col("cases")) & (F.col("nonblank_preserved") == F.col("cases")) & (F.col("idempotent") == F.col("cases"))
    return sums.withColumn("passed", of_model & whole)


def assertions(cases: DataFrame, actual: str, source: str, expected: str, *keep: str) -> DataFrame:
    """keep, after_line (1-based, in the source), expected, actual, passed of every boundary of the expected text."""
    d = cases.withColumn("s", shape_of(source)).withColumn("e", shape_of(expected)).withColumn("a", shape_of(actual))
    rows = d.select(*keep, F.explode(F.arrays_zip("s", "e", "a")).alias("z")).where("z.e.gap IS NOT NULL AND z.s IS NOT NULL")
    return rows.select(*keep, (F.col("z.s.line_no") + 1).alias("after_line"), F.col("z.e.gap").alias("expected"), F.col("z.a.gap").alias("actual"), F.coalesce(F.col("z.e.gap") == F.col("z.a.gap"), F.lit(False)).alias("passed"))


def style_counts(rows: DataFrame, *by: str) -> DataFrame:
    """Assertions, those met, and both for required gaps and required continuity, per group."""
    need = F.col("expected") > 0
    return rows.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.count_if(need).alias("required_gaps"), F.count_if(need & F.col("passed")).alias("correct_gaps"),
        F.count_if(~need).alias("required_continuity"), F.count_if(~need & (F.col("actual") == 0)).alias("correct_continuity"),
    )


def early_stop(scores: DataFrame, run: str, epoch: str, score: str, gain: float = 1e-4, patience: int = 5) -> DataFrame:
    """run, best_epoch, best_score, stopped_at: a run ends when `patience` epochs in a row gain no more than `gain`.

    A run's epochs are folded in order; it has as many as it was trained for.
    """
    steps = F.array_sort(F.collect_list(F.struct(F.col(epoch).alias("at"), F.col(score).cast("double").alias("score"))))
    start = F.struct(F.lit(None).cast("long").alias("best"), F.lit(float("-inf")).alias("top"), F.lit(0).alias("waited"), F.lit(None).cast("long").alias("last"))

    def step(s: Column, x: Column) -> Column:
        better = x["score"] > s["top"] + gain
        moved = F.struct(
            F.when(better, x["at"]).otherwise(s["best"]).cast("long").alias("best"), F.when(better, x["score"]).otherwise(s["top"]).alias("top"),
            F.when(better, 0).otherwise(s["waited"] + 1).cast("int").alias("waited"), x["at"].cast("long").alias("last"),
        )
        return F.when(s["waited"] >= patience, s).otherwise(moved)

    folded = scores.groupBy(run).agg(steps.alias("steps")).select(run, F.aggregate("steps", start, step).alias("s"))
    return folded.select(run, F.col("s.best").alias("best_epoch"), F.col("s.top").alias("best_score"), F.col("s.last").alias("stopped_at"))
