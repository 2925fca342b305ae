"""Three-class metrics from one grouped pass of conditional counts, and the steps from logits to labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ratio

CLASSES = (0, 1, 2)


def confusion(rows: DataFrame, truth: str, prediction: str, *by: str) -> DataFrame:
    """Counts c<truth><prediction> per group."""
    return rows.groupBy(*by).agg(*(F.count_if((F.col(truth) == t) & (F.col(prediction) == p)).alias(f"c{t}{p}") for t in CLASSES for p in CLASSES))


def counted(cells: DataFrame, truth: str, prediction: str, n: str, *by: str) -> DataFrame:
    """confusion() of rows that stand for n boundaries each."""
    return cells.groupBy(*by).agg(*(F.sum(F.when((F.col(truth) == t) & (F.col(prediction) == p), F.col(n)).otherwise(0)).alias(f"c{t}{p}") for t in CLASSES for p in CLASSES))


def _sum(*names: str) -> Column:
    return reduce(lambda a, b: a + b, map(F.col, names))


def accuracy() -> Column:
    return ratio(_sum("c00", "c11", "c22"), _sum(*(f"c{t}{p}" for t in CLASSES for p in CLASSES)))


def macro_f1() -> Column:
    """Mean F1 over the classes that truth holds; 0 where it holds none."""
    present, total = F.lit(0), F.lit(0.0)
    for k in CLASSES:
        truth, guessed = _sum(*(f"c{k}{p}" for p in CLASSES)), _sum(*(f"c{t}{k}" for t in CLASSES))
        present = present + (truth > 0).cast("int")
        total = total + F.when(truth > 0, ratio(2 * F.col(f"c{k}{k}"), truth + guessed)).otherwise(0.0)
    return ratio(total, present)


def blank_precision() -> Column:
    """Exact hits in the classes with a blank line over all guesses of one."""
    return ratio(_sum("c11", "c22"), _sum("c01", "c02", "c11", "c12", "c21", "c22"))


def blank_recall() -> Column:
    return ratio(_sum("c11", "c22"), _sum("c10", "c11", "c12", "c20", "c21", "c22"))


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    powers = F.transform(logits, lambda z: F.exp(z - top))
    return F.transform(powers, lambda e: e / F.aggregate(powers, F.lit(0.0), lambda a, x: a + x))


def argmax(logits: Column) -> Column:
    """Place of the first greatest value."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def cross_entropy(logits: Column, label: Column) -> Column:
    top = F.array_max(logits)
    return F.ln(F.aggregate(logits, F.lit(0.0), lambda a, z: a + F.exp(z - top))) + top - F.get(logits, label.cast("int"))


def gated(logits: Column, threshold: float, fallback: int) -> Column:
    """The greatest class, or the fallback (255 keeps a gap, 0 counts as none) where its probability is too low."""
    return F.when(F.array_max(softmax(logits)) < threshold, fallback).otherwise(argmax(logits))


_STATE = ("n", "hits", "blank_hits", "predicted", "wanted")


def state(truth: str, prediction: str) -> Column:
    """Counters of a group as one struct, an aggregate."""
    t, p = F.col(truth), F.col(prediction)
    parts = (F.count("*"), F.count_if(t == p), F.count_if((t > 0) & (t == p)), F.count_if(p > 0), F.count_if(t > 0))
    return F.struct(*(c.alias(name) for name, c in zip(_STATE, parts)))


def merged(states: DataFrame, column: str, *by: str) -> DataFrame:
    """States added up per group."""
    return states.groupBy(*by).agg(*(F.sum(f"{column}.{name}").alias(name) for name in _STATE))
