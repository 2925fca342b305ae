"""Scalar functions of feature channels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def flag(condition: Column) -> Column:
    return condition.cast("int").cast("double")


def bounded(value: Column, most: int) -> Column:
    return F.least(value, F.lit(most)) / float(most)


def logarithm(value: Column) -> Column:
    """log2 of one more than a length of at most 1024, over ten."""
    return F.log2(1 + F.least(value, F.lit(1024))) / 10


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where the whole is 0."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def markdown_escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\`*_\[\]<>|])", r"\\$1")


def under(path: Column, *folders: str) -> Column:
    """Whether a path is one of the folders or lies in one; "." holds every path."""
    hit = F.lit(False)
    for folder in folders:
        hit = hit | (F.lit(True) if folder == "." else (path == folder) | path.startswith(folder.rstrip("/") + "/"))
    return hit


def with_extension(path: Column, *extensions: str) -> Column:
    """Whether a path ends in one of the extensions, as they are spelt."""
    hit = F.lit(False)
    for extension in extensions:
        hit = hit | path.endswith(extension)
    return hit
