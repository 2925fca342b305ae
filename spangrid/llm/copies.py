"""Classes of records with the same text, so that copies are worked on once and expanded at the end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text_class(text: str = "content") -> Column:
    """64-bit class of a text."""
    return F.xxhash64(F.col(text))


def members(records: DataFrame, key: str, text: str = "content") -> DataFrame:
    """(cls, key): which record holds which text. A record delivered twice counts once."""
    return records.select(text_class(text).alias("cls"), F.col(key)).distinct()


def texts_of(records: DataFrame, wanted: DataFrame, text: str = "content") -> DataFrame:
    """(cls, text) of the wanted classes, each text once.

    Should two texts fall into one class, both come out, so a later exact check sees either.
    """
    found = records.select(text_class(text).alias("cls"), F.col(text).alias("text")).join(wanted, "cls", "left_semi")
    return found.groupBy("cls", F.md5("text").alias("digest")).agg(F.first("text").alias("text")).select("cls", "text")
