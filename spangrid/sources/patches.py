"""Paths that an edit patch changes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LINE = r"^\*\*\* (Add File|Update File|Move to): (.*)$"


def changed_paths(patch: Column) -> Column:
    """Array of the files added or updated by a patch, in order; a move renames the file named before it, the last of
    several moves counts, and one that stands first names none."""
    hits = F.filter(F.transform(F.split(patch, "\n", -1), lambda x: F.struct(F.regexp_extract(x, _LINE, 1).alias("op"), F.regexp_extract(x, _LINE, 2).alias("path"))), lambda h: h["op"] != "")
    renamed = lambda done, h: F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array_repeat(h["path"], F.least(F.size(done), F.lit(1))))
    return F.aggregate(hits, F.array().cast("array<string>"), lambda done, h: F.when(h["op"] == "Move to", renamed(done, h)).otherwise(F.concat(done, F.array(h["path"]))))
