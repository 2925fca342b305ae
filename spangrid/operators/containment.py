"""Which of a set of stated texts are held by the rows of a table, white space aside: one pass over the rows a block.

The stated texts go to every task in blocks of a fixed size, so nothing is joined row by row and nothing grows with the
table; all texts of a block are looked for at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

try:
    import ahocorasick
except ImportError:
    ahocorasick = None

#: Bytes of stated texts that a task holds at once.
BLOCK_BYTES = 32 << 20
_WHITE = r"[ \t\r\n\x0B\f]"


def compact(text: str):
    """The text without white space."""
    return F.regexp_replace(text, _WHITE, "")


def _finder(patterns: list[str]):
    """A function from a text to the numbers of the patterns that it holds."""
    if ahocorasick is None:
        return lambda text: {n for n, p in enumerate(patterns) if p in text}
    automaton = ahocorasick.Automaton()
    numbers: dict[str, list[int]] = {}
    for n, p in enumerate(patterns):
        numbers.setdefault(p, []).append(n)
    for p, held in numbers.items():
        automaton.add_word(p, held)
    automaton.make_automaton()
    return lambda text: {n for _, held in automaton.iter(text) for n in held}


def _search(keys: list[int], patterns: list[str], inside: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _finder(patterns) if patterns and not inside else None
        for batch in batches:
            rows, cases = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text or not patterns:
                    continue
                hits = [n for n, p in enumerate(patterns) if text in p] if inside else find(text)
                rows += [key] * len(hits)
                cases += [keys[n] for n in hits]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(cases, pa.int64())], ["row_id", "case_id"])

    return run


def containments(rows: DataFrame, stated: DataFrame, inside: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(row_id, case_id): rows whose compact text holds a stated one, or with `inside` lies within it.

    rows and stated have an id and a text, in this order. Null and blank texts hold nothing and are held by none.
    """
    (case, said), (key, text) = stated.columns[:2], rows.columns[:2]
    given = stated.select(F.col(case).cast("long").alias("case_id"), compact(said).alias("p")).where("p <> ''").distinct()
    total = given.agg(F.sum(F.octet_length("p"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    table = rows.select(F.col(key).cast("long").alias("row_id"), compact(text).alias("t")).where("t <> ''")
    out = None
    for n in range(blocks):
        block = given.where(F.pmod(F.xxhash64("case_id"), F.lit(blocks)) == n).collect()
        found = table.mapInArrow(_search([r.case_id for r in block], [r.p for r in block], inside), "row_id long, case_id long")
        out = found if out is None else out.unionByName(found)
    return out.distinct()
