"""What must hold for any text whatever gaps are set, and counts over a text's regions; each for a whole text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame

from . import features, scanner, trees
from .formatting import values


def per_text(text: Column | str, kind: str, one: Callable[[str], object]) -> Column:
    """one(text) for each text of a column, in Arrow batches; kind is boolean, int, long or string."""
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([one(t) for t in texts], dtype={"boolean": "bool", "int": "int32", "long": "int64"}.get(kind, "object"))

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return pandas_udf(run, kind)(text)


def tags(text: str) -> int:
    """Complete tags of a text, each looked for after the end of the one before."""
    n, at = 0, text.find("<")
    while at >= 0:
        end = scanner.tag_end(text, at)
        n += end > 0
        at = text.find("<", end if end > 0 else at + 1)
    return n


def vectors_move(text: str) -> bool:
    """Whether the vectors change when every gap is set to 2."""
    data = scanner.as_bytes(text)
    found, before = features.vectors(data)
    again, after = features.vectors(scanner.render(data, found, [2] * len(found)))
    return len(found) != len(again) or bool((before != after).any())


def lines_differ(text: str) -> bool:
    """Whether a nonblank line changes when every gap is set to 0, 1 or 2."""
    data = scanner.as_bytes(text)
    found = scanner.boundaries(scanner.scan(data)[0])[1]
    return any(values(scanner.as_text(scanner.render(data, found, [k] * len(found)))) != values(text) for k in (0, 1, 2))


def on_bytes(one: Callable[[str], object]) -> Callable[[str], object]:
    """The same function for texts that are not bytes as characters."""
    return lambda text: one(scanner.as_bytes(text))


def _rows(documents: DataFrame, columns: list[str], names: list[str], one: Callable[..., list[tuple]]) -> DataFrame:
    """doc_id and one(columns) of every document, a row for each tuple."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(key, *row) for key, *given in zip(*(c.to_pylist() for c in batch.columns)) for row in one(*given)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(len(names) + 1)], ["doc_id", *names])

    return documents.select("doc_id", *columns).mapInArrow(run, ", ".join(f"{n} long" for n in ("doc_id", *names)))


def statement_pairs(documents: DataFrame) -> DataFrame:
    """doc_id, left_first, left_last, right_first, right_last of neighbouring statements, by nonblank line."""

    def one(text: str) -> list[tuple]:
        return trees.statements([x for x in scanner.scan(scanner.as_bytes(text))[0] if not x.blank])

    return _rows(documents, ["text"], list(trees.Pair._fields), one)


def regions_of_tests(documents: DataFrame) -> DataFrame:
    """doc_id, start, end: byte ranges of declarations of tests. documents has ext."""

    def one(text: str, ext: str) -> list[tuple]:
        return trees.excluded([x for x in scanner.scan(scanner.as_bytes(text))[0] if not x.blank], ext)

    return _rows(documents, ["text", "ext"], ["start", "end"], one)
