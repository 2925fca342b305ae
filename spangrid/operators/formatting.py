"""Formatting whole documents: boundaries, a decision for each, rendering, and the contract that only gaps change."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import features, scanner

KEEP = 255


def rule_labels(x: np.ndarray) -> np.ndarray:
    """The deterministic baseline over feature vectors: 0 or 1."""
    out = np.zeros(len(x), dtype=int)
    if not len(x):
        return out
    closes = (x[:, 11] == 1) | (x[:, 12] == 1)
    late = [(x[:, 17] == 1, 1), (x[:, 18] == 1, 0), ((x[:, 30] == 1) & (x[:, 4] == 1), 1), ((x[:, 26] == 1) & (x[:, 1] > 0), 1)]
    open_ = ~closes
    for condition, label in late:
        out[open_ & condition] = label
        open_ &= ~condition
    return out


def valid_confidence(value):
    """Whether a confidence (a number or a column) is finite and from 0 to 1."""
    return (value >= 0) & (value <= 1)


class Session:
    """One text formatted step by step: vectors go out in batches from a cursor, probabilities come back in order.

    A text with a bare CR and a confidence out of range are errors. A file with an open region at its end has no boundary.
    Where no class reaches the confidence the gap stays.
    """

    def __init__(self, text: str, confidence: float = 0.0):
        if not valid_confidence(confidence):
            raise ValueError("the confidence must be from 0 to 1")
        self.data = scanner.as_bytes(text)
        if "\r" in self.data.replace("\r\n", ""):
            raise ValueError("a CR without LF")
        self.confidence, self.sent, self.abstained = confidence, 0, 0
        open_ = scanner.scan(self.data)[1]
        self.found, self.vectors = features.vectors("" if open_ else self.data)
        self.labels: list[int] = []

    def encode(self, capacity: int) -> np.ndarray:
        """The next vectors, at most `capacity`; none at the end. What was sent must be answered first."""
        if len(self.labels) != self.sent:
            raise RuntimeError("the batch before is not answered")
        batch = self.vectors[self.sent : self.sent + capacity]
        self.sent += len(batch)
        return batch

    def accept(self, probabilities: np.ndarray) -> None:
        """Probabilities of the vectors sent last, one row each."""
        if len(probabilities) != self.sent - len(self.labels) or not np.isfinite(probabilities).all():
            raise ValueError("one finite row of probabilities is due for each vector sent")
        for p in probabilities:
            sure = p.max() >= self.confidence
            self.abstained += not sure
            self.labels.append(int(p.argmax()) if sure else KEEP)

    def finish(self) -> tuple[str, int, int, int]:
        """(text, changes, candidates, abstained); all vectors must have been answered."""
        if len(self.labels) != len(self.found):
            raise RuntimeError("boundaries are left")
        changes = sum(label not in (KEEP, b.blank_lines) for b, label in zip(self.found, self.labels))
        return scanner.as_text(scanner.render(self.data, self.found, self.labels)), changes, len(self.found), self.abstained


def format_in_sessions(documents: DataFrame, decide: Callable[[np.ndarray], np.ndarray] | None = None, confidence: float = 0.0, batch: int = 256) -> DataFrame:
    """doc_id, text, changes, candidates, abstained of every document, null where a session refuses it.

    decide gives probabilities of vectors; by default the rule's label has all of it.
    """
    schema = "doc_id long, text string, changes int, candidates int, abstained int"
    decide = decide or (lambda x: np.eye(3)[rule_labels(x)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, text in zip(pdf["doc_id"], pdf["text"]):
                try:
                    session = Session(text, confidence)
                except ValueError:
                    rows.append((key, None, None, None, None))
                    continue
                while len(x := session.encode(batch)):
                    session.accept(decide(x))
                rows.append((key, *session.finish()))
            frame = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])
            yield frame.astype({c: "Int32" for c in ("changes", "candidates", "abstained")})

    return documents.select("doc_id", "text").where("text IS NOT NULL").mapInPandas(run, schema)


def format_text(text: str, decide: Callable[[np.ndarray], np.ndarray] = rule_labels) -> tuple[str, int, int]:
    """(text, changes, candidates). A file with an open region at its end is given back as it came."""
    data = scanner.as_bytes(text)
    lines, unterminated = scanner.scan(data)
    if unterminated:
        return text, 0, 0
    found, x = features.vectors(data)
    labels = [int(v) for v in decide(x)]
    out = scanner.as_text(scanner.render(data, found, labels))
    if values(out) != values(text):
        raise AssertionError("a nonblank line changed")
    return out, sum(label not in (KEEP, b.blank_lines) for b, label in zip(found, labels)), len(found)


def values(text: str) -> list[str]:
    return [v for v in (line.strip(" \t\r") for line in text.split("\n")) if v]


def format_documents(documents: DataFrame, decide: Callable[[np.ndarray], np.ndarray] = rule_labels) -> DataFrame:
    """doc_id, text, changes, candidates, preserved, idempotent of every document; null texts are left out."""
    schema = "doc_id long, text string, changes int, candidates int, preserved boolean, idempotent boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, text in zip(pdf["doc_id"], pdf["text"]):
                out, changes, candidates = format_text(text, decide)
                rows.append((key, out, changes, candidates, values(out) == values(text), format_text(out, decide)[0] == out))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return documents.select("doc_id", "text").where("text IS NOT NULL").mapInPandas(run, schema)
