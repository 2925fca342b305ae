"""Cutting oversized items at natural boundaries.

Dynamic programming over the boundary positions of an item finds the cuts with the least sum of cut penalties and size
imbalance under which no piece is longer than the limit and neighbours share the overlap asked for.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .arrow import slices

#: Penalty of a cut by the kind of place.
PENALTY = {"function": 0.0, "block": 0.3, "statement": 0.6, "line": 1.0, "space": 4.0, "character": 8.0}
KINDS = list(PENALTY)
#: Weight of the squared deviation from the mean piece size.
BALANCE = 1.5

_LINE_END = re.compile(rb"\n|\r(?!\n)")
_SCOPE_END = re.compile(rb"\s*(?:\}[;,)]*|end)\s*")
_STATEMENT_END = re.compile(rb".*[;})\]]\s*|\s*")


#: In a long line: strings, which hold no boundary, and the ends of blocks and statements.
_INNER = re.compile(rb"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`[^`\n]*`|(?P<block>\}[;,)]*)|(?P<statement>;)")


def _inside(data: bytes, first: int, end: int, reach: int) -> list[tuple[int, int]]:
    """Places inside a long line: after blocks and statements, and where those are further apart than `reach`, after
    white space and at any character."""
    natural = [(m.end(), KINDS.index(m.lastgroup)) for m in _INNER.finditer(data, first, end) if m.lastgroup and m.end() < end]
    out, last, step = [], first, max(1, reach // 8)
    for stop, kind in [*natural, (end, -1)]:
        if stop - last > reach:
            for a in range(last + step, stop, step):
                # an UTF-8 continuation byte can't begin a piece
                while a < stop and data[a] & 0xC0 == 0x80:
                    a += 1
                space = max(data.rfind(b" ", a - step, a), data.rfind(b",", a - step, a)) + 1
                if space > last and (not out or space > out[-1][0]):
                    out.append((space, KINDS.index("space")))
                if a < stop and (not out or a > out[-1][0]):
                    out.append((a, KINDS.index("character")))
        if kind >= 0:
            out.append((stop, kind))
        last = stop
    return out


def boundaries(data: bytes, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a piece may end, ascending, and the kind of each; the end of the data is the last.

    Line ends are natural, and so are the ends of blocks and statements within a line longer than `reach`. Where those
    are further apart than `reach` still, places after white space and any character boundary come in, so a cut always
    exists.
    """
    at, kind, last = [], [], 0
    ends = [m.end() for m in _LINE_END.finditer(data)]
    if not ends or ends[-1] != len(data):
        ends.append(len(data))
    for n, end in enumerate(ends):
        line = data[last:end]
        if end - last > reach:
            inner = _inside(data, last, end, reach)
            at += [a for a, _ in inner]
            kind += [k for _, k in inner]
        following = data[end : ends[n + 1]] if n + 1 < len(ends) else b""
        blank_next = not following.strip()
        if _SCOPE_END.fullmatch(line):
            name = "function" if line[:1] not in b" \t" or blank_next else "block"
        elif not line.strip():
            name = "function" if following[:1] not in (b" ", b"\t", b"", b"\n", b"\r") else "statement"
        elif _STATEMENT_END.fullmatch(line.rstrip(b"\r\n")) or blank_next:
            name = "statement"
        else:
            name = "line"
        if end > 0:
            at.append(end)
            kind.append(KINDS.index(name))
        last = end
    return np.array(at, dtype=np.int64), np.array(kind, dtype=np.int64)


def _back(data: bytes, at: int) -> int:
    """The character boundary at or before a byte position."""
    while at > 0 and at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def split(data: bytes, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """(start, end, kind of the place where it ends) of each piece; one piece where the data fits.

    Each piece starts `overlap` bytes before the end of the one before it, or up to three bytes earlier where that
    would break a character. Every piece must be able to add a character, so a limit of less than four bytes, or of less
    than seven over the overlap, is an error.
    """
    overlap = max(0, overlap)
    if limit < (overlap + 7 if overlap else 4):
        raise ValueError(f"pieces of {limit} bytes cannot overlap by {overlap} and go on")
    if len(data) <= limit:
        return [(0, len(data), "end")]
    # two places next to each other must fit into a piece beside the overlap
    at, kind = boundaries(data, max(1, min(limit // 4, (limit - overlap - 6) // 2)))
    starts = np.array([0] + [_back(data, max(0, int(p) - overlap)) for p in at], dtype=np.int64)
    ends = np.concatenate(([0], at))
    n = len(ends)
    pieces = -(-(len(data) - overlap) // (limit - overlap))
    mean = (len(data) + (pieces - 1) * overlap) / pieces
    penalty = np.concatenate(([0.0], np.array([PENALTY[k] for k in KINDS])[kind]))
    penalty[-1] = 0.0
    cost, back = np.full(n, np.inf), np.zeros(n, dtype=np.int64)
    cost[0] = 0.0
    low = 0
    for j in range(1, n):
        while ends[j] - starts[low] > limit:
            low += 1
        length = ends[j] - starts[low:j]
        # each piece costs something, so that no more are made than needed
        total = cost[low:j] + BALANCE * ((length - mean) / limit) ** 2 + 1.0
        if len(total):
            best = int(np.argmin(total))
            cost[j], back[j] = total[best] + penalty[j], low + best
    if not np.isfinite(cost[-1]):
        raise AssertionError("no cut was found")
    out, j = [], n - 1
    while j > 0:
        i = int(back[j])
        out.append((int(starts[i]), int(ends[j]), KINDS[kind[j - 1]] if j < n - 1 else "end"))
        j = i
    return out[::-1]


_SCHEMA = "{key} {kind}, piece int, start_byte long, end_byte long, n_bytes int, cut string, text string"


def _cut(key: str, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            rows = []
            for k, text, limit, overlap in zip(*(batch.column(c).to_pylist() for c in range(4))):
                data = text.encode()
                for n, (a, b, cut) in enumerate(split(data, limit, overlap)):
                    rows.append((k, n, a, b, b - a, cut, data[a:b].decode()))
            types = (kind, pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string())
            names = (key, "piece", "start_byte", "end_byte", "n_bytes", "cut", "text")
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(types)], list(names))

    return run


def oversized_pieces(files: DataFrame, limits: DataFrame, key: str = "file_id", text: str = "content", group: str = "lang", default: str = "default") -> DataFrame:
    """Pieces of every item over the limit of its group: key, piece (0-based), start_byte, end_byte, n_bytes, cut, text.

    A null group, or one that limits doesn't list, has the limit of the row `default`; without such a row it has none.
    Null texts and texts within the limit have no piece. An item delivered twice is cut once. limits is a table of
    settings, one row per group; of repeated groups the smallest limit and the largest overlap hold.
    """
    rows = limits.groupBy("lang").agg(F.min("max_bytes").alias("max_bytes"), F.max("overlap_bytes").alias("overlap_bytes"))
    own = F.broadcast(rows.where(F.col("lang").isNotNull()).withColumnsRenamed({"lang": "g", "max_bytes": "m", "overlap_bytes": "o"}))
    rest = F.broadcast(rows.where(F.col("lang") == default).select(F.col("max_bytes").alias("dm"), F.col("overlap_bytes").alias("do")))
    listed = files.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(group).alias("l")).join(own, F.col("l") == F.col("g"), "left").join(rest, F.lit(True), "left")
    over = listed.select("k", "t", F.coalesce("m", "dm").alias("limit"), F.coalesce("o", "do", F.lit(0)).alias("overlap")).where(F.octet_length("t") > F.col("limit"))
    kind = files.schema[key].dataType
    return over.dropDuplicates(["k"]).mapInArrow(_cut(key, to_arrow_type(kind)), _SCHEMA.format(key=key, kind=kind.simpleString()))
