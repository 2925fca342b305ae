"""The fixed-width vector of a boundary: 192 channels of its two lines, their neighbours, roles and units.

Nothing in it depends on language, path, offsets or the gap itself, so changing gaps leaves it as it is.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from . import scanner, units

WIDTH = 192
#: Rows that a worker holds before it hands them on.
ROWS = 4000
_TOKEN = re.compile(r"\r\n|[\r\n]|[ \t\x0b\x0c]+|[0-9A-Za-z_\x80-\xff]+|[\s\S]")
_SPACE = re.compile(r"[ \t\x0b\x0c]+|\r?\n|\r")
# Start and multiplier of the 64-bit FNV-1a hash.
_START, _PRIME, _MASK = 14695981039346656037, 1099511628211, (1 << 64) - 1
_SIGNED = (1 << 33) - 1
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


@lru_cache(1 << 17)
def fnv1a(word: str) -> int:
    value = _START
    for byte in word.encode("latin-1").translate(_LOWER):
        value = ((value ^ byte) * _PRIME) & _MASK
    return value


@lru_cache(1 << 16)
def bag(value: str, size: int = 32) -> np.ndarray:
    """Signed counts of hashed tokens in the first 512 bytes, over the square root of their number."""
    tokens = [t for t in _TOKEN.findall(value[:512]) if not _SPACE.fullmatch(t)]
    hashes = np.fromiter(map(fnv1a, tokens), dtype=np.uint64, count=len(tokens))
    signs = 1.0 - 2.0 * ((hashes >> np.uint64(32)) & np.uint64(1)).astype(np.float64)
    return np.bincount((hashes % np.uint64(size)).astype(np.int64), weights=signs, minlength=size) / np.sqrt(max(len(tokens), 1))


class _Places(dict):
    """2 * bucket of a token's hash, one more where its sign is negative; forgets all when it is full."""

    def __missing__(self, token: str) -> int:
        if len(self) >= 1 << 15:
            self.clear()
        # the bits of fnv1a up to the sign's follow from those bits alone
        h = _START & _SIGNED
        for byte in token.encode("latin-1").translate(_LOWER):
            h = (h ^ byte) * (_PRIME & _SIGNED) & _SIGNED
        self[token] = at = 2 * (h % 32) + (h >> 32)
        return at


_SOLID = re.compile(r"[0-9A-Za-z_\x80-\xff]+|[^ \t\x0b\x0c\r\n]")
_PLACES = _Places()


def solid_tokens(values: list[str]) -> list[list[str]]:
    """Tokens but white space in the first 512 bytes of each text."""
    return [_SOLID.findall(v[:512]) for v in values]


def bags(values: list[str], tokens: list[list[str]] | None = None) -> np.ndarray:
    """bag() of several texts, a row each; tokens are solid_tokens() if they are known."""
    tokens = tokens or solid_tokens(values)
    sizes = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
    places = np.fromiter(map(_PLACES.__getitem__, chain.from_iterable(tokens)), dtype=np.int64, count=sizes.sum())
    counts = np.bincount(np.repeat(np.arange(len(values)) * 64, sizes) + places, minlength=len(values) * 64).reshape(-1, 32, 2)
    return (counts[:, :, 0] - counts[:, :, 1]) / np.sqrt(np.maximum(sizes, 1))[:, None]


# the first run of word characters that are not all digits to str.isdigit
_FIRST_WORD = re.compile(r"[0-9A-Za-z_\x80-\xff]*?[A-Za-z_\x80-\xb1\xb4-\xb8\xba-\xff][0-9A-Za-z_\x80-\xff]*")


_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_")


def first_word(value: str) -> str:
    m = _FIRST_WORD.search(value)
    return m.group() if m else ""


#: Channels and the property of a boundary's line that each pair shows, left line first. The channels' numbers.
_FIRST_PAIRS = {10: units.of_signs("})]")}
_LAST_PAIRS = {at: units.of_signs(signs) for at, signs in {12: "{:", 14: ";", 23: ",", 30: "}"}.items()}
_HELD_PAIRS = {19: "(", 21: "=", 28: ":"}
ALL = frozenset(range(WIDTH))


def vectors(text: str, channels: Iterable[int] = ALL) -> tuple[list[scanner.Boundary], np.ndarray]:
    """(boundaries, one vector each) of a text whose characters are bytes. Channels that are not asked for may be 0."""
    wanted = frozenset(channels)
    lines, _ = scanner.scan(text)
    nonblank, found = scanner.boundaries(lines)
    if not found or not wanted:
        return found, np.zeros((len(found), WIDTH), dtype=np.float32)
    return found, _filled(units.Columns([lines[k] for k in nonblank]), np.array([b.before for b in found], dtype=np.int64), wanted)


def gaps_and_vectors(text: str, channels: Iterable[int] = ALL) -> tuple[np.ndarray, np.ndarray]:
    """(blank lines, vectors) of vectors()' boundaries without their other fields, which is faster."""
    wanted = frozenset(channels)
    of, before, gaps = scanner.columns(text)
    if not len(before) or not wanted:
        return gaps, np.zeros((len(before), WIDTH), dtype=np.float32)
    return gaps, _filled(units.Columns(of=of), before, wanted)


def _filled(c: units.Columns, before: np.ndarray, wanted: frozenset[int]) -> np.ndarray:
    """The vectors of boundaries, told by the line before each."""
    after, values = before + 1, c.values
    out = np.zeros((len(before), WIDTH), dtype=np.float32)
    # each line's property once, then picked for both sides of all boundaries
    indent = c.indent.astype(np.float64)
    out[:, 0] = 1
    out[:, 1], out[:, 2] = (np.minimum(indent[side], 32) / 32 for side in (before, after))
    out[:, 3] = np.clip((indent[after] - indent[before]) / 16, -1, 1)
    out[:, 4], out[:, 25], out[:, 26] = indent[before] == indent[after], indent[before] == 0, indent[after] == 0
    pairs = {8: np.log2(1 + np.minimum(np.fromiter(map(len, values), dtype=np.int64, count=c.size), 1024)) / 10}
    pairs |= {at: show[c.first] for at, show in _FIRST_PAIRS.items()} | {at: show[c.last] for at, show in _LAST_PAIRS.items()}
    pairs |= {at: np.array([sign in v for v in values]) for at, sign in _HELD_PAIRS.items()}
    for at, column in pairs.items():
        out[:, at], out[:, at + 1] = column[before], column[after]
    out[:, 5:8] = np.clip(c.depths[before] / 8, -1, 1)
    out[:, 16], out[:, 17] = c.comment[before], c.comment[after]
    attribute = (c.first == ord("@")) & (c.last != ord(";"))
    for k in np.flatnonzero(c.first == ord("#")).tolist():
        attribute[k] = values[k].startswith("#[")
    out[:, 27] = attribute[after]
    tokens = solid_tokens(values) if wanted & {18, *range(32, 128)} else []
    if wanted & {18, *range(96, 128)}:
        # a token that begins with a letter is a word; the rest is looked at
        names = [t[0] if len(v) <= 512 and t and t[0][0] in _LETTERS else first_word(v) for v, t in zip(values, tokens)]
        out[:, 18] = [names[a] == names[b] for a, b in zip(before.tolist(), after.tolist())]
        buckets = np.fromiter(map(_PLACES.__getitem__, names), dtype=np.int64, count=len(names)) // 2 % 16
        rows = np.arange(len(before))
        for d in (1, 2, 3):
            for base, at in ((96, before - d), (112, after + d)):
                there = (at >= 0) & (at < c.size)
                out[rows[there], base + buckets[at[there]]] += np.float32(1 / d)
    if wanted & set(range(32, 96)):
        each = bags(values, tokens)
        out[:, 32:64], out[:, 64:96] = each[before], each[after]
    if wanted & set(range(128, 144)):
        role = c.role_numbers
        out[np.arange(len(before)), 128 + role[before]] = 1
        out[np.arange(len(before)), 136 + role[after]] = 1
    if wanted & set(range(144, 187)):
        units.structural_channels(c, before, out, wanted)
    out[:, 187:] = 0
    return out


_LINES = "doc_id long, line_no int, start int, end int, after int, indent int, blank boolean, protected boolean, protected_before boolean, protected_after boolean, comment boolean, continued boolean, braces int, parentheses int, brackets int"


def scanned_lines(documents: DataFrame) -> DataFrame:
    """Every line of every document with its lexical flags. A document is scanned whole, in one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _LINES.split(", ")]
        for pdf in batches:
            rows: list[tuple] = []
            for key, text in zip(pdf["doc_id"], pdf["text"]):
                rows += [(key, n, *line[:-1]) for n, line in enumerate(scanner.scan(scanner.as_bytes(text))[0])]
                if len(rows) > ROWS:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)

    return documents.select("doc_id", "text").where("text IS NOT NULL").mapInPandas(run, _LINES)


def boundary_vectors(documents: DataFrame, channels: Iterable[int] = ALL) -> DataFrame:
    """doc_id, boundary_id, blank_lines, crlf, before, after, input (192 floats) of every boundary that may change.

    Only the channels asked for are worked out. A null text has no boundary.
    """
    schema = "doc_id long, boundary_id int, blank_lines int, crlf boolean, before int, after int, input array<float>"
    wanted = frozenset(channels)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["doc_id", "boundary_id", "blank_lines", "crlf", "before", "after", "input"]
        for pdf in batches:
            rows: list[tuple] = []
            for key, text in zip(pdf["doc_id"], pdf["text"]):
                found, x = vectors(scanner.as_bytes(text), wanted)
                rows += [(key, n, b.blank_lines, b.crlf, b.before, b.after, v) for n, (b, v) in enumerate(zip(found, x))]
                if len(rows) > ROWS:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)

    return documents.select("doc_id", "text").where("text IS NOT NULL").mapInPandas(run, schema)


def picked_vectors(documents: DataFrame, picked: dict[int, list[int]]) -> DataFrame:
    """doc_id, boundary_id, input of the boundaries picked by file; picked travels with the function."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                if key in picked:
                    x = gaps_and_vectors(scanner.as_bytes(text.as_py()))[1][picked[key]]
                    columns = [pa.array([key] * len(x), pa.int64()), pa.array(picked[key], pa.int32()), pa.array(list(x), pa.list_(pa.float32()))]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "boundary_id", "input"])

    return documents.select("doc_id", "text").where("text IS NOT NULL").mapInArrow(run, "doc_id long, boundary_id int, input array<float>")


def boundary_labels(documents: DataFrame, *keep: str) -> DataFrame:
    """doc_id, boundary_id, blank_lines and the integer columns to keep of every boundary that may change, by the scanner alone."""
    names = ["doc_id", "boundary_id", "blank_lines", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gaps = [scanner.columns(scanner.as_bytes(t.as_py()))[2] for t in batch.column("text")]
            of = pa.array(np.repeat(np.arange(len(gaps)), [len(g) for g in gaps]))
            own = [pa.array([n for g in gaps for n in range(len(g))], pa.int32()), pa.array([x for g in gaps for x in g], pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(of), *own, *(batch.column(k).take(of) for k in keep)], names)

    schema = ", ".join(["doc_id long", "boundary_id int", "blank_lines int", *(f"{k} int" for k in keep)])
    return documents.select("doc_id", "text", *keep).where("text IS NOT NULL").mapInArrow(run, schema)


def eligible_counts(documents: DataFrame) -> DataFrame:
    """doc_id, boundaries, with_gap of every document that has a boundary that may change, by the scanner alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = (batch.column(k).to_pylist() for k in range(2))
            gaps = [[b.blank_lines for b in scanner.boundaries(scanner.scan(scanner.as_bytes(t))[0])[1]] for t in texts]
            some = [k for k, g in enumerate(gaps) if g]
            columns = ([keys[k] for k in some], [len(gaps[k]) for k in some], [sum(x > 0 for x in gaps[k]) for k in some])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "boundaries", "with_gap"])

    return documents.select("doc_id", "text").where("text IS NOT NULL").mapInArrow(run, "doc_id long, boundaries long, with_gap long")
