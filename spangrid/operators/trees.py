"""Structure by delimiters where no parser of a language is at hand: statements, regions of tests, and a fingerprint that
changes when a literal or the nesting does."""

from __future__ import annotations

import hashlib
import re
from typing import NamedTuple

from . import scanner, units

# How a declaration of tests begins, by extension.
_TESTS = {"rs": re.compile(r"#\[(?:cfg\(test\)|test)\]"), "zig": re.compile(r"test\b")}
_TOKEN = re.compile(r"[0-9A-Za-z_\x80-\xff]+|[^\s]")


class Pair(NamedTuple):
    """Two statements that stand next to each other at one level."""

    left_first: int
    left_last: int
    right_first: int
    right_last: int


def statements(lines: list[scanner.Line]) -> list[Pair]:
    """Neighbouring statements by position among the nonblank lines: a unit and the unit that begins after it and its
    comments, at the same indentation and outside any open delimiter."""
    if not lines:
        return []
    columns = units.Columns(lines)
    starting, _ = units.units(lines, columns)
    inside = units.interiors(lines, columns)
    out = []
    for unit in starting.values():
        after = units.after_comments(columns, unit.last + 1) if unit.last + 1 < len(lines) else len(lines)
        other = starting.get(after)
        if other and not inside[unit.first] and columns.indent[unit.first] == columns.indent[after]:
            out.append(Pair(unit.first, unit.last, other.first, other.last))
    return out


def excluded(lines: list[scanner.Line], ext: str) -> list[tuple[int, int]]:
    """Byte ranges [start, end) of declarations of tests, from their mark to the end of the braces that follow."""
    mark, out, k = _TESTS.get(ext), [], 0
    while mark and k < len(lines):
        line = lines[k]
        if line.protected_before or not mark.match(line.value):
            k += 1
            continue
        base = lines[k - 1].braces if k else 0
        end = k
        # the opening brace may stand some lines below the mark
        while end < len(lines) - 1 and lines[end].braces <= base and not (lines[end].value.endswith(";") and end > k):
            end += 1
        while end < len(lines) - 1 and lines[end].braces > base:
            end += 1
        out.append((line.start, lines[end].after))
        k = end + 1
    return out


def fingerprint(text: str) -> str | None:
    """SHA-256 over the tokens of code with the nesting around them and over the bytes of regions; None where a region
    or a delimiter stays open. Texts are bytes as characters."""
    lines, still_open = scanner.scan(text)
    if still_open or lines and (lines[-1].braces or lines[-1].parentheses or lines[-1].brackets):
        return None
    digest = hashlib.sha256()
    for line in lines:
        if line.protected:
            digest.update(b"R" + text[line.start : line.end].encode("latin-1") + b"\n")
        elif not line.blank:
            digest.update(f"L{line.braces},{line.parentheses},{line.brackets}:".encode())
            digest.update("\0".join(_TOKEN.findall(line.value)).encode("latin-1"))
    return digest.hexdigest()


def safe(text: str) -> str:
    """ok, open (no fingerprint), unsafe (none after new gaps) or changed (another one after gaps of 0 or 2)."""
    first = fingerprint(text)
    if first is None:
        return "open"
    found = scanner.boundaries(scanner.scan(text)[0])[1]
    for gap in (0, 2):
        again = fingerprint(scanner.render(text, found, [gap] * len(found)))
        if again != first:
            return "unsafe" if again is None else "changed"
    return "ok"
