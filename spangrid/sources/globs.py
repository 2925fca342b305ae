"""Shell patterns as regular expressions over slash-separated paths."""

from __future__ import annotations

import re


def _segment(pattern: str) -> str:
    """One path segment. `*` and `?` don't cross slashes and don't match a leading dot; an unclosed `[` is itself."""
    out, k = "", 0
    while k < len(pattern):
        c = pattern[k]
        close = pattern.find("]", k + 2 + (pattern[k + 1 : k + 2] in ("!", "^"))) if c == "[" else -1
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and close > 0:
            body = pattern[k + 1 : close]
            negated = body[:1] in ("!", "^")
            body = re.sub(r"([\\\[\]^&~])", r"\\\1", body[1:] if negated else body)
            out += f"[^/{body}]" if negated else f"[{body}]"
            k = close
        else:
            out += re.escape(c)
        k += 1
    return ("[^./]" + out[len("[^/]") :] if out.startswith("[^/]") and not out.startswith("[^/]*") else out) if not out.startswith("[^/]*") else "(?:[^./]" + out + ")?" if out == "[^/]*" else _starless(out)


def _starless(out: str) -> str:
    """A segment that begins with a star: either the star is empty, or its first character is no dot."""
    rest = out[len("[^/]*") :]
    return f"(?:[^./][^/]*)?{rest}"


def glob_regex(pattern: str) -> str:
    """`**` as a whole segment stands for any number of segments, none included, without hidden ones."""
    parts = pattern.split("/")
    out = ""
    for k, part in enumerate(parts):
        last = k == len(parts) - 1
        if part == "**":
            out += "(?:[^./][^/]*(?:/[^./][^/]*)*)?" if last else "(?:[^./][^/]*/)*"
        else:
            out += _segment(part) + ("" if last else "/")
    return out


def has_pattern(value: str) -> bool:
    return bool(re.search(r"[*?\[\\]", value))
