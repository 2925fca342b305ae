"""Comments, string literals and code tokens of source files in twelve languages, by one regular expression each."""

from __future__ import annotations

import re
from functools import lru_cache

EXTENSIONS = ("ts", "js", "py", "java", "rs", "zig", "go", "cpp", "cs", "rb", "kt", "swift")

_LINE = r"(?P<lc>//[^\n]*)"
_BLOCK = r"(?P<bc>/\*[\s\S]*?\*/)"
_DOUBLE = r'"(?:\\.|[^"\\\n])*"'
_SINGLE = r"'(?:\\.|[^'\\\n])*'"
_CHAR = r"'(?:\\[^\n']{1,10}|\\'|[^'\\\n])'"
_TRIPLE = r'"""[\s\S]*?"""'
_TICKS = r"`(?:\\[\s\S]|[^`\\])*`"
# a regular expression literal stands where a value is expected, after at most one space
_REGEX = r"(?:(?<=[(=,:\[!&|?{};])|(?<=[(=,:\[!&|?{};] ))/(?![*/\s])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*"
_C = f"{_LINE}|{_BLOCK}"
_HASH = r"(?P<lc>#[^\n]*)"

_PARTS = {
    "js": f"{_C}|(?P<s>{_DOUBLE}|{_SINGLE}|{_TICKS}|{_REGEX})",
    "java": f"{_C}|(?P<s>{_TRIPLE}|{_DOUBLE}|{_CHAR})",
    "cs": f'{_C}|(?P<s>{_TRIPLE}|\\$?@\\$?"(?:""|[^"])*"|\\$?{_DOUBLE}|{_CHAR})',
    "cpp": f'{_C}|(?P<s>R"(?P<tag>[^\\s()\\\\]{{0,16}})\\([\\s\\S]*?\\)(?P=tag)"|(?:u8|[uUL])?{_DOUBLE}|{_CHAR})',
    "go": f"{_C}|(?P<s>{_DOUBLE}|`[^`]*`|{_CHAR})",
    "kt": f"{_C}|(?P<s>{_TRIPLE}|{_DOUBLE}|{_CHAR})",
    "swift": f'{_C}|(?P<s>(?P<hash>#+)"[\\s\\S]*?"(?P=hash)|{_TRIPLE}|{_DOUBLE})',
    "rs": f'{_C}|(?P<s>b?r(?P<hash>#*)"[\\s\\S]*?"(?P=hash)|b?"(?:\\\\[\\s\\S]|[^"\\\\])*"|b?{_CHAR})',
    "zig": f"{_LINE}|(?P<s>{_DOUBLE}|{_CHAR}|(?:\\\\\\\\[^\\n]*(?:\\n[ \\t]*(?=\\\\\\\\))?)+)",
    "py": f"{_HASH}|(?P<s>(?:\\b[rRbBuUfF]{{1,2}})?(?:{_TRIPLE}|'''[\\s\\S]*?'''|{_DOUBLE}|{_SINGLE}))",
    "rb": f"(?P<bc>^=begin\\b[\\s\\S]*?^=end\\b[^\\n]*)|{_HASH}|(?P<s>{_DOUBLE}|{_SINGLE}|<<[~-]?(?P<tag>[A-Z]\\w*)\\b[\\s\\S]*?^[ \\t]*(?P=tag)$)",
}
_PARTS["ts"] = _PARTS["js"]


#: Characters that a comment or string can begin with; a look at one spares the alternatives everywhere else.
_BEGIN = {"js": "/\"'`", "ts": "/\"'`", "java": "/\"'", "cs": "/\"'@$", "cpp": "/\"'RuUL", "go": "/\"'`", "kt": "/\"'", "swift": "/\"#", "rs": "/\"'br", "zig": "/\"'\\\\", "py": "#\"'rRbBuUfF", "rb": "#\"'=<"}


def _guarded(ext: str, parts: str) -> re.Pattern:
    return re.compile(f"(?=[{_BEGIN.get(ext, _BEGIN['js'])}])(?:{parts})", re.M)


@lru_cache(None)
def span_pattern(ext: str) -> re.Pattern:
    """Groups lc (line comment), bc (block comment), s (string)."""
    return _guarded(ext, _PARTS.get(ext, _PARTS["js"]))


@lru_cache(None)
def _strip_pattern(ext: str) -> re.Pattern:
    """Comments and strings, the latter with one captured quote so that a template can keep it."""
    parts = _PARTS.get(ext, _PARTS["js"]).replace("(?P<lc>", "(?:").replace("(?P<bc>", "(?:")
    return _guarded(ext, parts)


def extension(path: str | None) -> str:
    """The language's extension, lower case; empty without one."""
    name = (path or "").rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[1].lower() if "." in name else ""


def blanked(ext: str, text: str) -> str:
    """The code with every comment a space and every string a lone quotation mark."""
    return _strip_pattern(ext).sub(lambda m: '"' if m.group("s") is not None else " ", text)
