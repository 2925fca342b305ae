"""Source files that do not parse in the language of their extension.

A file becomes a string of one-character tokens. Innermost brackets are parsed first: each bracketed part is replaced by
one token that stands for all it may be (arguments, parameters, a block, ...), so every chart parse covers one short
statement, member or list item, and what was parsed once is remembered. Where the chart has no parse at cost zero, the
error-correcting chart finds the fewest edits of every failing part and their places.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import spread
from .arrow import slices
from .chart import Grammar
from .grammars import GRAMMARS
from .lexers import EXTENSIONS, blanked, extension

_MEMO_LIMIT = 300_000

# Private-use ranges of the bracket tokens, by bracket.
_RANGE = {"{": 0xE000, "(": 0xE800, "[": 0xF000}
_INDENT, _WIDEST = 0xF0000, 0x2FFF
_INDENTS = re.compile(r"(?<=\n)[ \t]*")
_CLOSER = {"{": "}", "(": ")", "[": "]"}
#: Tokens of braced parts, as a range of a character class.
_B = "\ue000-\ue7ff"
_GROUP = re.compile(r"\{([^()\[\]{}]*)\}|\(([^()\[\]{}]*)\)|\[([^()\[\]{}]*)\]")
_MARKER = re.compile(r"^(?:<{7}|>{7}|\|{7})(?: |$)|^={7}$", re.M)
_MARKER_LINE = re.compile(r"^(?:<{7}|>{7}|\|{7})(?: [^\n]*)?$|^={7}$", re.M)
_DIRECTIVE = re.compile(r"^[ \t]*#[ \t]*(?:include|define|undef|pragma|if|ifdef|ifndef|elif|elseif|else|endif|error|warning|line|region|endregion|nullable)\b(?:\\\n|[^\n])*", re.M)

_OPS = (
    r"(?=[=!<>+\-*/%&|^?.:@])(?:===|!==|<=>|\.\.\.|\.\.=|\.\.<|\?\?=|\|\|=|&&=|\*\*=|//=|=>|->|::|:=|==|!=|<=|>=|&&|\|\||\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@=|"
    r"\?\?|\?\.|\?:|!!|&\.|=~|\.\.|\*\*|//)"
)
# white space before a token goes with it, so that indentation is one step
_TOKEN = {
    "rs": re.compile(rf"[ \t]*([^\W\d]\w*|\d\w*(?:\.\d\w*)?|'\w+|{_OPS}|\n|\S)"),
    "py": re.compile(rf"[ \t]*([^\W\d]\w*|\d\w*(?:\.\d*(?:[eE][+-]?\d+)?j?)?|{_OPS}|\n[ \t]*|\S)"),
}
_PLAIN_TOKEN = re.compile(rf"[ \t]*((?:[^\W\d]|\$)[\w$]*|\d\w*(?:\.\d\w*)?|{_OPS}|\n|\S)")

# Words of a grammar that may also be names, by language.
_SOFT = {
    "js": "of get set async as from static debugger", "ts": "of get set async as from static type declare is readonly abstract namespace keyof satisfies override public private protected implements interface enum",
    "java": "record sealed permits yield", "cs": "get set init add remove when async await partial record where nameof global yield select not var dynamic", "cpp": "override final", "rs": "union auto",
    "zig": "i", "go": "nil true false", "kt": "get set by data value open inner operator infix companion annotation init constructor catch finally import out enum internal external where", "swift": "get set some any async await mutating lazy weak open indirect left right actor available willSet didSet convenience required dynamic final override optional prefix Type",
    "py": "match case type", "rb": "private raise",
}
# Names of built-in types that a grammar calls Prim0.
_PRIM = {
    "java": "int long short byte char boolean float double void var", "cs": "int long short byte char bool float double decimal void string object var dynamic uint ulong ushort sbyte nint",
    "cpp": "int long short char bool float double void unsigned signed wchar_t char8_t char16_t char32_t",
}
# What else a language keeps for itself, so that it is no name.
_RESERVED = {"js": "enum with", "java": "goto const", "cpp": "template operator", "py": "class", "rb": "", "go": "", "zig": "asm suspend resume nosuspend", "kt": "typeof", "rs": "where", "swift": "", "cs": "", "ts": "with"}

# What a bracketed part may be: category, how its content is cut, and the symbol that each part must derive.
_JS_KINDS = {
    "(": [("args", "comma", "Arg"), ("expr", "whole", "Comma"), ("cond", "whole", "Comma"), ("for", "whole", "For"), ("params", "comma", "Param")],
    "[": [("index", "whole", "Index"), ("list", "list", "Arg"), ("names", "list", "Name"), ("empty", "empty", "")],
    "{": [("block", "segs", "Stmt"), ("object", "comma", "Prop"), ("names", "comma", "Name"), ("specs", "comma", "Spec"), ("cases", "segs", "Case"), ("members", "segs", "Member")],
}
_TS_KINDS = {
    "(": [*_JS_KINDS["("], ("types", "comma", "TypeItem")],
    "[": [*_JS_KINDS["["], ("types", "comma", "TypeItem"), ("key", "whole", "KeyAnn")],
    "{": [*_JS_KINDS["{"], ("fields", "fields", "Field"), ("enum", "comma", "Enum")],
}
_KINDS = {
    "js": _JS_KINDS,
    "ts": _TS_KINDS,
    "java": {
        "(": [("args", "comma", "Arg"), ("expr", "whole", "Expr"), ("cond", "whole", "Expr"), ("for", "whole", "For"), ("params", "comma", "Param"), ("type", "whole", "CastType"), ("resources", "whole", "Res"), ("empty", "empty", "")],
        "[": [("index", "whole", "Expr"), ("empty", "empty", "")],
        "{": [("block", "segs", "Stmt"), ("list", "comma", "Item"), ("members", "segs", "Member"), ("cases", "segs", "Case"), ("enum", "enum", "Enum")],
    },
    "cs": {
        "(": [("args", "comma", "Arg"), ("expr", "whole", "Expr"), ("cond", "whole", "Expr"), ("for", "whole", "For"), ("each", "whole", "Each"), ("params", "comma", "Param"), ("type", "whole", "CastType"), ("types", "comma", "TypeItem"), ("using", "whole", "Using")],
        "[": [("index", "comma", "Index"), ("list", "comma", "Arg"), ("empty", "empty", ""), ("attr", "comma", "AttrItem"), ("params", "comma", "Param")],
        "{": [("block", "segs", "Stmt"), ("list", "comma", "Item"), ("object", "comma", "Prop"), ("members", "segs", "Member"), ("cases", "segs", "Case"), ("enum", "comma", "Enum"), ("accessors", "segs", "Accessor"), ("arms", "comma", "Arm")],
    },
    "cpp": {
        "(": [("args", "comma", "Arg"), ("expr", "whole", "Expr"), ("cond", "whole", "Cond"), ("for", "whole", "For"), ("params", "comma", "Param"), ("type", "whole", "CastType"), ("empty", "empty", "")],
        "[": [("index", "whole", "Expr"), ("empty", "empty", ""), ("names", "comma", "Name"), ("capture", "comma", "Capt"), ("attr", "any", "")],
        "{": [("block", "segs", "Stmt"), ("list", "comma", "Item"), ("members", "segs", "Member"), ("cases", "segs", "Case"), ("enum", "comma", "Enum"), ("tops", "segs", "Top")],
    },
    "rs": {
        "(": [("args", "comma", "Arg"), ("expr", "whole", "Expr"), ("params", "comma", "Param"), ("types", "comma", "TypeItem"), ("pats", "comma", "Pat"), ("tuplefields", "comma", "TupleField"), ("any", "any", "")],
        "[": [("index", "whole", "Expr"), ("list", "comma", "Arg"), ("repeat", "whole", "Repeat"), ("type", "whole", "Type"), ("array", "whole", "ArrType"), ("pats", "comma", "Pat"), ("any", "any", "")],
        "{": [("block", "rust", "Stmt"), ("fields", "comma", "FieldInit"), ("fieldpats", "comma", "FieldPat"), ("fielddefs", "comma", "FieldDef"), ("variants", "comma", "Variant"), ("arms", "arms", "Arm"), ("tops", "segs", "Top"), ("uses", "comma", "Use"), ("any", "any", "")],
    },
    "zig": {
        "(": [("args", "comma", "Arg"), ("expr", "whole", "Expr"), ("cond", "whole", "ZCond"), ("params", "comma", "Param")],
        "[": [("index", "whole", "Index"), ("size", "whole", "Size"), ("empty", "empty", "")],
        "{": [("block", "segs", "Stmt"), ("fields", "comma", "FieldInit"), ("list", "comma", "Item"), ("empty", "empty", ""), ("names", "comma", "Name"), ("members", "zig", "Member"), ("arms", "comma", "Arm")],
    },
    "go": {
        "(": [("args", "comma", "Arg"), ("expr", "whole", "Expr"), ("params", "comma", "Param"), ("type", "whole", "CastType"), ("typekw", "whole", "TypeKw"), ("specs", "segs", "Spec"), ("typespecs", "segs", "TypeSpec"), ("imports", "segs", "Import")],
        "[": [("index", "whole", "Index"), ("empty", "empty", ""), ("dots", "whole", "Dots"), ("types", "comma", "TypeItem"), ("params", "comma", "Param")],
        "{": [("block", "segs", "Stmt"), ("list", "comma", "Item"), ("empty", "empty", ""), ("cases", "segs", "Case"), ("methods", "segs", "Method"), ("fields", "segs", "Field")],
    },
    "kt": {
        "(": [("args", "comma", "Arg"), ("expr", "whole", "Expr"), ("cond", "whole", "Expr"), ("for", "whole", "For"), ("when", "whole", "When"), ("params", "comma", "Param"), ("type", "whole", "CastType"), ("types", "comma", "TypeItem"), ("names", "comma", "Name")],
        "[": [("index", "comma", "Index")],
        "{": [("block", "segs", "Stmt"), ("lambda", "lambda", "Lambda"), ("arms", "segs", "Arm"), ("members", "segs", "Member"), ("enum", "enum", "Enum")],
    },
    "swift": {
        "(": [("args", "comma", "Arg"), ("expr", "whole", "Expr"), ("params", "comma", "Param"), ("types", "comma", "TypeItem"), ("names", "comma", "Name")],
        "[": [("index", "comma", "Arg"), ("list", "comma", "Item"), ("pairs", "colon", "Pair"), ("type", "whole", "Type"), ("pair", "whole", "PairType")],
        "{": [("block", "segs", "Stmt"), ("lambda", "lambda", "Lambda"), ("cases", "segs", "Case"), ("members", "segs", "Member"), ("accessors", "segs", "Accessor")],
    },
    "py": {
        "(": [("args", "comma", "Arg"), ("expr", "whole", "Expr"), ("tuple", "comma", "Item"), ("comp", "whole", "Comp"), ("empty", "empty", ""), ("params", "comma", "Param"), ("specs", "comma", "Spec"), ("withs", "comma", "WithOne")],
        "[": [("list", "comma", "Item"), ("comp", "whole", "Comp"), ("index", "comma", "Index")],
        "{": [("dict", "comma", "Pair"), ("set", "comma", "Item"), ("comp", "whole", "Comp")],
    },
    "rb": {
        "(": [("args", "comma", "Arg"), ("expr", "whole", "Simple"), ("params", "comma", "Param")],
        "[": [("list", "comma", "Arg"), ("index", "comma", "Arg"), ("empty", "empty", "")],
        "{": [("hash", "comma", "Pair"), ("lambda", "lambda", "Lambda")],
    },
}
_EXTRA = {
    "zig": "ZCond = Expr\nZCond = Post Asg Expr\n",
    "go": "Dots = ...\n",
    "kt": "Rest = Stmt\n",
    "swift": "Rest = Stmt\n",
    "rb": "Rest = Line\n",
}
_TOP = {"js": "Stmt", "ts": "Stmt"}
_NEWLINE = {"go", "kt", "swift"}


class _Codes(dict):
    """Token to its code; names, numbers and indents are added as they come."""

    def __missing__(self, word: str) -> str:
        first = word[0]
        if first == "\n":
            code = "\n" + chr(_INDENT + len(word) - 1)
        elif first.isdigit():
            code = "n"
        elif first.isalpha() or first in "_$":
            code = "i"
        elif first == "'" and len(word) > 1:
            code = "L"
        elif len(word) > 1:
            # an operator that the grammar spells apart
            code = "".join(self[c] for c in word)
        else:
            code = "\ufffd"
        if len(self) < _MEMO_LIMIT:
            self[word] = code
        return code


def _ranked(text: str) -> str:
    """The text, its indents by rank where one is wider than a code holds: only their order and sameness count."""
    widths = sorted({len(x) for x in _INDENTS.findall(text)})
    if not widths or widths[-1] <= _WIDEST:
        return text
    rank = {w: k for k, w in enumerate(widths)}
    return _INDENTS.sub(lambda m: " " * rank[len(m.group())], text)


class Language:
    """Tokens, bracket tokens and remembered parses of one language; one object for each worker."""

    def __init__(self, ext: str):
        self.ext = ext
        text = GRAMMARS[ext] + _EXTRA.get(ext, "")
        self.grammar = Grammar(text)
        self.kinds = _KINDS[ext]
        self.top = _TOP.get(ext, "Top")
        words = {s for bodies in self.grammar.rules.values() for b in bodies for s in b if s not in self.grammar.rules}
        soft, prim = set(_SOFT[ext].split()), set(_PRIM.get(ext, "").split())
        self.terms: dict[str, frozenset[str]] = {"i": frozenset({"i", "name"}), "n": frozenset({"n"}), '"': frozenset({'"'}), "L": frozenset({"L"})}
        self.codes = _Codes({'"': '"'})
        at = 0x4E00
        for word in sorted((words | prim | set(_RESERVED[ext].split())) - {"i", "n", '"', "L", "name", "Prim0", "_"}):
            if word[0] in "([{" and len(word) > 1:
                continue
            code = word if len(word) == 1 else chr(at := at + 1)
            alpha = word[0].isalpha()
            self.codes[word] = code
            own = {word} | ({"name"} if alpha else set()) | ({"i"} if word in soft else set())
            if word in prim:
                own |= {"Prim0", "name"} | ({"i"} if word in soft else set())
            self.terms[code] = frozenset(own)
        if ext in ("rs", "zig", "swift", "kt", "go", "py"):
            self.codes["_"] = "_"
            self.terms["_"] = frozenset({"_", "i", "name"}) if ext in ("go", "py", "kt") else frozenset({"_", "name"}) if ext == "swift" else frozenset({"_"}) if "_" in words else frozenset({"i", "name"})
        self.codes[","], self.codes[";"], self.codes["\n"] = ",", ";", "\n"
        for c in "()[]{}":
            self.codes[c] = c
        self.anything = {b: frozenset({f"{b}any{_CLOSER[b]}"}) for b in _RANGE}
        self.groups: dict[tuple[str, frozenset], str] = {}
        self.parts: dict[str, frozenset[str]] = {}
        self.known: dict[str, str] = {}
        self.repaired: dict[tuple, tuple[int, list[int]]] = {}
        self.count = dict.fromkeys(_RANGE, 0)
        self.all_starts = {sym for kinds in self.kinds.values() for _, _, sym in kinds if sym} | {self.top, "Last", "Rest", "Stmt", "Line", "Head", "Mid", "One", "Open", "Close"}
        code = self.codes.get
        cont = "".join(re.escape(c) for c in (code(w) for w in ("else", "catch", "finally", "from", "as", "except", "by", "instanceof", "orelse")) if c)
        ops = [code(w, "") for w in (".", "?.", ",", "=", "?", ":", "==", "===", "!=", "!==", "&&", "||", "+", "??", "=>", "|", "|=", "+=")]
        if ext not in ("cpp", "rs", "zig", "java"):
            ops += [code("/", ""), code("%", "")]
        if ext == "rs":
            ops = [code(w, "") for w in (".", "?", "==", "!=", "&&", "+", ",", "=", "=>", "else", "..", "..=")]
        cont += "".join(re.escape(c) for c in ops if c) + (";" if ext in ("cpp", "zig", "rs", "js", "ts", "java", "cs") else "")
        self.segment = re.compile(rf"(?:[^;{_B}]|[{_B}](?=\n*[{cont}]))*(?:;|[{_B}]|$)" if not ext == "zig" else rf"(?:[^;,{_B}]|[{_B}](?=\n*[{cont}]))*(?:[;,]|[{_B}]|$)")
        self.zig_block = re.compile(rf"(?:[^;{_B}]|[{_B}](?=\n*[{cont}]))*(?:;|[{_B}]|$)")
        self.arm = re.compile(rf"(?:[^,{_B}]|[{_B}](?=\n*[{cont.replace(',', '')}{re.escape(code('=>', ''))}{re.escape(code('if', ''))}]))*(?:,|[{_B}],?|$)")
        after = "".join(re.escape(c) for c in (code(w) for w in (",", "=", "+", "-", "/", "%", "&&", "||", "==", "!=", "<=", ">=", "->", ".", "?.", "?:", ":=", "+=", "-=", "(", "[", "in")) if c)
        before = "".join(re.escape(c) for c in (code(w) for w in (".", "?.", "?:", "&&", "||", "catch", "finally", "where", "??") if ext != "go") if c)
        or_else = rf"|\n+(?={code('else')}(?!{re.escape(code('->', ' '))}))" if ext in ("kt", "swift") else ""
        self.join = re.compile(rf"(?<=[{after}*])\n+" + (rf"|\n+(?=[{before}])" if before else "") + or_else)
        self.do_while = code("do"), code("while")
        self.orelse = code("else") if ext in ("js", "ts", "java", "cs", "cpp", "zig") else ""

    def tokens(self, text: str) -> str:
        text = blanked(self.ext, text.replace("\r\n", "\n").replace("﻿", ""))
        if self.ext in ("cpp", "cs", "swift"):
            text = _DIRECTIVE.sub("", text)
        elif self.ext in ("js", "ts") and text.startswith("#!"):
            text = text[text.find("\n") + 1 :] if "\n" in text else ""
        if self.ext in ("py", "rb"):
            text = re.sub(r"\\\n[ \t]*", " ", text)
        if self.ext == "py":
            text = _ranked("\n" + text.expandtabs(8))
        words = _TOKEN.get(self.ext, _PLAIN_TOKEN).findall(text)
        return "".join(map(self.codes.__getitem__, words))

    def terminals(self, char: str) -> frozenset[str]:
        return self.terms.get(char, frozenset())

    def derives(self, tokens: str) -> frozenset[str]:
        """The symbols that derive a short token string."""
        got = self.parts.get(tokens)
        if got is None:
            got = self.grammar.starts_of(tokens, self.terminals, self.all_starts)
            if len(self.parts) > _MEMO_LIMIT:
                self.parts.clear()
            self.parts[tokens] = got
        return got

    def segments(self, content: str, pattern: re.Pattern | None = None) -> list[str]:
        if self.ext in _NEWLINE:
            return [s for line in self.join.sub("", content).split("\n") for s in self._semicolons(line) if s]
        out = []
        for m in (pattern or self.segment).findall(content):
            m = m.strip("\n")
            if m and out and (m[0] == self.orelse or m[0] == self.do_while[1] and out[-1][0] == self.do_while[0]):
                out[-1] += m
            elif m:
                out.append(m)
        return out

    def _semicolons(self, line: str) -> list[str]:
        # the header of a loop keeps its semicolons
        if ";" in line and line[0] in (self.codes.get("for"), self.codes.get("if"), self.codes.get("switch")) and self.ext == "go":
            return [line]
        return line.split(";") if ";" in line else [line]

    def is_a(self, segment: str, symbol: str) -> bool:
        if symbol in self.derives(segment.replace("\n", "") if self.ext not in ("py",) else segment):
            return True
        if "\n" in segment and self.ext in ("js", "ts"):
            # a statement may end at the end of its line
            lines, held = [x for x in segment.split("\n") if x], ""
            for line in lines:
                if held and symbol in self.derives(held) and (symbol in self.derives(line) or symbol not in self.derives(held + line)):
                    held = line
                else:
                    held += line
            return symbol in self.derives(held)
        return False

    def _fits(self, content: str, how: str, symbol: str) -> bool:
        if how == "any":
            return True
        flat = content.replace("\n", "") if self.ext != "py" else re.sub("\n[\U000f0000-\U000f2fff]?", "", content)
        if how == "empty":
            return not flat
        if how == "whole":
            return bool(flat) and symbol in self.derives(flat)
        if how in ("comma", "list", "colon"):
            if not flat:
                return True
            if ";" in flat or self.ext == "go" and re.search(r"[^,\n]\n+[^\n]", content):
                return False
            if how == "colon" and flat == ":":
                return True
            items = flat.split(",")
            if not items[-1]:
                items.pop()
            return all(symbol in self.derives(x) if x else how == "list" for x in set(items)) and bool(items)
        if how == "fields":
            return all(self.is_a(x.rstrip(",;") , symbol) for x in re.split(r"[;,\n]+", content) if x) or all(self.is_a(x, symbol) for x in self.segments(content))
        if how == "arms":
            return all(self.is_a(x.rstrip(","), symbol) for x in self.segments(content, self.arm))
        if how == "zig":
            return all(self.is_a(x.rstrip(","), symbol) for x in self.segments(content))
        if how == "enum":
            head, _, tail = (self.join.sub("", content) if self.ext in _NEWLINE else content).partition(";")
            names = head.replace("\n", "").split(",")
            return all(symbol in self.derives(x) for x in names if x) and all(self.is_a(x, "Member") for x in self.segments(tail))
        parts = self.segments(content, self.zig_block if self.ext == "zig" else None)
        if how == "rust":
            return all(self.is_a(x, symbol) for x in parts[:-1]) and (not parts or self.is_a(parts[-1], symbol) or self.is_a(parts[-1], "Last"))
        if how == "lambda":
            if self.ext == "rb":
                parts = [x for x in re.split(r"[\n;]+", content) if x]
            rest = "Rest" if "Rest" in self.grammar.rules else "Stmt"
            return not parts or self.is_a(parts[0], symbol) and all(self.is_a(x, rest) for x in parts[1:])
        return all(self.is_a(x, symbol) for x in set(parts))

    def group(self, m: re.Match) -> str:
        whole = m.group()
        code = self.known.get(whole)
        if code is None:
            content, bracket = whole[1:-1], whole[0]
            cats = frozenset(cat for cat, how, sym in self.kinds[bracket] if self._fits(content, how, sym))
            code = self.groups.get((bracket, cats))
            if code is None:
                code = self.groups[bracket, cats] = chr(_RANGE[bracket] + self.count[bracket])
                self.count[bracket] += 1
                self.terms[code] = frozenset(f"{bracket}{cat}{_CLOSER[bracket]}" for cat in cats)
            if len(whole) < 400:
                if len(self.known) > _MEMO_LIMIT:
                    self.known.clear()
                self.known[whole] = code
        # what may only be anything (a macro's tokens) is looked at too, should the file fail
        if not self.terms[code] or self.terms[code] == self.anything.get(whole[0]):
            self.failed.append(whole)
        return code

    def reduce(self, tokens: str) -> str:
        self.failed: list[str] = []
        while True:
            tokens, n = _GROUP.subn(self.group, tokens)
            if not n:
                return tokens

    def check(self, text: str) -> tuple[bool, str, list[str]]:
        """(valid, reduced tokens, parts without a parse)."""
        reduced = self.reduce(self.tokens(text))
        if re.search(r"[()\[\]{}]", reduced):
            return False, reduced, self.failed
        if self.ext == "py":
            bad = self._python(reduced)
        elif self.ext == "rb":
            bad = self._ruby(reduced)
        else:
            parts = self.segments(reduced, self.zig_block if self.ext == "zig" else None)
            bad = [x for x in parts if not self.is_a(x, self.top)]
        return not bad, reduced, [*self.failed, *bad] if bad else []

    def _python(self, reduced: str) -> list[str]:
        levels, heads, expect, bad, excused = [0], {0: ""}, False, [], False
        code = self.codes.get
        follows = {code("elif"): (code("if"), code("elif")), code("except"): (code("try"), code("except")), code("finally"): (code("try"), code("except"), code("else")), code("else"): tuple(map(code, ("if", "elif", "for", "while", "except")))}
        for line in re.split("\n(?=[\U000f0000-\U000f2fff])|\n", reduced):
            if not line:
                continue
            width = 0
            if line[0] >= "\U000f0000":
                width, line = ord(line[0]) - _INDENT, line[1:]
            line = line.strip("\n")
            if not line:
                continue
            # what a line without a parse leads may be its block
            if (expect or excused) and width > levels[-1]:
                levels.append(width)
            else:
                wrong = expect
                while width < levels[-1]:
                    levels.pop()
                if wrong or width != levels[-1]:
                    bad.append(line)
                    if width != levels[-1]:
                        levels.append(width)
            expect = excused = False
            what = self.derives(line)
            first = line[0]
            if "Mid" in what or ("One" in what and first in follows):
                if heads.get(width) is not None and heads.get(width) not in follows.get(first, ()) or width not in heads:
                    bad.append(line)
            elif not what & {"Line", "Head", "One"}:
                bad.append(line)
                excused = True
            if "Head" in what or "Mid" in what:
                expect = True
            for deeper in [w for w in heads if w > width]:
                del heads[deeper]
            if first == code("async") and len(line) > 1:
                first = line[1]
            if heads.get(width) == code("try") and first not in (code("except"), code("finally")):
                bad.append(line)
            # None: what a line without a parse leads is not known
            heads[width] = None if excused else first if what & {"Head", "Mid", "One"} else ""
        return [*bad, "\n"] if expect or code("try") in heads.values() else bad

    def _ruby(self, reduced: str) -> list[str]:
        depth, bad = 0, []
        joined = self.join.sub("", reduced)
        for line in joined.split("\n"):
            line = line.strip(";")
            if not line:
                continue
            what = self.derives(line)
            if "Line" in what:
                continue
            if "Open" in what:
                depth += 1
            elif "Close" in what:
                depth -= 1
                if depth < 0:
                    bad.append(line)
                    depth = 0
            elif not ("Mid" in what and depth):
                bad.append(line)
        return [*bad, "\n"] if depth else bad

    def failing_pieces(self, part: str) -> tuple[list[tuple[int, str]], list[str]]:
        """(offset, piece) of the statements or items of a part that have no parse, and the symbols that a piece may derive."""
        at = 1 if part[:1] in _RANGE else 0
        inner = part[at : len(part) - at]
        starts = [sym for _, how, sym in self.kinds[part[0]] if sym] if at else [self.top, "Stmt", "Line", "Head"]
        found = [x for x in (self.segments(inner) if self.ext not in ("py", "rb") else inner.split(",")) if x]
        out, last = [], 0
        for piece in found:
            last = max(last, inner.find(piece, last))
            if not self.derives(piece.replace("\n", "")):
                out.append((at + last, piece.replace("\n", "")))
            last += len(piece)
        return out or [(at, inner.replace("\n", ""))], sorted(set(starts))

    def repair(self, parts: list[str]) -> tuple[int, list[tuple[int, int]]]:
        """(cost, places): the edits of all parts without a parse, and where each is: number of the part and offset in it."""
        total, places = 0, []
        for n, part in enumerate(parts):
            pieces, starts = self.failing_pieces(part)
            for offset, piece in pieces:
                key = piece, tuple(starts)
                if key not in self.repaired:
                    if len(self.repaired) > 10_000:
                        self.repaired.clear()
                    self.repaired[key] = self.grammar.repair(piece, self.terminals, starts)
                cost, found = self.repaired[key]
                total += cost
                places += [(n, offset + x) for x in (found or ([len(piece)] if cost else []))]
        return total, places

    def marker_runs(self) -> tuple[str, ...]:
        """The tokens of merge markers."""
        if not self._runs:
            self._runs = tuple("".join(map(self.codes.__getitem__, _TOKEN.get(self.ext, _PLAIN_TOKEN).findall(c * 7))) for c in "<>=|")
        return self._runs

    _runs: tuple[str, ...] = ()


_languages: dict[str, Language] = {}


def language(ext: str) -> Language:
    if ext not in _languages:
        _languages[ext] = Language(ext)
    return _languages[ext]


@dataclass
class Verdict:
    valid: bool
    cause: str = ""
    cost: int = 0
    other: str = ""


def judge(ext: str, text: str, explain: bool = True) -> Verdict:
    """Whether a text follows the grammar of an extension; if not, the least edits found and what their places point to.

    A text is flagged where the chart has no parse without an edit. Causes: conflict (edits fall on merge markers),
    truncation (all edits fall on the end: what is open there, or the last statement), mismatch (it parses in another of
    the languages, named in `other`), broken.
    """
    lang = language(ext)
    valid, reduced, parts = lang.check(text)
    if valid:
        return Verdict(True)
    if not explain:
        return Verdict(False)
    open_ = len(re.findall(r"[(\[{]", reduced))
    stray = len(re.findall(r"[)\]}]", reduced))
    failing = [p for p in parts if p != "\n"]
    ends = open_ + stray + parts.count("\n")
    if _MARKER.search(blanked(ext, text.replace("\r\n", "\n"))) and any(run in where for run in lang.marker_runs() for where in (reduced, *parts)):
        # the markers' lines go
        lines = [m.group() for m in _MARKER_LINE.finditer(blanked(ext, text.replace("\r\n", "\n")))]
        return Verdict(False, "conflict", sum(len(lang.tokens(x).strip("\n")) for x in lines))
    if open_ and not stray and not failing:
        # all that is closed parses, the rest never ends
        return Verdict(False, "truncation", ends)
    cost, places = lang.repair(failing)
    for other in EXTENSIONS:
        if other != ext and language(other).check(text)[0]:
            return Verdict(False, "mismatch", max(cost + ends, 1), other)
    last = len(failing) - 1
    at_end = last >= 0 and reduced.rstrip("\n").endswith(failing[-1].rstrip("\n"))
    tail = at_end and all(n == last and x >= 0.8 * len(failing[-1]) for n, x in places)
    truncated = not stray and (tail or not places and ends) or open_ and not stray
    return Verdict(False, "truncation" if truncated else "broken", max(cost + ends, 1))


def _verdicts(kind: pa.DataType, explain: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["k", "repository", "lang", "ext", "valid", "cause", "cost", "parses_as"]
        for batch in slices(batches):
            rows = []
            for key, repository, lang, path, text in zip(*(batch.column(c).to_pylist() for c in range(5))):
                ext = extension(path)
                if ext not in EXTENSIONS or not text.strip():
                    continue
                v = judge(ext, text, explain)
                rows.append((key, repository, lang, ext, v.valid, v.cause or None, v.cost, v.other or None))
            types = (kind, pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(types)], names)

    return run


def syntax_verdicts(files: DataFrame, key: str = "file_id", path: str = "path", text: str = "content", explain: bool = True) -> DataFrame:
    """key, repository, lang, ext, valid, cause, cost, parses_as of every file whose extension names one of the languages.

    Null and blank contents, null paths and other extensions have no row. A file delivered twice comes out twice.
    """
    kind = files.schema[key].dataType
    rows = spread(files.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), "repository", "lang", F.col(path).alias("p"), F.col(text).alias("t")))
    schema = f"k {kind.simpleString()}, repository string, lang string, ext string, valid boolean, cause string, cost int, parses_as string"
    return rows.mapInArrow(_verdicts(to_arrow_type(kind), explain), schema).withColumnRenamed("k", key)


def syntax_rates(verdicts: DataFrame, key: str = "file_id") -> DataFrame:
    """Per repository and language: files, files that do not parse, and their share, each file once."""
    once = verdicts.groupBy(key).agg(F.max("repository").alias("repository"), F.max("lang").alias("lang"), F.min("valid").alias("valid"))
    return once.groupBy("repository", "lang").agg(F.count("*").alias("files"), F.count_if(~F.col("valid")).alias("invalid")).withColumn("share", F.round(F.col("invalid") / F.col("files"), 6))
