"""Generated, minified or vendored source files, and files whose content is no program text.

Signals of a file itself: directories and suffixes of its path, a note in it, the layout of its code, the share of
it that is data. Signal of the collection: winnowed fingerprints of the normalised token stream, most of which recur in
many unrelated repositories; where these hold them in files that tools wrote, a copy without path or note is one too.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import materialise, spread
from .arrow import long_lists, slices
from .copies import text_class
from .lexers import blanked, extension, span_pattern
from .shingles import run_hashes, winnow, word_hashes

# Directories that hold other projects' code, and those that hold what tools write.
VENDOR_DIRS = frozenset("vendor vendors vendored third_party thirdparty third-party 3rdparty node_modules bower_components jspm_packages extern external externals deps bundled godeps pods carthage site-packages subprojects".split())
TOOL_DIRS = frozenset("generated __generated__ gen autogen auto-gen auto_gen src-gen gen-src generated-src generated-sources genfiles dist".split())
#: A file under pb or _pb is a protocol stub only together with one of these.
_STUB_DIRS = frozenset("stubs pb pb2 protos".split())
_TOOL_NAME = re.compile(r"(?:\.(?:min|bundle|pb|g|gen|generated|designer|autogen)\.[A-Za-z]+|[._-](?:pb|pb2|grpc|generated|gen)\d*\.[A-Za-z]+)$", re.I)
_MIN_NAME = re.compile(r"[.-]min\.[A-Za-z]+$", re.I)

# What a note says, clause by clause: that a tool makes the file, that edits do not last, where the true source is; or that
# the file is another project's. A note stands anywhere in the file; what makes it one is that it ties the making, the
# prohibition or the loss to the file or to a build, not to a value, an event or a user.
_FILE = r"(?:this|the)\s+(?:whole\s+|entire\s+)?(?:file|module|source|code|header|script|bundle|copy|directory|folder|document|page)\b"
_MADE = r"(?:generated|emitted|produced|rendered|compiled|transpiled|built|created|written|derived|exported|assembled|converted|scaffolded)"
_BY = r"(?:automatically\s+|mechanically\s+)?(?:by|from|with|via|using|out\s+of)\b"
_NO_TOOL = r"(?!\s+(?:hand|the\s+(?:caller|bundler|user|worker|server|client|parser|first|last|next|previous|same)|us|me|you|them|it|default)\b)"
_SOURCE = r"\s+(?:the\s+|a\s+|an\s+|our\s+)?(?:`[^`]+`|[\w./-]*\w\.[a-z]\w{1,9}\b|[\w./-]+\s+v?\d+\.\d|\w*(?:gen|forge|loom|craft|compiler|generator|tool|script|schema|template|grammar|definition|spec|builder|codegen)s?\b)"
_WORK = r"(?:changes|edits|modifications|tweaks|alterations|adjustments|patches)"
_LOST = r"(?:lost|overwritten|discarded|wiped(?:\s+out)?|clobbered|erased|reverted|undone|dropped|thrown\s+away|gone|replaced|vanish|disappear|go\s+away|not\s+survive|not\s+last)"
_REMADE = r"(?:build|builds|built|regenerat\w*|generat\w+|export\w*|compil\w+|sync\w*|codegen|release|pipeline|import|make|tool|script|job)"
_AGENT = r"(?:job|script|bot|pipeline|cron(?:tab|job)?|hook|tool|generator|build|codegen|importer|exporter|compiler|sync|workflow|make\s+target|robot)"
_ACTS = r"(?:puts?|writes?|wrote|drops?|creates?|created|refreshes|rewrites|emits|emitted|places|produces|produced|updates|overwrites|regenerates|generates|generated|fetches|pulls|copies|brings|installs|maintains)"
_TOOL_NOTE = re.compile(
    rf"""@generated\b|<auto-?generated
    |\b(?:auto-?|machine[\s-]+)(?:generated|written|produced|created|made)\b(?!\s+(?:\w+\s+)?(?:ids?|keys?|names?|values?|numbers?|tokens?|uuids?)\b)
    |\bautomatically\s+{_MADE}\b(?!\s+(?:when|if|for|on|whenever|once|as)\b)
    |\b(?:code|file|source|module|this)\s+(?:is\s+|was\s+|has\s+been\s+|gets\s+)?generated\s+{_BY}
    |{_FILE}[^.;]*?\b(?:is|was|been|gets|being)\s+(?:\w+ly\s+)?{_MADE}\s+(?:automatically\b|{_BY}{_NO_TOOL})
    |(?:^|[.;:!]\s)\W*(?:code\s+|source\s+|file\s+)?(?:generated|emitted|rendered|compiled|transpiled|exported|scaffolded)\s+{_BY}{_NO_TOOL}\s+\S
    |(?:^|[.;:!]\s)\W*{_MADE}\s+{_BY}{_SOURCE}
    |\b(?:do\s+not|don't|never|avoid|no\s+need\s+to)\s+(?:hand[\s-]*)?(?:edit|modify|change|touch|alter)(?:ing)?\b(?:[^.;]*\b(?:by\s+hand|manually|directly|this\s+(?:file|module|copy))|\s+it\s+here\b|\W*$|\s*[.!;*/])
    |\b(?:not\s+meant|not\s+intended|never\s+meant)\s+(?:to\s+be\s+edited|for\s+(?:manual\s+)?editing)\b|\bmanual\s+{_WORK}\s+(?:will|are|get|is)\b|\bhand[\s-]edits?\b
    |\b{_WORK}\s+to\s+{_FILE}[^.;]*\b{_LOST}\b|(?:^|[.;,!]\s)\W*(?:any\s+|all\s+|your\s+|manual\s+|local\s+)?{_WORK}\s+(?:will\s+be|are|get)\s+{_LOST}(?=\W*$|\s*[.;,!])
    |\b{_WORK}\b[^.;]*\b{_LOST}\b[^.]*\b{_REMADE}\b|\b{_REMADE}\b[^.;]*\b(?:loses|overwrites|discards|wipes|clobbers|replaces|erases)\b[^.;]*\b{_WORK}\b
    |\b(?:re-?generate|re-?build|re-?create)\s+(?:it\s+|this\s+|{_FILE}\s+)?(?:with|by|using|via)\b|\b(?:re-?)?run\s+\S+(?:\s+\S+)?\s+(?:again\s+(?:after|instead)|to\s+(?:regenerate|refresh|update)\s+(?:it|this|{_FILE}))
    |\bsource\s+of\s+(?:record|truth)\s+(?:is|lives|for\s+this)\b|\bedit\s+\S+\s+instead\b
    |\b{_AGENT}\s+(?:\w+ly\s+)?{_ACTS}\s+(?:it|this|{_FILE})\b|\b\w+\s+(?:wrote|generated|emitted)\s+{_FILE}
    |^\W*output\s+(?:of|from)\s+\S+\s+v?\d""",
    re.I | re.X,
)
_TOOK = r"(?:copied|taken|imported|synced|mirrored|extracted|lifted|borrowed|pulled|downloaded|forked|vendored|ported|dropped\s+in)"
_COPY_NOTE = re.compile(
    rf"""\bvendor(?:ed|ing)?\s+(?:(?:in\s+)?from|copy|drop|import|snapshot|at|version|code|source)\b|\bvendored\b(?=\W*$|[^.]*\d)
    |\b{_TOOK}\s+(?:over\s+)?(?:unchanged|unmodified|verbatim|wholesale|as[\s-]is|byte\s+for\s+byte)\b
    |\b{_TOOK}\s+(?:by\s+the\s+import|from\b(?!\s+(?:the\s+)?(?:rfc|iso|ecma|ieee|table|section|figure|chapter|appendix|page|line|cache|config\w*|input|buffer|queue|server|request)\b)(?:[^.]*?(?:\bupstream\b|\bwithout\s+(?:any\s+)?changes\b|\bunchanged\b|\bverbatim\b|https?:)|\s+[\w./@-]+(?:\s+[\w-]+)?[\s@]+v?\d+\.\d))
    |\b(?:imported|vendored|unmodified|verbatim|pristine|exact|bundled|embedded|mirrored|third[\s-]party)\s+(?:copy|snapshot|mirror|release|fork|drop)\s+of\b|\bwithout\s+changes\s+so\s+that\b
    |\bupstream\s+(?:owns|project|tree|tag|release|version|repository|repo|sources?|authors?|maintainers?)\b|\b(?:send|report|submit|file)\s+(?:\w+\s+)?(?:fixes|patches|changes|bugs|issues)\s+(?:to\s+(?:the\s+)?)?upstream\b
    |\bthird[\s-]party\s+(?:code|source|library|component|software)\b(?!\s+(?:may|can|must|should|calls?)\b)|^\W*third[\s-]party\s*:|^\W*origin\s*:\s*(?:\w+://|[\w.-]+/[\w.-]+|[\w.-]+[\s@](?:release\s+)?v?\d+\.\d)|\bsee\s+its\s+own\s+notice\b|\bsnapshot\s+\S+,?\s+synced\b|\blocal\s+patches\s+are\b
    |\b{_AGENT}\s+(?:\w+ly\s+)?(?:syncs|mirrors|vendors|imports)\s+(?:it|this|{_FILE})\b""",
    re.I | re.X,
)
#: A banner of a bundler: name and version in a kept comment on the first line.
_BANNER = re.compile(r"\A\s*/\*!")
_PAGE = re.compile(r"\A[\s\ufeff]*(?:(?:<!--[\s\S]*?-->\s*)*(?:<!doctype\b|<html\b|<\?xml\b|<svg\b|<head\b|<body\b|<rss\b)|(?:<!--[\s\S]*?-->\s*)+<\w)", re.I)
_POINTER = re.compile(r"\A\s*version\s+\S+\s*\noid\s+\w+:[0-9a-f]{16,}", re.I)
_YAML = re.compile(r"^(?:[ \t]*-\s+\S.*|[ \t]*[\w\".-]+:(?:\s.*)?|---|\s*|[ \t]*#.*)$")
_CODE_LINE = re.compile(r"[;{}()=]|\b(?:import|return|def|func|fn|class|end|if|else|for|while|use|package)\b")
_LISTED = re.compile(r"(?:0[xX][0-9a-fA-F]+|\d[\d.]*)\s*,\s*")
_LITERAL = re.compile(r"\"[^\"\s\\]{120,}\"|'[^'\s\\]{120,}'|\"[^\"\n]{400,}\"")


def path_signal(path: str | None) -> str:
    """generated, minified, vendored or nothing, by directories and suffixes; words inside a name don't count."""
    parts = (path or "").lower().split("/")
    folders, name = parts[:-1], parts[-1]
    if any(p in VENDOR_DIRS for p in folders):
        return "vendored"
    if _MIN_NAME.search(name):
        return "minified"
    if any(p in TOOL_DIRS for p in folders) or any(a in _STUB_DIRS and b in _STUB_DIRS for a, b in zip(folders, folders[1:])) or _TOOL_NAME.search(name):
        return "generated"
    return ""


_MARKS = re.compile(r"^\s*(?:/\*+!?|\*+/?|//+!?|#+!?)|\*+/\s*$", re.M)


def own_line_comments(ext: str, text: str) -> list[str]:
    """Comments on lines of their own, without their marks; those with only white space between are one."""
    out, end = [], -1
    for m in span_pattern(ext).finditer(text):
        if m.lastgroup in ("lc", "bc") and not text[text.rfind("\n", 0, m.start()) + 1 : m.start()].strip():
            if out and not text[end : m.start()].strip():
                out[-1].append(m.group())
            else:
                out.append([m.group()])
            end = m.end()
    return [_MARKS.sub("", "\n".join(x)) for x in out]


def note_signal(ext: str, text: str) -> str:
    """By the notes among the comments on lines of their own, wherever they stand."""
    notes = own_line_comments(ext, text)
    # a note may run over lines; one that begins a line is tried from there too
    forms = [f for x in notes for f in (" ".join(x.split()), *(line.strip() for line in x.splitlines() if line.strip()))]
    if any(map(_TOOL_NOTE.search, forms)):
        return "generated"
    return "vendored" if any(map(_COPY_NOTE.search, forms)) else ""


def _is_json(text: str) -> bool:
    body = text.strip()
    if body[:1] not in "{[" or body[-1:] not in "}]":
        return False
    try:
        json.loads(body)
    except ValueError:
        return False
    return True


#: Share of a file's runs of four line shapes that repeat an earlier one, from which it must come from a template; the
#: most repetitive hand-written files of the sample tables stay below 0.4, tool-written ones without a note above 0.7.
REPEATED = 0.55
#: Lines besides the literal or list that a file of data may have.
REST_LINES = 6
_WORDY = re.compile(r"^.*\w.*$", re.M)
_SIGNS = re.compile(r"[=,?&|+<>{]")
_AIRED = re.compile(r" [=?&|+<>{]|[=,?&|+<>] ")
_SHAPE = re.compile(r"\w+")


def repetition(lines: list[str]) -> float:
    """Share of the runs of four line shapes (words blanked) that occurred before in the file."""
    if len(lines) < 12:
        return 0.0
    shapes = [_SHAPE.sub("w", x.strip()) for x in lines]
    runs = list(zip(shapes, shapes[1:], shapes[2:], shapes[3:]))
    return 1 - len(set(runs)) / len(runs)


def content_signal(ext: str, text: str) -> str:
    """page, pointer, data, minified or generated, by the content alone."""
    if _PAGE.match(text):
        return "page"
    if _POINTER.match(text):
        return "pointer"
    lines = [x for x in text.split("\n") if x.strip()]
    if not lines:
        return ""
    if _is_json(text):
        return "data"
    if len(lines) >= 4 and sum(1 for x in lines if _YAML.match(x.rstrip("\r"))) >= 0.95 * len(lines) and sum(1 for x in lines if _CODE_LINE.search(x)) < 0.1 * len(lines):
        return "data"
    if len(lines) >= 4:
        commas = [x.count(",") or x.count("\t") for x in lines]
        if min(commas) >= 1 and len(set(commas)) == 1 and not any(map(_CODE_LINE.search, lines)):
            return "data"
    rows = [x for x in blanked(ext, text).split("\n") if x.strip()]
    if rows:
        chars = sum(map(len, rows))
        spaces = sum(x.count(" ") + x.count("\t") for x in rows)
        # hand-written code has white space around its operators and breaks its lines
        signs, aired = len(_SIGNS.findall("\n".join(rows))), len(_AIRED.findall("\n".join(rows)))
        dense = spaces < 0.08 * chars or signs >= 20 and aired < 0.04 * signs
        if dense and chars > 250 and chars / len(rows) > 110 or _BANNER.match(text) and dense:
            return "minified"
    # long literals and lists of numbers against the rest
    held = sum(len(m) for m in _LISTED.findall(text)) + sum(len(m) for m in _LITERAL.findall(text))
    if len(text) > 200 and held >= 0.6 * len(text) and len(_WORDY.findall(_LISTED.sub("", "\n".join(rows)))) <= REST_LINES:
        return "data"
    return "generated" if repetition(lines) >= REPEATED else ""


def file_signal(path: str | None, text: str) -> str:
    """The first signal of a file itself, or nothing. Blank texts have none."""
    if not text.strip():
        return ""
    ext = extension(path)
    return path_signal(path) or note_signal(ext, text) or content_signal(ext, text)


# --- recurrence over repositories

#: Words in a run and runs in a window: any 12 + 24 - 1 words in a row leave a shared fingerprint.
RUN, WINDOW = 12, 24
#: Owners of repositories in which a fingerprint must occur, and share of a file's fingerprints that must be such.
MANY_OWNERS, LARGELY = 5, 0.8


#: Signals that tell that a tool made the text itself, so that its copies were made by one too. A minified copy says
#: nothing of its source, whose tokens may be the same, nor a vendored one of a copy without path or note.
_TOOLS = frozenset({"generated"})


def _evidence(kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, str | None, bool]] = set()
        for batch in slices(batches):
            keys, classes, owners, paths, texts = (batch.column(c).to_pylist() for c in range(5))
            signals, prints = [], []
            for cls, owner, path, text in zip(classes, owners, paths, texts):
                signal = file_signal(path, text)
                signals.append(signal or None)
                # every row has its own path and so its own signal, but a text's fingerprints are sent once for an owner and kind of signal
                sent = cls, owner, signal in _TOOLS
                hashes = run_hashes(word_hashes(blanked(extension(path), text)) if sent not in seen else np.empty(0, dtype=np.uint64), RUN)
                seen.add(sent)
                prints.append(np.unique(hashes[winnow(hashes, WINDOW)]))
            columns = [pa.array(keys, kind), pa.array(classes, pa.int64()), pa.array(owners, pa.string()), pa.array(signals, pa.string()), long_lists(prints)]
            yield pa.RecordBatch.from_arrays(columns, ["k", "cls", "owner", "signal", "prints"])

    return run


def evidence(files: DataFrame, key: str = "file_id", path: str = "path", text: str = "content", repository: str = "repository") -> DataFrame:
    """(k, cls, owner, signal, prints): of every delivered file with a content its text class, the signal it shows itself, and the
    winnowed fingerprints of its token stream, which copies of a text in an owner's repositories hold once.

    The owner is the part of the repository's name before the slash, so forks and sister projects count once.
    """
    kind = files.schema[key].dataType
    owner = F.substring_index(F.col(repository), "/", 1)
    rows = spread(files.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), text_class(text).alias("cls"), owner.alias("owner"), F.col(path).alias("p"), F.col(text).alias("t")))
    return materialise(rows.mapInArrow(_evidence(to_arrow_type(kind)), f"k {kind.simpleString()}, cls long, owner string, signal string, prints array<long>"))


def _pairs(seen: DataFrame) -> DataFrame:
    tool = F.coalesce(F.col("signal").isin(*_TOOLS), F.lit(False))
    return seen.select("cls", "owner", tool.alias("tool"), F.size("prints").alias("size"), F.explode("prints").alias("print"))


def _mostly(pairs: DataFrame, prints: DataFrame, largely: float) -> DataFrame:
    """(cls): text classes at least `largely` of whose fingerprints, four or more, are among the prints."""
    hits = pairs.join(prints, "print", "left_semi").select("cls", "size", "print").distinct().groupBy("cls").agg(F.count("*").alias("n"), F.max("size").alias("size"))
    return hits.where((F.col("n") >= largely * F.col("size")) & (F.col("size") >= 4)).select("cls")


def widely_copied(seen: DataFrame, many: int = MANY_OWNERS, largely: float = LARGELY) -> DataFrame:
    """(cls): text classes most of whose fingerprints occur in repositories of at least `many` owners.

    Files without a repository are looked up but count for none.
    """
    pairs = _pairs(seen)
    # owners are counted up to the threshold's order of magnitude only by distinct (print, owner) rows, pre-aggregated on the map side
    common = pairs.where("owner is not null").select("print", "owner").distinct().groupBy("print").agg(F.count("*").alias("owners")).where(F.col("owners") >= many).select("print")
    return _mostly(pairs, common, largely)


def tool_texts(seen: DataFrame, many: int = MANY_OWNERS, largely: float = LARGELY) -> DataFrame:
    """(cls): text classes most of whose fingerprints recur in repositories of at least `many` owners in files that show that a
    tool wrote them, and in `largely` of all owners' only in such. Hand-written text that some keep in a tool's folder too is none.
    """
    pairs = _pairs(seen)
    owned = pairs.where("owner is not null")
    # only prints that recur in tools' files are counted over all files
    marked = owned.where("tool").select("print", "owner").distinct().groupBy("print").agg(F.count("*").alias("owners")).where(F.col("owners") >= many).select("print")
    pairs = pairs.join(materialise(marked), "print", "left_semi")
    each = pairs.where("owner is not null").groupBy("print", "owner").agg(F.bool_and("tool").alias("only"))
    counted = each.groupBy("print").agg(F.count_if("only").alias("only"), F.count("*").alias("owners"))
    return _mostly(pairs, counted.where((F.col("only") >= many) & (F.col("only") >= largely * F.col("owners"))).select("print"), largely)


def _signals(seen: DataFrame) -> DataFrame:
    """(k, signal) by the file itself, else by the recurrence of its fingerprints in tools' files."""
    own = seen.where("signal is not null").select("k", "signal")
    copied = seen.where("signal is null").join(tool_texts(seen), "cls", "left_semi").select("k", F.lit("generated").alias("signal"))
    return own.unionByName(copied).groupBy("k").agg(F.min("signal").alias("signal"))


def file_signals(files: DataFrame, key: str = "file_id", path: str = "path", text: str = "content", repository: str = "repository") -> DataFrame:
    """(key, signal): generated, minified, vendored, data, page or pointer for files that show it themselves, and generated
    for copies of tools' files, by the fingerprints that recur in many unrelated repositories.

    Null and blank contents and hand-written files have no row; a null path gives no path signal. A file delivered
    twice counts once; under several paths it has the signal that sorts first.
    """
    return _signals(evidence(files, key, path, text, repository)).withColumnRenamed("k", key)


def provenance(files: DataFrame, key: str = "file_id", path: str = "path", text: str = "content", repository: str = "repository") -> DataFrame:
    """(key, signal, recurring): every file with its signal, null for hand-written ones, and whether most of its
    fingerprints recur in many unrelated repositories. Null contents have neither."""
    seen = evidence(files, key, path, text, repository)
    wide = seen.join(widely_copied(seen), "cls", "left_semi").select(F.col("k").alias(key), F.lit(True).alias("wide")).distinct()
    known = files.select(key).distinct()
    return known.join(_signals(seen).withColumnRenamed("k", key), key, "left").join(wide, key, "left").select(key, "signal", F.coalesce("wide", F.lit(False)).alias("recurring"))
