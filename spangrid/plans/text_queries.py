"""Queries over the text of source files: lines, boundaries, tokens, roles, features that plain text decides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bounded, flag, logarithm
from ..operators import layout, lexing, roles
from ..session import table
from .registry import query

# --- SQL building blocks

DOCS = """docs AS (SELECT * RENAME (file_id AS doc_id, content AS text) FROM (
  SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY ingested_at) AS rn FROM source_files) WHERE rn = 1 AND content IS NOT NULL)"""
LINES = (
    DOCS
    + """, cut AS (SELECT doc_id, unnest(parts) AS raw, unnest(range(len(parts))) AS line_no, len(parts) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM docs)),
lines AS (SELECT doc_id, CAST(line_no AS INT) AS line_no, raw, trim(raw, chr(32) || chr(9) || chr(13)) AS value,
  CAST(length(replace(regexp_extract(raw, '^[ \\t]*'), chr(9), '    ')) AS INT) AS indent, trim(raw, chr(32) || chr(9) || chr(13)) = '' AS blank
  FROM cut WHERE NOT (line_no = n - 1 AND raw = ''))"""
)
NONBLANK = LINES + """, nonblank AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS INT) AS nb_pos FROM lines WHERE NOT blank)"""
BOUNDS = (
    NONBLANK
    + """, pairs AS (SELECT doc_id, nb_pos AS boundary_id, value AS lv, raw AS lraw, indent AS li, line_no AS ll,
  lead(value) OVER w AS rv, lead(indent) OVER w AS ri, lead(line_no) OVER w AS rl, lead(raw) OVER w AS rraw FROM nonblank WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
bounds AS (SELECT *, rl - ll - 1 AS blank_lines, suffix(lraw, chr(13)) AS crlf FROM pairs WHERE rv IS NOT NULL)"""
)
TOKEN_RE = r"\r\n|[\r\n]|[ \t\x0B\f]+|[0-9A-Za-z_\x{80}-\x{10FFFF}]+|."
FIRST_WORD = r"coalesce(list_filter(regexp_extract_all({v}, '[0-9A-Za-z_\x{{80}}-\x{{10FFFF}}]+'), lambda w: NOT regexp_full_match(w, '[0-9]+'))[1], '')"
FNV_SQL = """lower(lpad(to_hex(CAST(list_reduce(list_prepend(CAST(14695981039346656037 AS HUGEINT), list_transform(range(strlen({v})), lambda k: CAST(('0x' || substr(hex(encode(translate({v}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))), CAST(2 * k + 1 AS INT), 2)) AS HUGEINT))),
  lambda a, b: (xor(a, b) * 1099511628211) % 18446744073709551616) AS UBIGINT)), 16, '0'))"""


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source file once, with its text."""
    return layout.first_delivery(table(spark, sf_dir, "source_files"))


def bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = layout.boundaries(docs(spark, sf_dir))
    return b.select("doc_id", "boundary_id", "blank_lines", "crlf", F.col("l.value").alias("lv"), F.col("r.value").alias("rv"), F.col("l.indent").alias("li"), F.col("r.indent").alias("ri"), F.col("l.line_no").alias("ll"), F.col("r.line_no").alias("rl"))


# --- layout


@query("lay01_lines", f"WITH {LINES} SELECT doc_id, line_no, md5(raw) AS digest FROM lines")
def lay01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.lines(docs(spark, sf_dir)).select("doc_id", "line_no", F.md5("raw").alias("digest"))


@query("lay03_indent", f"WITH {LINES} SELECT indent, count(*) AS n FROM lines WHERE NOT blank GROUP BY indent")
def lay03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.lines(docs(spark, sf_dir)).where("NOT blank").groupBy("indent").agg(F.count("*").alias("n"))


@query("flt04_blank_lines", f"WITH {LINES} SELECT doc_id, count(*) FILTER (blank) AS blank, count(*) AS n FROM lines GROUP BY doc_id")
def flt04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.lines(docs(spark, sf_dir)).groupBy("doc_id").agg(F.count_if("blank").alias("blank"), F.count("*").alias("n"))


@query("lay05_continued", f"WITH {LINES} SELECT doc_id, line_no FROM lines WHERE suffix(rtrim(raw, chr(32) || chr(9) || chr(13)), '\\')")
def lay05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.lines(docs(spark, sf_dir)).where(F.rtrim(F.col("raw"), F.lit(" \t\r")).endswith("\\")).select("doc_id", "line_no")


@query("lay06_boundaries", f"WITH {BOUNDS} SELECT doc_id, boundary_id, CAST(ll AS INT) AS before_line, CAST(rl AS INT) AS after_line FROM bounds")
def lay06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bounds(spark, sf_dir).select("doc_id", "boundary_id", F.col("ll").alias("before_line"), F.col("rl").alias("after_line"))


@query("lay07_gaps", f"WITH {BOUNDS} SELECT doc_id, boundary_id, CAST(blank_lines AS INT) AS blank_lines FROM bounds")
def lay07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bounds(spark, sf_dir).select("doc_id", "boundary_id", "blank_lines")


@query("lay08_crlf", f"WITH {BOUNDS} SELECT doc_id, bool_or(crlf) AS any_crlf, count(*) FILTER (crlf) AS n FROM bounds GROUP BY doc_id")
def lay08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bounds(spark, sf_dir).groupBy("doc_id").agg(F.bool_or("crlf").alias("any_crlf"), F.count_if("crlf").alias("n"))


@query("jon01_next_line", f"WITH {BOUNDS} SELECT doc_id, boundary_id, md5(lv) AS left_digest, md5(rv) AS right_digest FROM bounds")
def jon01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bounds(spark, sf_dir).select("doc_id", "boundary_id", F.md5("lv").alias("left_digest"), F.md5("rv").alias("right_digest"))


@query("win01_neighbours", f"WITH {NONBLANK} SELECT doc_id, nb_pos, lag(line_no) OVER w AS previous_line, lead(line_no) OVER w AS next_line FROM nonblank WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)")
def win01(spark: SparkSession, sf_dir: str) -> DataFrame:
    nb = layout.with_nonblank(docs(spark, sf_dir))
    rows = nb.select("doc_id", "nb", F.posexplode("nb").alias("nb_pos", "x"))
    return rows.select("doc_id", "nb_pos", F.get("nb", F.col("nb_pos") - 1)["line_no"].alias("previous_line"), F.get("nb", F.col("nb_pos") + 1)["line_no"].alias("next_line"))


@query("win02_nonblank_position", f"WITH {NONBLANK} SELECT doc_id, line_no, nb_pos FROM nonblank")
def win02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.nonblank(docs(spark, sf_dir)).select("doc_id", "line_no", "nb_pos")


_DEPTHS = ", ".join(f"CAST(sum(len(value) - len(replace(value, '{o}', '')) - len(value) + len(replace(value, '{c}', ''))) OVER w AS BIGINT) AS {n}" for o, c, n in ("{}b", "()p", "[]k"))


@query("win03_running_depth", f"WITH {NONBLANK} SELECT doc_id, nb_pos, {_DEPTHS} FROM nonblank WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)")
def win03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running net depth on plain text; a fold over a document's lines needs no window."""
    nb = layout.with_nonblank(docs(spark, sf_dir))
    for name, (o, c) in {"b": "{}", "p": "()", "k": "[]"}.items():
        nb = nb.withColumn(name, F.expr(f"transform(nb, x -> length(replace(x.value, '{c}', '')) - length(replace(x.value, '{o}', '')))"))
    rows = nb.select("doc_id", F.posexplode(F.arrays_zip("b", "p", "k")).alias("nb_pos", "d"))
    w = Window.partitionBy("doc_id").orderBy("nb_pos")
    return rows.select("doc_id", "nb_pos", *(F.sum(f"d.{n}").over(w).alias(n) for n in "bpk"))


def _render_sql(gap: str) -> str:
    """gap over boundary_id and own; the last line has none."""
    return f"""WITH {NONBLANK}, g AS (SELECT doc_id, nb_pos, raw, nb_pos AS boundary_id, lead(line_no) OVER w - line_no - 1 AS own FROM nonblank WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))
SELECT doc_id, md5(string_agg(rtrim(raw, chr(13)) || CASE WHEN own IS NULL THEN '' ELSE repeat(CASE WHEN suffix(raw, chr(13)) THEN chr(13) || chr(10) ELSE chr(10) END, CAST(1 + {gap} AS BIGINT)) END, '' ORDER BY nb_pos)) AS digest FROM g GROUP BY doc_id"""


def _digest(spark: SparkSession, sf_dir: str, gap: str) -> DataFrame:
    nb = layout.with_nonblank(docs(spark, sf_dir)).where(F.size("nb") > 0)
    return nb.select("doc_id", F.md5(layout.rendered(gap)).alias("digest"))


@query("lay10_render_original", _render_sql("own"))
def lay10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every gap kept."""
    return _digest(spark, sf_dir, "255")


@query("lay15_render_dense", _render_sql("0"))
def lay15_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(spark, sf_dir, "0")


@query("lay15_render_cyclic", _render_sql("boundary_id % 3"))
def lay15_cyclic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(spark, sf_dir, "(i % 3)")


@query("lay11_label_bounds", "SELECT gap_label, gap_label > 2 AND gap_label <> 255 AS bad, count(*) AS n FROM boundary_rows GROUP BY ALL")
def lay11(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "boundary_rows")
    return b.groupBy("gap_label", ((F.col("gap_label") > 2) & (F.col("gap_label") != 255)).alias("bad")).agg(F.count("*").alias("n"))


_VALUES = "list_filter(list_transform(string_split({t}, chr(10)), lambda x: trim(x, chr(32) || chr(9) || chr(13))), lambda x: x <> '')"


@query("lay12_preserved", f"SELECT case_id, {_VALUES.format(t='input_text')} = {_VALUES.format(t='output_text')} AS preserved FROM golden_pairs")
def lay12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Golden outputs hold the nonblank lines of their inputs."""
    g = table(spark, sf_dir, "golden_pairs")
    values = {c: F.expr(f"filter(transform(split({c}, '\\n', -1), x -> trim(BOTH ' \\t\\r' FROM x)), x -> x <> '')") for c in ("input_text", "output_text")}
    return g.select("case_id", (values["input_text"] == values["output_text"]).alias("preserved"))


_DENSE = "array_to_string(list_transform(list_filter(string_split({t}, chr(10)), lambda x: trim(x, chr(32) || chr(9) || chr(13)) <> ''), lambda x: x), chr(10))"


@query("lay13_idempotent", f"WITH {DOCS}, o AS (SELECT doc_id, {_DENSE.format(t='text')} AS once FROM docs) SELECT doc_id, {_DENSE.format(t='once')} = once AS idempotent FROM o WHERE once <> ''")
def lay13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense layout of the dense layout is itself."""
    once = layout.with_nonblank(docs(spark, sf_dir)).where(F.size("nb") > 0).select("doc_id", layout.rendered("0").alias("text"))
    twice = layout.with_nonblank(once).select("doc_id", (layout.rendered("0") == F.col("text")).alias("idempotent"))
    return twice


@query("lay17_offset_to_line", f"WITH {LINES}, spot AS (SELECT doc_id, line_no, sum(strlen(raw) + 1) OVER (PARTITION BY doc_id ORDER BY line_no) - strlen(raw) - 1 AS start FROM lines), o AS (SELECT doc_id, strlen(text) // 2 AS off FROM docs) SELECT doc_id, max(line_no) AS line_no FROM spot JOIN o USING (doc_id) WHERE start <= off GROUP BY doc_id")
def lay17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line that holds the middle byte of each file: by a fold over the lengths of its lines, no join."""
    d = docs(spark, sf_dir)
    starts = F.expr("aggregate(ps, named_struct('at', CAST(0 AS BIGINT), 'n', -1), (s, x) -> IF(s.at <= octet_length(text) div 2, named_struct('at', s.at + octet_length(x) + 1, 'n', s.n + 1), s), s -> s.n)")
    return d.withColumn("ps", layout.pieces()).where("size(ps) > 0").select("doc_id", starts.alias("line_no"))


@query("flt02_bare_cr", f"WITH {DOCS} SELECT doc_id, len(text) - len(replace(text, chr(13), '')) > (len(text) - len(replace(text, chr(13) || chr(10), ''))) / 2 AS bare_cr FROM docs")
def flt02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.col("text").rlike(r"\r(?!\n)").alias("bare_cr"))


@query("flt01_valid_utf8", f"WITH {DOCS} SELECT count(*) FILTER (decode(encode(text)) = text) AS valid, count(*) FILTER (decode(encode(text)) <> text) AS invalid FROM docs")
def flt01(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = F.expr("is_valid_utf8(text)")
    return docs(spark, sf_dir).agg(F.count_if(ok).alias("valid"), F.count_if(~ok).alias("invalid"))


# What a tool writes into the head of a file, and the bytes of the head.
HEADER_MARKS = ("DO NOT EDIT", "DO NOT MODIFY", "Code generated", "automatically generated")
HEAD_BYTES = 2048
#: Marks are looked for among bytes, as the head may end amid a character: pairs of hex digits.
HEADER_SQL = f"regexp_matches(hex(array_slice(encode({{t}}), 1, {HEAD_BYTES})), '^(..)*({'|'.join(m.encode().hex().upper() for m in HEADER_MARKS)})')"


def has_header_mark(text: Column) -> Column:
    head = F.substring(F.encode(text, "UTF-8"), 1, HEAD_BYTES)
    hit = F.lit(False)
    for mark in HEADER_MARKS:
        hit = hit | F.contains(head, F.encode(F.lit(mark), "UTF-8"))
    return hit


@query("flt10_generated_header", f"WITH {DOCS} SELECT doc_id FROM docs WHERE {HEADER_SQL.replace('{t}', 'text')}")
def flt10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with a tool's mark, as it is spelt, in the first 2,048 bytes."""
    return docs(spark, sf_dir).where(has_header_mark(F.col("text"))).select("doc_id")


@query("flt11_minimum_boundaries", f"WITH {BOUNDS} SELECT doc_id, count(*) AS boundaries FROM bounds GROUP BY doc_id HAVING count(*) >= 3")
def flt11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the size of the line array: nothing is exploded."""
    return layout.with_nonblank(docs(spark, sf_dir)).select("doc_id", (F.size("nb") - 1).cast("long").alias("boundaries")).where("boundaries >= 3")


# --- lexing


@query("lex01_token_counts", f"WITH {DOCS} SELECT doc_id, len(regexp_extract_all(text, '{TOKEN_RE}')) AS tokens FROM docs")
def lex01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.size(lexing.tokens(F.col("text"))).cast("long").alias("tokens"))


_KIND = r"CASE WHEN regexp_matches(t, '^[\r\n]') THEN 'newline' WHEN regexp_matches(t, '^[ \t\x0B\f]') THEN 'whitespace' WHEN regexp_full_match(t, '[0-9]+') THEN 'number' WHEN regexp_full_match(t, '[0-9A-Za-z_\x{80}-\x{10FFFF}]+') THEN 'word' ELSE 'symbol' END"


@query("lex02_token_kinds", f"WITH {DOCS} SELECT kind, count(*) AS n, CAST(sum(strlen(t)) AS BIGINT) AS bytes FROM (SELECT t, {_KIND} AS kind FROM (SELECT unnest(regexp_extract_all(text, '{TOKEN_RE}')) AS t FROM docs)) GROUP BY kind")
def lex02(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = docs(spark, sf_dir).select(F.explode(lexing.tokens(F.col("text"))).alias("t"))
    return t.groupBy(lexing.kind(F.col("t")).alias("kind")).agg(F.count("*").alias("n"), F.sum(F.octet_length("t")).alias("bytes"))


@query("lex03_word_bytes", f"WITH {DOCS} SELECT doc_id, strlen(regexp_replace(text, '[^0-9A-Za-z_\\x{{80}}-\\x{{10FFFF}}]', '', 'g')) AS word_bytes FROM docs")
def lex03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.octet_length(F.regexp_replace("text", r"[^0-9A-Za-z_\x{80}-\x{10FFFF}]", "")).cast("long").alias("word_bytes"))


@query("lex04_lossless", f"WITH {DOCS} SELECT doc_id, strlen(text) AS bytes, array_to_string(regexp_extract_all(text, '{TOKEN_RE}', 0, 's'), '') = text AS lossless FROM docs")
def lex04(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.array_join(lexing.tokens(F.col("text")), "")
    return docs(spark, sf_dir).select("doc_id", F.octet_length("text").cast("long").alias("bytes"), (t == F.col("text")).alias("lossless"))


@query("lex05_first_words", f"WITH {NONBLANK} SELECT doc_id, nb_pos, {FIRST_WORD.format(v='value')} AS first_word FROM nonblank")
def lex05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.nonblank(docs(spark, sf_dir)).select("doc_id", "nb_pos", lexing.first_word(F.col("value")).alias("first_word"))


@query("lex06_fnv", f"WITH {DOCS}, w AS (SELECT DISTINCT unnest(string_split(path, '/')) AS word FROM docs) SELECT word, {FNV_SQL.format(v='word')} AS hash FROM w")
def lex06(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = docs(spark, sf_dir).select(F.explode(F.split("path", "/")).alias("word")).distinct()
    return w.select("word", F.lower(F.lpad(F.hex(lexing.fnv1a(F.col("word"))), 16, "0")).alias("hash"))


@query("lex08_compact", f"WITH {DOCS} SELECT doc_id, md5(regexp_replace(text, '[ \\t\\r\\n\\x0B\\f]', '', 'g')) AS digest FROM docs")
def lex08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.md5(F.regexp_replace("text", r"[ \t\r\n\x0B\f]", "")).alias("digest"))


@query("lex09_nonblank_text", f"WITH {NONBLANK} SELECT doc_id, md5(string_agg(value, chr(10) ORDER BY nb_pos)) AS digest FROM nonblank GROUP BY doc_id")
def lex09(spark: SparkSession, sf_dir: str) -> DataFrame:
    nb = layout.with_nonblank(docs(spark, sf_dir)).where("size(nb) > 0")
    return nb.select("doc_id", F.md5(F.array_join(F.transform("nb", lambda x: x["value"]), "\n")).alias("digest"))


@query("lex10_excerpt", f"WITH {LINES} SELECT doc_id, md5(string_agg(raw, chr(10) ORDER BY line_no)) AS digest FROM lines WHERE line_no BETWEEN 2 AND 6 GROUP BY doc_id")
def lex10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines 3 to 7, counted from one."""
    d = docs(spark, sf_dir).withColumn("ps", F.slice(layout.pieces(), 3, 5)).where("size(ps) > 0")
    return d.select("doc_id", F.md5(F.array_join("ps", "\n")).alias("digest"))


@query("lex11_crlf", f"WITH {DOCS} SELECT doc_id, strlen(replace(replace(text, chr(13) || chr(10), chr(10)), chr(10), chr(13) || chr(10))) AS bytes FROM docs")
def lex11(spark: SparkSession, sf_dir: str) -> DataFrame:
    lf = F.replace("text", F.lit("\r\n"), F.lit("\n"))
    return docs(spark, sf_dir).select("doc_id", F.octet_length(F.replace(lf, F.lit("\n"), F.lit("\r\n"))).cast("long").alias("bytes"))


@query("rol02_keyword_roles", f"""WITH {NONBLANK}, w AS (SELECT {FIRST_WORD.format(v='value')} AS word FROM nonblank)
SELECT CASE WHEN word IN {roles.EXIT} THEN 'exit' WHEN word IN {roles.CONTROL} THEN 'control' WHEN word IN {roles.BINDING} THEN 'binding' WHEN word IN {roles.NEUTRAL} THEN 'import' ELSE 'none' END AS kind, count(*) AS n FROM w GROUP BY ALL""")
def rol02(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = layout.nonblank(docs(spark, sf_dir)).select(lexing.first_word(F.col("value")).alias("w")).select(
        F.when(F.col("w").isin(*roles.EXIT), "exit").when(F.col("w").isin(*roles.CONTROL), "control").when(F.col("w").isin(*roles.BINDING), "binding").when(F.col("w").isin(*roles.NEUTRAL), "import").otherwise("none").alias("kind")
    )
    return w.groupBy("kind").agg(F.count("*").alias("n"))


@query("rol01_roles", f"WITH {NONBLANK}, {roles.ROLE_SQL} SELECT doc_id, nb_pos, role FROM roles")
def rol01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Role of every nonblank line; rol03 to rol05 are steps of the same fold."""
    return layout.nonblank(docs(spark, sf_dir)).select("doc_id", "nb_pos", roles.role(F.col("value")).alias("role"))


@query("rol05_role_counts", f"WITH {NONBLANK}, {roles.ROLE_SQL} SELECT role, count(*) AS n FROM roles GROUP BY role")
def rol05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rol01(spark, sf_dir).groupBy("role").agg(F.count("*").alias("n"))


# --- feature channels that plain text decides; each with its SQL over (lv, rv, li, ri)


def _clamp(sql: str) -> str:
    return f"greatest(-1.0, least(1.0, {sql}))"


CHANNELS: dict[str, dict[str, tuple[Callable[[], Column], str]]] = {
    "fea01_constant": {"c0": (lambda: F.lit(1.0), "1.0")},
    "fea02_indents": {"c1": (lambda: bounded(F.col("li"), 32), "least(li, 32) / 32.0"), "c2": (lambda: bounded(F.col("ri"), 32), "least(ri, 32) / 32.0")},
    "fea03_indent_change": {"c3": (lambda: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("ri") - F.col("li")) / 16.0)), _clamp("(ri - li) / 16.0")), "c4": (lambda: flag(F.col("li") == F.col("ri")), "CAST(li = ri AS INT)")},
    "fea05_lengths": {"c8": (lambda: logarithm(F.octet_length("lv")), "log2(1 + least(strlen(lv), 1024)) / 10"), "c9": (lambda: logarithm(F.octet_length("rv")), "log2(1 + least(strlen(rv), 1024)) / 10")},
    "fea06_closing_start": {"c10": (lambda: flag(F.substring("lv", 1, 1).isin("}", ")", "]")), "CAST(substr(lv, 1, 1) IN ('}', ')', ']') AS INT)"), "c11": (lambda: flag(F.substring("rv", 1, 1).isin("}", ")", "]")), "CAST(substr(rv, 1, 1) IN ('}', ')', ']') AS INT)")},
    "fea07_opens_block": {"c12": (lambda: flag(F.col("lv").endswith("{") | F.col("lv").endswith(":")), "CAST(suffix(lv, '{') OR suffix(lv, ':') AS INT)"), "c13": (lambda: flag(F.col("rv").endswith("{") | F.col("rv").endswith(":")), "CAST(suffix(rv, '{') OR suffix(rv, ':') AS INT)")},
    "fea08_semicolons": {"c14": (lambda: flag(F.col("lv").endswith(";")), "CAST(suffix(lv, ';') AS INT)"), "c15": (lambda: flag(F.col("rv").endswith(";")), "CAST(suffix(rv, ';') AS INT)")},
    "fea10_same_first_word": {"c18": (lambda: flag(lexing.first_word(F.col("lv")) == lexing.first_word(F.col("rv"))), f"CAST({FIRST_WORD.format(v='lv')} = {FIRST_WORD.format(v='rv')} AS INT)")},
    "fea11_contains": {f"c{n}": (lambda c=c, s=s: flag(F.col(c).contains(s)), f"CAST(contains({c}, '{s}') AS INT)") for n, c, s in ((19, "lv", "("), (20, "rv", "("), (21, "lv", "="), (22, "rv", "="), (28, "lv", ":"), (29, "rv", ":"))},
    "fea12_line_ends": {f"c{n}": (lambda c=c, s=s: flag(F.col(c).endswith(s)), f"CAST(suffix({c}, '{s}') AS INT)") for n, c, s in ((23, "lv", ","), (24, "rv", ","), (30, "lv", "}"), (31, "rv", "}"))},
    "fea13_top_level": {"c25": (lambda: flag(F.col("li") == 0), "CAST(li = 0 AS INT)"), "c26": (lambda: flag(F.col("ri") == 0), "CAST(ri = 0 AS INT)")},
    "fea14_annotation": {"c27": (lambda: flag((F.col("rv").startswith("@") & ~F.col("rv").endswith(";")) | F.col("rv").startswith("#[")), "CAST((prefix(rv, '@') AND NOT suffix(rv, ';')) OR prefix(rv, '#[') AS INT)")},
    "fea24_unused": {f"c{n}": (lambda: F.lit(0.0), "0.0") for n in range(187, 192)},
}


def _channel_query(name: str, channels: dict[str, tuple[Callable[[], Column], str]]) -> None:
    sql = ", ".join(f"round(CAST({s} AS DOUBLE), 6) AS {c}" for c, (_, s) in channels.items())

    @query(name, f"WITH {BOUNDS} SELECT doc_id, boundary_id, {sql} FROM bounds")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return bounds(spark, sf_dir).select("doc_id", "boundary_id", *(F.round(e().cast("double"), 6).alias(c) for c, (e, _) in channels.items()))


for _name, _channels in CHANNELS.items():
    _channel_query(_name, _channels)

# --- the deterministic rule over the channels it reads


RULE_SQL = f"""CASE WHEN substr(rv, 1, 1) IN ('}}', ')', ']') OR suffix(lv, '{{') OR suffix(lv, ':') THEN 0 WHEN prefix(rv, '//') OR prefix(rv, '#') THEN 1
  WHEN {FIRST_WORD.format(v='lv')} = {FIRST_WORD.format(v='rv')} THEN 0 WHEN suffix(lv, '}}') AND li = ri THEN 1 WHEN ri = 0 AND li > 0 THEN 1 ELSE 0 END"""


def rule_of(lv: Column, rv: Column, li: Column, ri: Column) -> Column:
    """0 or 1 by six ordered conditions over two lines and their indents; a comment is taken by its prefix."""
    return (
        F.when(F.substring(rv, 1, 1).isin("}", ")", "]") | lv.endswith("{") | lv.endswith(":"), 0)
        .when(rv.startswith("//") | rv.startswith("#"), 1)
        .when(lexing.first_word(lv) == lexing.first_word(rv), 0)
        .when(lv.endswith("}") & (li == ri), 1)
        .when((ri == 0) & (li > 0), 1)
        .otherwise(0)
    )


def rule() -> Column:
    return rule_of(*map(F.col, ("lv", "rv", "li", "ri")))


@query("mod12_rule", f"WITH {BOUNDS} SELECT blank_lines, {RULE_SQL} AS prediction, count(*) AS n FROM bounds GROUP BY ALL")
def mod12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bounds(spark, sf_dir).groupBy(F.col("blank_lines").cast("long").alias("blank_lines"), rule().alias("prediction")).agg(F.count("*").alias("n"))


@query("flagship_rule_metrics", f"""WITH {BOUNDS}, p AS (SELECT lang, least(blank_lines, 2) AS truth, {RULE_SQL} AS prediction FROM bounds JOIN (SELECT doc_id AS d, lang FROM docs) ON d = doc_id)
SELECT lang, count(*) AS n, round(avg(CAST(truth = prediction AS DOUBLE)), 6) AS accuracy,
 round(coalesce(count(*) FILTER (truth > 0 AND truth = prediction) / nullif(count(*) FILTER (prediction > 0), 0), 0), 6) AS blank_precision,
 round(coalesce(count(*) FILTER (truth > 0 AND truth = prediction) / nullif(count(*) FILTER (truth > 0), 0), 0), 6) AS blank_recall FROM p GROUP BY lang""")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files to lines to boundaries to the rule to metrics per language, in one pass and one small shuffle."""
    b = layout.boundaries(docs(spark, sf_dir), "lang")
    b = b.select("lang", F.least("blank_lines", F.lit(2)).alias("truth"), F.col("l.value").alias("lv"), F.col("r.value").alias("rv"), F.col("l.indent").alias("li"), F.col("r.indent").alias("ri"))
    p = b.select("lang", "truth", rule().alias("prediction"))
    hit = F.count_if((F.col("truth") > 0) & (F.col("truth") == F.col("prediction")))
    return p.groupBy("lang").agg(
        F.count("*").alias("n"),
        F.round(F.avg((F.col("truth") == F.col("prediction")).cast("double")), 6).alias("accuracy"),
        F.round(F.coalesce(F.try_divide(hit, F.count_if(F.col("prediction") > 0)), F.lit(0.0)), 6).alias("blank_precision"),
        F.round(F.coalesce(F.try_divide(hit, F.count_if(F.col("truth") > 0)), F.lit(0.0)), 6).alias("blank_recall"),
    )


_BUCKET = "CAST(('0x' || right({h}, 1)) AS INT)"


@query("fea16_context_buckets", f"""WITH {NONBLANK}, w AS (SELECT doc_id, nb_pos, {FIRST_WORD.format(v='value')} AS word FROM nonblank), h AS (SELECT word, {_BUCKET.format(h=FNV_SQL.format(v='word'))} AS bucket FROM (SELECT DISTINCT word FROM w))
SELECT doc_id, CAST(nb_pos - 1 AS INT) AS boundary_id, 'before' AS side, bucket, 1 AS distance FROM w JOIN h USING (word) WHERE false
UNION ALL SELECT b.doc_id, b.nb_pos, 'before', h.bucket, b.nb_pos - c.nb_pos FROM w b JOIN w c ON c.doc_id = b.doc_id AND c.nb_pos BETWEEN b.nb_pos - 3 AND b.nb_pos - 1 JOIN h ON h.word = c.word WHERE b.nb_pos < (SELECT max(nb_pos) FROM w x WHERE x.doc_id = b.doc_id)
UNION ALL SELECT b.doc_id, b.nb_pos, 'after', h.bucket, c.nb_pos - b.nb_pos - 1 FROM w b JOIN w c ON c.doc_id = b.doc_id AND c.nb_pos BETWEEN b.nb_pos + 2 AND b.nb_pos + 4 JOIN h ON h.word = c.word""")
def fea16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashed first words of the lines up to three before and after a boundary; neighbours come from the line array."""
    nb = layout.with_nonblank(docs(spark, sf_dir)).where("size(nb) >= 2")
    nb = nb.select("doc_id", F.transform("nb", lambda x: lexing.fnv1a(lexing.first_word(x["value"])).bitwiseAND(15).cast("int")).alias("w"))
    near = F.expr(
        "flatten(transform(sequence(0, size(w) - 2), i -> transform(filter(array(-3, -2, -1, 1, 2, 3), d -> IF(d < 0, i + d, i + 1 + d) BETWEEN 0 AND size(w) - 1), "
        "d -> named_struct('boundary_id', i, 'side', IF(d < 0, 'before', 'after'), 'bucket', w[IF(d < 0, i + d, i + 1 + d)], 'distance', abs(d)))))"
    )
    return nb.select("doc_id", F.explode(near).alias("x")).select("doc_id", "x.*")
