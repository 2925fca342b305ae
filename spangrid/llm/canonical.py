"""One consistent form of texts that look the same.

Every Arrow partition is handed to an in-process DuckDB, whose SQL removes invisible characters, maps wide forms,
joined letters, spaces and look-alike letters, and composes accents. Case, accents present or absent, raised digits,
mathematical letters and emoji are kept as they are.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise, spread

# Cyrillic and Greek letters drawn like Latin ones, each over the Latin letter.
LOOK_ALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h",
    "ԛ": "q", "ԝ": "w", "ԁ": "d", "ӏ": "l", "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O",
    "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W",
    "Ӏ": "I", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j", "Ϲ": "C",
}
# Cyrillic letters drawn like Greek ones that have no Latin twin, and rarer letters drawn like Latin ones.
LOOK_ALIKES |= {"Г": "Γ", "П": "Π", "Ф": "Φ", "Ѵ": "V", "ѵ": "v", "Ԍ": "G", "Ϳ": "J"}
# Joined letters over the letters they join.
JOINED = {
    "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "ſt", "ﬆ": "st", "Ĳ": "IJ", "ĳ": "ij", "Ǆ": "DŽ", "ǅ": "Dž", "ǆ": "dž", "Ǉ": "LJ", "ǈ": "Lj", "ǉ": "lj", "Ǌ": "NJ", "ǋ": "Nj", "ǌ": "nj",
    "Ǳ": "DZ", "ǲ": "Dz", "ǳ": "dz", "ﬓ": "մն", "ﬔ": "մե", "ﬕ": "մի", "ﬖ": "վն", "ﬗ": "մխ",
}
# Wide signs outside the block that follows ASCII.
WIDE_SIGNS = {"￠": "¢", "￡": "£", "￢": "¬", "￣": "¯", "￤": "¦", "￥": "¥", "￦": "₩"}
# Characters that never show, in regular-expression form: soft hyphen, grapheme joiner, Mongolian vowel
# separator, zero-width space, direction marks, left-to-right embeddings and isolates and their ends, word joiner and
# invisible operators, shaping controls, byte order mark. What turns the direction round changes the look and stays.
INVISIBLE = r"[\x{00AD}\x{034F}\x{061C}\x{180E}\x{200B}\x{200E}\x{200F}\x{202A}\x{202C}\x{2060}-\x{2064}\x{2066}\x{2068}-\x{206F}\x{FEFF}]+"
# Zero-width (non-)joiners change nothing after scripts whose letters do not join; after emoji, Arabic or Indic
# letters they stay.
JOINERS = r"(^|[\x{0000}-\x{052F}\x{10A0}-\x{10FF}\x{1100}-\x{11FF}\x{1E00}-\x{1FFF}\x{2000}-\x{200B}\x{200E}-\x{206F}\x{3000}-\x{D7FF}\x{F900}-\x{FAFF}\x{FB00}-\x{FB06}\x{FF00}-\x{FFEF}])[\x{200C}\x{200D}]+"


def _table() -> tuple[str, str]:
    """Source and target characters of one translate: wide forms, spaces, look-alikes with and without accents."""
    pairs = {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | WIDE_SIGNS
    pairs |= {chr(c): " " for c in range(0x80, 0x10000) if unicodedata.category(chr(c)) == "Zs"}
    pairs |= {c: same for c, same in _accented().items() if len(same) == 1}
    return "".join(pairs), "".join(pairs.values())


def _accented() -> dict[str, str]:
    """Greek and Cyrillic letters, with accents or without, over what looks the same."""
    out = {}
    for c in (*range(0x370, 0x530), *range(0x1F00, 0x2000)):
        base, *marks = unicodedata.normalize("NFD", chr(c))
        if base in LOOK_ALIKES:
            out[chr(c)] = unicodedata.normalize("NFC", LOOK_ALIKES[base] + "".join(marks))
    return out


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def canonical_sql(column: str, source: str) -> str:
    """The SQL that one Arrow partition runs; `doc` is passed through."""
    text = f"regexp_replace(regexp_replace({column}, '{INVISIBLE}', '', 'g'), '{JOINERS}', '\\1', 'g')"
    for joined, letters in JOINED.items():
        text = f"replace({text}, {_quoted(joined)}, {_quoted(letters)})"
    old, new = _table()
    text = f"translate(nfc_normalize({text}), {_quoted(old)}, {_quoted(new)})"
    # letters whose twin has no form with those accents in one character; few texts hold any
    apart = {c: same for c, same in _accented().items() if len(same) > 1}
    spread_out = "form"
    for letter, same in apart.items():
        spread_out = f"replace({spread_out}, {_quoted(letter)}, {_quoted(same)})"
    some = f"CASE WHEN regexp_matches(form, '[{''.join(apart)}]') THEN {spread_out} ELSE form END"
    return f"SELECT doc, nfc_normalize({some}) AS canonical FROM (SELECT doc, {text} AS form FROM {source})"


def _run(sql: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "512MB"})
        for batch in batches:
            con.register("part", pa.Table.from_batches([batch]))
            out = con.sql(sql).to_arrow_table() if hasattr(con.sql("SELECT 1"), "to_arrow_table") else con.sql(sql).arrow()
            yield from out.cast(pa.schema([("doc", batch.schema.field(0).type), ("canonical", pa.string())])).to_batches()
            con.unregister("part")
        con.close()

    return run


def canonical_texts(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, canonical) of every row; a null text has a null form, an empty text the empty form.

    A text of invisible characters only becomes empty. Repeated rows come out as often as they came in.
    """
    kind = documents.schema[key].dataType.simpleString()
    rows = spread(documents.select(F.col(key).alias("doc"), F.col(text).alias("text")))
    return rows.mapInArrow(_run(canonical_sql("text", "part")), f"doc {kind}, canonical string").withColumnRenamed("doc", key)


def look_alike_pairs(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(a, b): records, a < b, whose texts differ but have one canonical form.

    Null and blank texts are no case. Only forms that hold at least two different texts are joined, and equal texts
    are never paired with each other.
    """
    kind = documents.schema[key].dataType.simpleString()
    shown = documents.where(F.col(text).rlike(r"(?U)\S")).select(F.struct(F.col(key).alias("k"), F.md5(text).alias("own")).alias("doc"), F.col(text).alias("text"))
    forms = spread(shown).mapInArrow(_run(canonical_sql("text", "part")), f"doc struct<k:{kind},own:string>, canonical string")
    # an invisible-only text has an empty form, which is blank too
    rows = materialise(forms.where(F.col("canonical").rlike(r"(?U)\S")).select("doc.k", "doc.own", F.md5("canonical").alias("form")).distinct())
    mixed = rows.groupBy("form").agg(F.min("own").alias("lo"), F.max("own").alias("hi")).where("lo < hi").select("form")
    few = rows.join(mixed, "form", "left_semi")
    x, y = few.alias("x"), few.alias("y")
    return x.join(y, (F.col("x.form") == F.col("y.form")) & (F.col("x.k") < F.col("y.k")) & (F.col("x.own") != F.col("y.own"))).select(F.col("x.k").alias("a"), F.col("y.k").alias("b")).distinct()


def form_report(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Per source: texts, texts that the canonical form changes, and distinct texts before and after."""
    kind = documents.schema[key].dataType.simpleString()
    rows = documents.where(F.col(text).isNotNull()).select(F.struct(F.col(key).alias("k"), F.col(source).alias("source"), F.md5(text).alias("own")).alias("doc"), F.col(text).alias("text"))
    forms = spread(rows).mapInArrow(_run(canonical_sql("text", "part")), f"doc struct<k:{kind},source:string,own:string>, canonical string")
    kept = forms.select("doc.source", "doc.own", F.md5("canonical").alias("form"))
    return kept.groupBy("source").agg(F.count("*").alias("texts"), F.count_if(F.col("own") != F.col("form")).alias("changed"), F.countDistinct("own").alias("distinct_before"), F.countDistinct("form").alias("distinct_after"))
