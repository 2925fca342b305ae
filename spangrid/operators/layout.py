"""Lines, boundaries and rendering as array expressions: one row per document in, no shuffle until rows are exploded.

A line ends at LF; a CR before it belongs to the line end. Text that ends in LF has no empty last line, and empty text
has no line. A line is blank when only spaces, tabs and CR are in it. Offsets and lengths are in bytes.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import spread

BLANKS = r"' \t\r'"


#: File ids that may be delivered repeatedly for their numbers to be broadcast, at 16 bytes each.
REPEATED = 2_000_000


def first_delivery(files: DataFrame) -> DataFrame:
    """Each file once, as it came first; rows without content are left out.

    Which ids came repeatedly, and which row of each came first, is found on narrow columns. As long as those are few
    their places are broadcast and the scan drops the other rows, so no text is shuffled; beyond, and where rows have no
    place in a file, files are dealt by id.
    """
    order = Window.partitionBy("file_id").orderBy("ingested_at")
    places = _repeated_places(files)
    if places is None:
        dealt = files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file_id")
        kept = dealt.withColumn("rn", F.row_number().over(order)).where("rn = 1 AND content IS NOT NULL").drop("rn")
    else:
        here = files.withColumn("place", F.xxhash64("_metadata.file_path", "_metadata.row_index"))
        kept = spread(here.join(F.broadcast(places), F.col("file_id") == F.col("repeated_id"), "left").where("content IS NOT NULL AND (repeated_id IS NULL OR place = first_place)").drop("place", "repeated_id", "first_place"))
    return kept.withColumnsRenamed({"file_id": "doc_id", "content": "text"})


def _repeated_places(files: DataFrame) -> DataFrame | None:
    """(repeated_id, first_place) of ids with several rows; None if they are too many, or rows have no place."""
    try:
        narrow = files.select("file_id", F.struct("ingested_at", F.xxhash64("_metadata.file_path", "_metadata.row_index").alias("place")).alias("at"))
    except AnalysisException:
        return None
    several = narrow.groupBy("file_id").agg(F.count("*").alias("n"), F.min("at").alias("at")).where("n > 1 AND file_id IS NOT NULL")
    places = several.select(F.col("file_id").alias("repeated_id"), F.col("at.place").alias("first_place"))
    return places if places.count() <= REPEATED else None


def pieces(text: str = "text") -> Column:
    """Lines as an array of strings, a CR before the LF kept."""
    return F.expr(f"IF(element_at(split({text}, '\\n', -1), -1) = '', slice(split({text}, '\\n', -1), 1, size(split({text}, '\\n', -1)) - 1), split({text}, '\\n', -1))")


def line_structs(text: str = "text") -> Column:
    """Array of (line_no, raw, value, indent, blank)."""
    return F.transform(
        pieces(text),
        lambda raw, n: F.struct(
            n.alias("line_no"),
            raw.alias("raw"),
            F.btrim(raw, F.lit(" \t\r")).alias("value"),
            indent(raw).alias("indent"),
            (F.btrim(raw, F.lit(" \t\r")) == "").alias("blank"),
        ),
    )


def indent(raw: Column) -> Column:
    """Columns of leading white space, a tab counting four."""
    return F.length(F.replace(F.regexp_extract(raw, "^[ \\t]*", 0), F.lit("\t"), F.lit("    ")))


def lines(documents: DataFrame) -> DataFrame:
    """One row per line: doc_id, line_no, raw, value, indent, blank."""
    return documents.select("doc_id", F.explode(line_structs()).alias("l")).select("doc_id", "l.*")


def with_nonblank(documents: DataFrame) -> DataFrame:
    """Adds nb: the nonblank lines of a document in order."""
    return documents.withColumn("nb", F.filter(line_structs(), lambda x: ~x["blank"]))


def nonblank(documents: DataFrame) -> DataFrame:
    """One row per nonblank line with its position among them."""
    return with_nonblank(documents).select("doc_id", F.posexplode("nb").alias("nb_pos", "l")).select("doc_id", "nb_pos", "l.*")


def boundary_structs() -> Column:
    """Array of neighbouring nonblank lines of column nb: boundary_id, l, r, blank_lines, crlf."""
    return F.expr(
        "IF(size(nb) < 2, array(), transform(sequence(0, size(nb) - 2), i -> named_struct("
        "'boundary_id', i, 'l', nb[i], 'r', nb[i + 1], 'blank_lines', nb[i + 1].line_no - nb[i].line_no - 1, 'crlf', endswith(nb[i].raw, '\\r'))))"
    )


def boundaries(documents: DataFrame, *keep: str) -> DataFrame:
    """One row per boundary, on text alone: doc_id, boundary_id, l, r, blank_lines, crlf and the columns asked for."""
    return with_nonblank(documents).select("doc_id", *keep, F.explode(boundary_structs()).alias("b")).select("doc_id", *keep, "b.*")


def rendered(gap_sql: str) -> Column:
    """The text of column nb with new gaps, as SQL over i (boundary number) and own (gap so far); 255 keeps the own gap.

    Line ends are CRLF after lines that had one, else LF; nothing follows the last line.
    """
    own = "(nb[i + 1].line_no - x.line_no - 1)"
    gap = f"IF({gap_sql} = 255, own, {gap_sql})".replace("own", own)
    end = "IF(endswith(x.raw, '\\r'), '\\r\\n', '\\n')"
    return F.expr(f"array_join(transform(nb, (x, i) -> concat(rtrim('\\r', x.raw), IF(i = size(nb) - 1, '', repeat({end}, 1 + CAST({gap} AS INT))))), '')")


def depth(opening: str, closing: str) -> Column:
    """Net depth that a line's raw text adds, on plain text: strings and comments count too."""
    return F.expr(f"length(value) - length(replace(value, '{opening}', '')) - length(value) + length(replace(value, '{closing}', ''))")
