"""Queries of the training-data operators over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise, table
from .canonical import canonical_texts, form_report, look_alike_pairs
from .copies import members
from .mixture import mixture
from .neardup import near_duplicate_groups, similar_pairs
from .overlap import overlapping_classes, united_coverage
from .pieces import oversized_pieces
from .prose import prose_in_code, train_identifier
from .provenance import file_signals, provenance
from .syntax import syntax_rates, syntax_verdicts
from .tokens import token_ids

TRAIN = ("train", "style_train")
HELD_OUT = ("validation", "test", "style_validation", "unseen_language")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "source_files")


def _overlap(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Overlapping text classes, members of the training side, members of the evaluation side, all evaluation files."""
    files, golden = _files(spark, sf_dir), table(spark, sf_dir, "golden_pairs")
    train = files.where(F.col("split").isin(*TRAIN))
    held = files.where(F.col("split").isin(*HELD_OUT))
    records = held.select(F.lit("source_files").alias("eval_table"), F.col("file_id").alias("eval_id"), F.col("split").alias("eval_split"), "content").unionByName(
        golden.select(F.lit("golden_pairs").alias("eval_table"), F.col("case_id").alias("eval_id"), F.col("split").alias("eval_split"), F.col("input_text").alias("content"))
    )
    classes = overlapping_classes(train.select("content"), records.select("content"))
    return classes, train, records, files


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training files and evaluation records that overlap."""
    classes, train, records, _ = _overlap(spark, sf_dir)
    t = members(train, "file_id").select(F.col("cls").alias("t"), F.col("file_id").alias("train_file_id"))
    e = records.select(F.xxhash64("content").alias("e"), "eval_table", "eval_id").distinct()
    return classes.join(t, "t").join(e, "e").select("train_file_id", "eval_table", "eval_id").distinct()


def _overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every overlapping pair of an evaluation record and a training file, with the stretches of the record."""
    classes, train, records, _ = _overlap(spark, sf_dir)
    t = train.where("content is not null").select(F.xxhash64("content").alias("t"), F.col("file_id").alias("train_file_id"), "source_id").distinct()
    e = records.select(F.xxhash64("content").alias("e"), "eval_table", "eval_id", "eval_split").distinct()
    return classes.join(t, "t").join(e, "e")


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per evaluation record and training source: training files that overlap, the most of its runs that one of them
    holds, and the share of its words that they cover together."""
    pairs = materialise(_overlaps(spark, sf_dir))
    by = ["eval_table", "eval_id", "eval_split", "source_id"]
    files = pairs.groupBy(*by).agg(F.countDistinct("train_file_id").alias("train_files"), F.round(F.max("containment"), 6).alias("most_containment"))
    # copies of one text cover the same stretches; a null source is a source
    spans = pairs.select(*by, "t", "words", "spans").dropDuplicates([*by, "t"])
    joined = [files[c].eqNullSafe(F.col(f"u.{c}")) for c in by]
    return files.join(united_coverage(spans, by).alias("u"), joined).select(*(files[c] for c in (*by, "train_files", "most_containment")), F.round("u.coverage", 6).alias("coverage"))


def p1_split_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per evaluation split and training source: overlapping records and training files."""
    record = F.struct("eval_table", "eval_id")
    return _overlaps(spark, sf_dir).groupBy("eval_table", "eval_split", "source_id").agg(F.countDistinct(record).alias("records"), F.countDistinct("train_file_id").alias("train_files"), F.round(F.max("containment"), 6).alias("most_containment"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that a tool wrote, that are minified or copied from another project, or that hold no program text."""
    return file_signals(_files(spark, sf_dir)).select("file_id")


def p2_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file with its signal and whether its fingerprints recur in many repositories."""
    return provenance(_files(spark, sf_dir))


def p3_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages, sentences and share of prose of every file that has any."""
    return prose_in_code(_files(spark, sf_dir), train_identifier(table(spark, sf_dir, "documents")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and the languages their comments and strings hold."""
    return p3_prose(spark, sf_dir).select("file_id", "nl_lang")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that the splitting operator had to cut."""
    return oversized_pieces(_files(spark, sf_dir), table(spark, sf_dir, "size_limits")).select("file_id").distinct()


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of oversized files."""
    return oversized_pieces(_files(spark, sf_dir), table(spark, sf_dir, "size_limits"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with a nonzero repair cost in the language of their extension; how high it is needs no search here."""
    return syntax_verdicts(_files(spark, sf_dir), explain=False).where("not valid").select("file_id").distinct()


def p5_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict, cause and repair cost of every file."""
    v = syntax_verdicts(_files(spark, sf_dir))
    return v.groupBy("file_id").agg(*(F.max(c).alias(c) for c in ("repository", "lang", "ext", "valid", "cause", "cost", "parses_as")))


def p5_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of files that do not parse, per repository and language."""
    return syntax_rates(syntax_verdicts(_files(spark, sf_dir), explain=False))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of files of at least 200 words that share 0.7 of their five-word runs."""
    return similar_pairs(_files(spark, sf_dir), "file_id", 0.7, 200).select(F.col("a").alias("file_id_a"), F.col("b").alias("file_id_b"))


def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per file: text class, group and its files, copies."""
    return near_duplicate_groups(_files(spark, sf_dir), "file_id", 0.7, 200)


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return token_ids(table(spark, sf_dir, "documents"))


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of every document of a listed source."""
    return mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share wanted and share reached of every listed source."""
    return mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that look the same and differ in their characters."""
    return look_alike_pairs(table(spark, sf_dir, "documents")).select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


def p9_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consistent form of every document."""
    return canonical_texts(table(spark, sf_dir, "documents"))


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: what the consistent form changes."""
    return form_report(table(spark, sf_dir, "documents"))


QUERIES = {name: f for name, f in list(globals().items()) if name[0] == "p" and name[1:2].isdigit()}

_DEFAULT_LIMIT = """
SELECT DISTINCT f.file_id FROM source_files f
LEFT JOIN size_limits l ON f.lang = l.lang
CROSS JOIN (SELECT max_bytes FROM size_limits WHERE lang = 'default') d
WHERE strlen(f.content) > coalesce(l.max_bytes, d.max_bytes)"""

ORACLES = {"p4_found": _DEFAULT_LIMIT}
