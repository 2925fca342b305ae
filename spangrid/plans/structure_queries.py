"""Queries that need a document's regions, units or vectors, the classifier, and streams."""

from __future__ import annotations


import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import features, formatting, guards, model, scanner, units
from ..session import new_folder, shared_dir, table
from ..streaming import events as streams
from .registry import query
from .text_queries import docs


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.scanned_lines(docs(spark, sf_dir))


def _vectors(spark: SparkSession, sf_dir: str, *channels: int) -> DataFrame:
    """Vectors of all boundaries; of the channels named if any are, else of all."""
    return features.boundary_vectors(docs(spark, sf_dir), channels or features.ALL)


@query("lay02_scanned_lines")
def lay02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir)


@query("lay04_depths")
def lay04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delimiter depth after the last line of each file, outside regions."""
    last = F.max_by(F.struct("braces", "parentheses", "brackets"), "line_no")
    return _lines(spark, sf_dir).groupBy("doc_id").agg(last.alias("d")).select("doc_id", "d.*")


@query("lay09_unterminated")
def lay09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with a region open at the end."""
    return _lines(spark, sf_dir).groupBy("doc_id").agg(F.max_by("protected_after", "line_no").alias("open")).where("open").select("doc_id")


@query("lay14_line_literals")
def lay14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).where("protected AND protected_before AND protected_after").select("doc_id", "line_no")


@query("lay16_protected_lines")
def lay16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).groupBy("doc_id").agg(F.count_if("protected").alias("protected"), F.count_if("comment").alias("comments"), F.count("*").alias("lines"))


@query("lay18_tags")
def lay18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that hold at least one complete tag, and how many."""
    d = docs(spark, sf_dir).where(F.col("text").contains("<"))
    return d.select("doc_id", guards.per_text("text", "int", guards.tags).alias("tags")).where("tags > 0")


@query("flt05_eligible_boundaries")
def flt05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundaries that may change, per file; flt06 is the part of the same filter that looks between the lines."""
    return features.eligible_counts(docs(spark, sf_dir))


@query("flt06_protected_gaps")
def flt06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring nonblank lines with a protected line between them."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    seen = _lines(spark, sf_dir).withColumn("upto", F.sum(F.col("protected").cast("int")).over(w))
    nb = seen.where("NOT blank").withColumn("before", F.lag("upto").over(w)).withColumn("previous", F.lag("line_no").over(w))
    return nb.where(F.col("upto") - F.col("protected").cast("int") > F.col("before")).select("doc_id", F.col("previous").alias("left_line"), F.col("line_no").alias("right_line"))


@query("lex07_token_bags")
def lex07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fea15 channels 32 to 95 of every boundary, as the sum and the largest size of each bag."""
    v = _vectors(spark, sf_dir, *range(32, 96))
    left, right = F.slice("input", 33, 32), F.slice("input", 65, 32)
    total = lambda a: F.round(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), 5)
    return v.select("doc_id", "boundary_id", total(left).alias("left_sum"), total(right).alias("right_sum"))


@query("unt01_units")
def unt01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of every file: first and last nonblank line and role. unt02 to unt07 are its steps."""
    schema = "doc_id long, first int, last int, role string"

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for key, text in zip(pdf["doc_id"], pdf["text"]):
                lines = [x for x in scanner.scan(scanner.as_bytes(text))[0] if not x.blank]
                rows += [(key, u.first, u.last, u.role) for u in units.units(lines)[0].values()]
            yield pd.DataFrame(rows, columns=["doc_id", "first", "last", "role"])

    return docs(spark, sf_dir).select("doc_id", "text").mapInPandas(run, schema)


@query("unt03_unit_lengths")
def unt03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unt01(spark, sf_dir).groupBy("role").agg(F.count("*").alias("units"), F.count_if(F.col("last") > F.col("first")).alias("several_lines"), F.max(F.col("last") - F.col("first") + 1).alias("longest"))


def _block(name: str, first: int, last: int) -> None:
    @query(name)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _vectors(spark, sf_dir, *range(first, last + 1)).select("doc_id", "boundary_id", F.slice("input", first + 1, last - first + 1).alias("channels"))


for _name, _first, _last in (
    ("fea04_depth_channels", 5, 7), ("fea09_comment_channels", 16, 17), ("fea15_bag_channels", 32, 95), ("fea17_role_channels", 128, 143), ("fea18_prior_role_channels", 144, 151),
    ("fea19_following_role_channels", 152, 159), ("fea20_unit_role_channels", 160, 175), ("fea21_unit_length_channels", 176, 185), ("fea22_sibling_channels", 178, 183), ("fea23_skipped_comment_channel", 186, 186),
):
    _block(_name, _first, _last)


@query("fea25_layout_invariance")
def fea25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose vectors change when every gap is set to 2; none should."""

    return docs(spark, sf_dir).select("doc_id", guards.per_text("text", "boolean", guards.vectors_move).alias("moved")).groupBy("moved").agg(F.count("*").alias("files"))


def _sample(spark: SparkSession, sf_dir: str, rows_per_label: int = 400) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A bounded training sample: at most rows_per_label boundaries of each label, by hash."""
    v = _vectors(spark, sf_dir).where("blank_lines <= 2")
    w = Window.partitionBy("blank_lines").orderBy(F.xxhash64("doc_id", "boundary_id"))
    got = v.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= rows_per_label).select("input", "blank_lines", (F.col("doc_id") % 12).alias("g")).orderBy("rn", "blank_lines").collect()
    return np.array([r.input for r in got], dtype=np.float64).reshape(len(got), features.WIDTH), np.array([r.blank_lines for r in got], dtype=int), np.array([r.g for r in got])


@query("mod01_scores")
def mod01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logits of a classifier trained here on a bounded sample, for every boundary."""
    x, y, g = _sample(spark, sf_dir)
    fitted, _ = model.train(x, y, g, epochs=4) if len(x) else (model.initial(1), [])
    return _vectors(spark, sf_dir).select("doc_id", "boundary_id", "blank_lines", model.scorer(fitted)("input").alias("logits"))


@query("trn01_training_curve")
def trn01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss of each epoch of training: sampling by language, AdamW, token dropout, early stopping (trn02, trn03, trn06)."""
    x, y, g = _sample(spark, sf_dir)
    _, history = model.train(x, y, g, epochs=6, drop=(slice(32, 128), 0.1)) if len(x) else (None, [])
    return spark.createDataFrame([(n, round(loss, 4)) for n, loss in enumerate(history)], "epoch int, loss double")


@query("lay13_format_rule")
def format_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files formatted by the rule, and whether formatting again changes nothing and nonblank lines stay."""
    return formatting.format_documents(docs(spark, sf_dir)).select("doc_id", "changes", "candidates", "preserved", "idempotent")


@query("evl07_inspection")
def evl07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir, 0).select("doc_id", "boundary_id", "before", "after", "blank_lines", "crlf")


@query("src03_directory_walk")
def src03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a folder by a driver-side walk that keeps names with leading underscores and dots, read in tasks."""
    from ..sources.files import read_directory

    return read_directory(spark, sf_dir, recursive=True, code_only=False, contents=False).select("name")


@query("src15_dataset_round_trip")
def src15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written by snk05 and read again with validation."""
    from ..sources.dataset import read_dataset, write_dataset

    path = new_folder(spark, "dataset")
    v = _vectors(spark, sf_dir).where("blank_lines <= 2")
    rows = v.select(F.col("doc_id").alias("file_id"), "boundary_id", (F.col("doc_id") % 12).cast("int").alias("language_id"), F.col("blank_lines").alias("label"), "input", F.when(F.col("doc_id") % 10 == 0, "validation").otherwise("train").alias("split"))
    write_dataset(rows, path)
    return read_dataset(spark, path).groupBy("split", "label").agg(F.count("*").alias("n"))


@query("snk06_summary")
def snk06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON line of totals."""
    t = _vectors(spark, sf_dir, 0).agg(F.count("*").alias("boundaries"), F.countDistinct("doc_id").alias("files"), F.lit(features.WIDTH).alias("width"))
    return t.select(F.to_json(F.struct("boundaries", "files", "width")).alias("summary"))


@query("snk09_model_round_trip")
def snk09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights written with their shape and a digest, read again and compared."""
    from ..sources.weights import decode, encode

    first = model.initial(3)
    again = decode(encode(first))
    same = all(np.allclose(first[k], again[k], atol=1e-6) for k in first)
    return spark.createDataFrame([(same, int(sum(a.size for a in first.values())))], "same boolean, parameters long")


# --- streams


@query("str01_latest_wins", "SELECT user_id, max_by(event_id, ts) AS event_id FROM events WHERE user_id IS NOT NULL GROUP BY user_id")
def str01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.latest(table(spark, sf_dir, "events"))


@query("str02_late_results", "WITH l AS (SELECT user_id, event_type, max(ts) AS newest FROM events GROUP BY ALL) SELECT e.event_type, count(*) FILTER (e.ts < l.newest) AS stale, count(*) AS n FROM events e JOIN l ON l.user_id = e.user_id AND l.event_type = e.event_type GROUP BY e.event_type")
def str02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.stale_counts(table(spark, sf_dir, "events"))


_HOLDS = "CASE event_type WHEN 'signup' THEN true WHEN 'purchase' THEN false END"


@query("str03_debounce", f"WITH h AS (SELECT event_id, user_id, ts, last_value({_HOLDS} IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS held, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS until FROM events WHERE user_id IS NOT NULL) SELECT event_id, user_id FROM h WHERE (until IS NULL OR until >= ts + INTERVAL 180 MILLISECONDS) AND NOT coalesce(held, false)")
def str03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that a pause of 180 ms follows, outside the stretches that one kind of event opens and another closes, as
    an input method's composition does."""
    holds = F.when(F.col("event_type") == "signup", True).when(F.col("event_type") == "purchase", False)
    return streams.debounced(table(spark, sf_dir, "events").where("user_id IS NOT NULL"), "user_id", "ts", "180 MILLISECONDS", holds).select("event_id", "user_id")


@query("str03_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 1800000000 THEN 0 ELSE 1 END AS fresh FROM events WHERE user_id IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g) SELECT user_id, count(DISTINCT session) AS sessions, count(*) AS n FROM s GROUP BY user_id")
def str03_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.sessions(table(spark, sf_dir, "events"), "30 minutes")


@query("str01_latest_stream")
def str01_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest request of each user by a real stream over the events' files: micro-batches merge into one state table."""
    return streams.run_latest(spark, f"{sf_dir}/events.parquet", shared_dir(spark))


@query("str06_formatted_stream")
def str06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file stream whose micro-batches are formatted by the rule."""
    return streams.run_format(spark, f"{sf_dir}/golden_pairs.parquet", shared_dir(spark))


@query("udf03_format_frame")
def udf03(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "golden_pairs").select(F.col("case_id").alias("doc_id"), F.col("input_text").alias("text"))
    return formatting.format_documents(g).select("doc_id", "text", "changes", "candidates")




