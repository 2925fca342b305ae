"""Stream-like behaviours: the latest request wins, late results are dropped, bursts are debounced, files are formatted
as they arrive. Each is a plain transformation that a batch and a stream share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import new_folder


def latest(events: DataFrame) -> DataFrame:
    """The newest event of each user; of events at one time the one with the largest id."""
    newest = F.max(F.struct("ts", "event_id"))
    return events.where("user_id IS NOT NULL").groupBy("user_id").agg(newest.alias("n")).select("user_id", "n.event_id")


def stale_counts(events: DataFrame) -> DataFrame:
    """Per type, events that a newer one of the same user and type has overtaken: all but those at the newest time."""
    per = events.groupBy("user_id", "event_type", "ts").agg(F.count("*").alias("n"))
    newest = per.groupBy("user_id", "event_type").agg(F.sum("n").alias("n"), F.max(F.struct("ts", "n")).alias("last"))
    kept = newest.where("user_id IS NOT NULL")
    return kept.groupBy("event_type").agg(F.sum(F.col("n") - F.col("last.n")).alias("stale"), F.sum("n").alias("n"))


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """Bursts of each user that a pause of at least `gap` ends."""
    bursts = events.where("user_id IS NOT NULL").groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return bursts.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("n"))


def _stream(spark: SparkSession, path: str) -> DataFrame:
    schema = spark.read.parquet(path).schema
    folder, name = path.rsplit("/", 1)
    # a table may be one file or a folder of files; both are found by the glob
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", "4").parquet(f"{folder}/{name}*")


def run_latest(spark: SparkSession, path: str, shared: str) -> DataFrame:
    """latest() by a stream over a table's files: an aggregation in update mode, whose state store holds one row a user.

    Each batch writes the users it changed only; the newest row of each is read from the log of changes at the end.
    """
    base = new_folder(spark, "latest")

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={n}")

    newest = F.max(F.struct("ts", "event_id")).alias("n")
    changed = _stream(spark, path).where("user_id IS NOT NULL").groupBy("user_id").agg(newest)
    changed.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start().awaitTermination()
    log = spark.read.schema("user_id long, n struct<ts: timestamp, event_id: long>, batch int").parquet(f"{base}/out") if _exists(spark, f"{base}/out") else spark.createDataFrame([], "user_id long, n struct<ts: timestamp, event_id: long>")
    return log.groupBy("user_id").agg(F.max("n").alias("n")).select("user_id", "n.event_id")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def run_format(spark: SparkSession, path: str, shared: str) -> DataFrame:
    """Golden inputs formatted as they arrive, into a table."""
    from ..operators.formatting import format_documents

    base = new_folder(spark, "format")

    def write(batch: DataFrame, n: int) -> None:
        docs = batch.select(F.col("case_id").alias("doc_id"), F.col("input_text").alias("text"))
        format_documents(docs).select("doc_id", "changes", "candidates").write.mode("overwrite").parquet(f"{base}/out/batch={n}")

    _stream(spark, path).writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("doc_id long, changes int, candidates int, batch int").parquet(f"{base}/out").select("doc_id", "changes", "candidates")


def windowed_counts(events: DataFrame, window: str = "10 minutes", late: str = "5 minutes") -> DataFrame:
    """Counts per window and type for streams with late rows: rows older than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"))


def fifo(requests: DataFrame, key: str, order: list[str], succeeds: Column) -> DataFrame:
    """Adds place, ok and done: a key's requests in order, whether each succeeds, and how many have so far. A failure is a
    row's own; it neither stops nor delays the rows behind it."""
    w = Window.partitionBy(key).orderBy(*order)
    placed = requests.withColumns({"place": F.row_number().over(w).cast("long"), "ok": succeeds})
    return placed.withColumn("done", F.count_if("ok").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def debounced(events: DataFrame, key: str, time: str, pause: str, holds: Column) -> DataFrame:
    """Rows after which the key is quiet for `pause`, and which stand outside a hold: a row with `holds` true begins one,
    false ends it, null leaves it as it is. The row that ends a hold can fire."""
    w = Window.partitionBy(key).orderBy(time, "event_id")
    marked = events.withColumn("held", F.last(holds, ignorenulls=True).over(w)).withColumn("until", F.lead(time).over(w))
    quiet = F.col("until").isNull() | (F.col("until") >= F.col(time) + F.expr(f"INTERVAL {pause}"))
    return marked.where(quiet & ~F.coalesce("held", F.lit(False))).drop("held", "until")
