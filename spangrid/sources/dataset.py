"""Training rows as Parquet, one folder per split, with the checks that a reader of packed rows makes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "file_id long, boundary_id int, language_id int, label int, input array<float>, split string"
WIDTH, LANGUAGES = 192, 12


def write_dataset(rows: DataFrame, path: str) -> None:
    rows.select("file_id", "boundary_id", "language_id", "label", "input", "split").write.mode("overwrite").partitionBy("split").parquet(path)


def bad_rows(rows: DataFrame) -> DataFrame:
    """Rows with a wrong width, label or language, or with a value that is not finite."""
    finite = F.forall("input", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where((F.size("input") != WIDTH) | ~F.col("label").between(0, 2) | ~F.col("language_id").between(0, LANGUAGES - 1) | ~finite)


def read_dataset(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    rows = spark.read.schema(SCHEMA).parquet(path)
    if check and not bad_rows(rows).isEmpty():
        raise ValueError("the dataset holds invalid rows")
    return rows
