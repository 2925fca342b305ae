"""Global ranks without gathering rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise, parallelism


def global_rank(rows: DataFrame, by: str, name: str = "rank") -> DataFrame:
    """Adds the 1-based rank in ascending order of a column.

    Rows are dealt into ranges of the column, ranked within each range, and shifted by the sizes of the ranges before;
    only those sizes, one row a range, come together. Ties rank in no fixed order among themselves.
    """
    n = max(parallelism(rows.sparkSession), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = materialise(rows.repartitionByRange(n, by).withColumn("range", F.spark_partition_id()))
    within = dealt.withColumn("at", F.row_number().over(Window.partitionBy("range").orderBy(by)))
    sizes = dealt.groupBy("range").agg(F.count("*").alias("size"))
    before = sizes.select("range", (F.sum("size").over(Window.orderBy("range")) - F.col("size")).alias("before"))
    return within.join(F.broadcast(before), "range").withColumn(name, (F.col("before") + F.col("at")).cast("long")).drop("range", "at", "before")


def nearest_ranks(rows: DataFrame, group: str, value: str, shares: dict[str, int]) -> DataFrame:
    """group and, for each name in shares, the value at place n * share // 100 (0-based) of the group's n sorted values.

    Equal values are counted first. What is left is dealt by ranges of (group, value), so a group of any size is spread
    over tasks: each range counts its own, and the counts of the ranges before it, one row a range and group, are added.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
    n = max(parallelism(rows.sparkSession), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = materialise(counted.repartitionByRange(n, group, value).withColumn("range", F.spark_partition_id()))
    sums = dealt.groupBy(group, "range").agg(F.sum("n").alias("held"))
    whole = Window.partitionBy(group)
    before = F.coalesce(F.sum("held").over(whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # at most one row a range and group
    starts = sums.select(group, "range", before.alias("before"), F.sum("held").over(whole).alias("total"))
    own = F.sum("n").over(Window.partitionBy(group, "range").orderBy(value))
    placed = dealt.withColumn("own", own).join(starts, [group, "range"])
    upto = F.col("before") + F.col("own")
    return placed.groupBy(group).agg(*(F.min(F.when(upto > F.floor(F.col("total") * share / 100), F.col(value))).alias(name) for name, share in shares.items()))
