"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step. Partial aggregation keeps a hub of any degree to one minimum per map task."""
    if large:
        near = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = near.join(least, "u")
    if large:
        linked = linked.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        own = least.select("u", F.col("m").alias("v"))
        linked = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(own)
    return linked.where(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(id, component) of every end of an edge; the component is the smallest id in it.

    edges has two columns of the same type, in any direction, with repeats and loops allowed; null ends are dropped.
    An id that occurs only in loops is its own component. Each round is cut into the shared folder, so a lost
    executor never replays the rounds before. Raises if the labels have not settled after max_rounds.
    """
    u, v = edges.columns[:2]
    edges = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).dropna()
    ids = edges.select("u").union(edges.select("v")).distinct()
    now = cut(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    for _ in range(max_rounds):
        now = cut(_stars(_stars(now, True), False))
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == tuple(seen):
            break
        mark = tuple(seen)
    else:
        raise RuntimeError("components did not settle")
    labels = now.groupBy("u").agg(F.min("v").alias("component"))
    return ids.join(labels, "u", "left").select(F.col("u").alias("id"), F.coalesce("component", "u").alias("component"))
