"""Mixing sources to target weights by pivotal dependent rounding.

Each listed source gets the copies that its share of the total asks for: every record of the source the same rate, whole
copies at once and the rest as a copy probability. Within blocks the probabilities are paired, mass moves at random from
one to the other until one is 0 or 1, and the one left over of each block goes up a reduction tree, so the number of
copies of a source is its expectation rounded, whatever the number of blocks. Neighbours in a block have like sizes,
which keeps the tokens close to their expectation too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .tokens import token_counts

#: Records of a source in one block, and blocks that one step of the tree combines.
BLOCK, FAN_IN = 20_000, 64
_SCHEMA = "source string, doc_id long, n_tokens long, base int, p double, coin double, extra int, block long"
_ARROW = pa.schema([("source", pa.string()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("base", pa.int32()), ("p", pa.float64()), ("coin", pa.float64()), ("extra", pa.int32()), ("block", pa.int64())])
_EPS = 1e-9


def pivot(probabilities: list[float], coins: list[float]) -> tuple[list[int | None], int | None, float]:
    """(taken, left, mass): 0 or 1 for each unit but the one left over, whose index and probability come too."""
    taken: list[int | None] = [None] * len(probabilities)
    left, mass = None, 0.0
    for k, (p, coin) in enumerate(zip(probabilities, coins)):
        if p <= _EPS or p >= 1 - _EPS:
            taken[k] = int(p > 0.5)
            continue
        if left is None:
            left, mass = k, p
            continue
        total = mass + p
        if total <= 1:
            # one of the two gives all it has to the other
            if coin * total < p:
                taken[left], left = 0, k
            else:
                taken[k] = 0
            mass = total
        else:
            # one of the two is filled up by the other
            if coin * (2 - total) < 1 - p:
                taken[left], left = 1, k
            else:
                taken[k] = 1
            mass = total - 1
        if mass <= _EPS or mass >= 1 - _EPS:
            taken[left], left = int(mass > 0.5), None
    return taken, left, mass


def _round_block(table: pa.Table) -> pa.Table:
    table = table.sort_by([("n_tokens", "ascending"), ("doc_id", "ascending")])
    taken, left, mass = pivot(table["p"].to_pylist(), table["coin"].to_pylist())
    p = table["p"].to_pylist()
    if left is not None:
        p[left] = mass
    cols = {name: table[name] for name in _ARROW.names} | {"p": pa.array(p, pa.float64()), "extra": pa.array(taken, pa.int32())}
    return pa.table(cols, schema=_ARROW)


def source_plan(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """One row per listed source: what it holds, what it should give, and the copies per record that give it.

    total_tokens is the size of a mixture in which every listed source gives its share. By default it is the largest at
    which no source that occurs is held back by its max_repeats, so that their shares stand to one another as asked. Of a
    larger size a source gives its share or all it can; what it lacks is not handed to others. A source that does not
    occur, or may not be used, gives nothing and bounds nothing.
    """
    held = sized.groupBy("source").agg(F.sum("n_tokens").alias("held_tokens"), F.count_if(F.col("n_tokens") > 0).alias("held_docs"))
    wanted = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    listed = wanted.join(held, "source", "left").fillna(0, ["held_tokens", "held_docs", "max_repeats"]).fillna(0.0, ["target_share"])
    most = F.col("held_tokens") * F.col("max_repeats")
    bound = F.when((most > 0) & (F.col("target_share") > 0), most / F.col("target_share"))
    # one row of totals
    size = listed.agg((F.lit(float(total_tokens)) if total_tokens is not None else F.coalesce(F.min(bound), F.lit(0.0))).alias("size"))
    rate = F.when(F.col("held_tokens") > 0, F.least(F.col("max_repeats").cast("double"), F.col("wanted_tokens") / F.col("held_tokens"))).otherwise(0.0)
    return listed.join(F.broadcast(size)).withColumn("wanted_tokens", F.col("target_share") * F.col("size")).withColumn("rate", rate).drop("size")


def mixture(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 17, path: str | None = None, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(records, shares).

    records: doc_id, source, n_tokens, copies of every record of a listed source, copies 0 included. Records without a
    source, with an unlisted source, or with a null or empty text (no tokens) are not in it. shares: one row per listed
    source with the share wanted, the share reached, and the tokens wanted and lacking.
    """
    keyed = documents.where("source is not null").select(F.struct("doc_id", "source").alias("doc"), "text")
    counted = token_counts(keyed.where("text is not null"), "doc", "text", path).select("doc.doc_id", "doc.source", "n_tokens")
    sized = materialise(counted.where("n_tokens > 0").dropDuplicates(["doc_id", "source"]))
    plan = materialise(source_plan(sized, targets, total_tokens))
    rows = sized.join(F.broadcast(plan.select("source", "rate", "held_docs")), "source")
    coin = (F.xxhash64(F.lit(seed), "doc_id").bitwiseAND((1 << 53) - 1).cast("double") + 0.5) / float(1 << 53)
    blocks = F.greatest(F.lit(1), F.ceil(F.col("held_docs") / F.lit(block)))
    start = rows.select(
        "source", "doc_id", "n_tokens", F.floor("rate").cast("int").alias("base"), (F.col("rate") - F.floor("rate")).alias("p"), coin.alias("coin"), F.lit(None).cast("int").alias("extra"),
        F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), blocks).alias("block"),
    )
    most = plan.agg(F.max(F.ceil(F.col("held_docs") / F.lit(block)))).first()[0] or 1
    done, now = [], start
    for level in range(1 + max(0, math.ceil(math.log(max(1, most), FAN_IN)))):
        rounded = materialise(now.groupBy("source", "block").applyInArrow(_round_block, _SCHEMA))
        done.append(rounded.where("extra is not null"))
        now = rounded.where("extra is null").withColumn("block", F.floor(F.col("block") / FAN_IN))
        # what is left of a source falls into one block at last, as block numbers shrink by FAN_IN a level
    last = now.withColumn("extra", (F.col("coin") < F.col("p")).cast("int"))
    out = last
    for part in done:
        out = out.unionByName(part)
    records = materialise(out.select("doc_id", "source", "n_tokens", (F.col("base") + F.col("extra")).alias("copies")))
    got = records.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.sum("copies").alias("copies"), F.max("copies").alias("most_copies"))
    shares = plan.join(got, "source", "left").fillna(0, ["tokens", "copies", "most_copies"])
    total = shares.agg(F.sum("tokens").alias("mixture_tokens"))
    reached = F.when(F.col("mixture_tokens") > 0, F.col("tokens") / F.col("mixture_tokens")).otherwise(0.0)
    shares = shares.join(F.broadcast(total)).select(
        "source", "target_share", reached.alias("reached_share"), "max_repeats", "most_copies", "held_docs", "held_tokens", "copies", "tokens",
        F.round("wanted_tokens", 3).alias("wanted_tokens"), F.round(F.greatest(F.col("wanted_tokens") - F.col("tokens"), F.lit(0.0)), 3).alias("lacking_tokens"),
    )
    return records, shares
