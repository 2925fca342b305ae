"""Corpus preparation: canonical digests, bottom-k sketches, near-duplicate clusters, splits and context owners."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..session import materialise
from . import lexing
from .components import connected_components

SKETCH, SHINGLE, SHARED = 32, 5, 28
# Splits that win over others when near copies or contexts fall into several.
PRIORITY = {"unseen_language": 5, "test": 4, "style_validation": 3, "validation": 3, "style_train": 2, "train": 1, "rejected": 0}


def shown_tokens(text: Column) -> Column:
    """Tokens without white space and line ends."""
    return F.filter(lexing.tokens(text), lambda t: ~t.rlike(r"^[ \t\x0B\f\r\n]"))


def canonical(text: Column) -> Column:
    """SHA-256 over the shown tokens, each after its length in bytes, so that no two token lists meet."""
    return F.sha2(F.array_join(F.transform(shown_tokens(text), lambda t: F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)), ""), 256)


def sketch(tokens: Column) -> Column:
    """The 32 smallest distinct hashes, unsigned, of five tokens in a row; fewer for short texts.

    Token hashes are FNV-1a; a run is the same fold over its hashes, oldest first. Values keep their 64 bits.
    """

    @pandas_udf("array<bigint>")
    def run(values: pd.Series) -> pd.Series:
        from .features import fnv1a

        start, prime = np.uint64(14695981039346656037), np.uint64(1099511628211)
        out = []
        for tokens_ in values:
            h = np.fromiter((fnv1a(t.encode("utf-8", "surrogatepass").decode("latin-1")) for t in tokens_), dtype=np.uint64, count=len(tokens_))
            n = len(h) - SHINGLE + 1
            if n <= 0:
                out.append(np.empty(0, dtype=np.int64))
                continue
            v = np.full(n, start)
            for k in range(SHINGLE):
                v = (v ^ h[k : k + n]) * prime
            out.append(np.unique(v)[:SKETCH].view(np.int64))
        return pd.Series(out, dtype=object)

    return run(tokens)


def fingerprints(documents: DataFrame, *keep: str) -> DataFrame:
    """doc_id, bytes, digest, sketch and the columns asked for; texts that are null are left out."""
    d = documents.where("text IS NOT NULL").select("doc_id", *keep, F.octet_length("text").cast("long").alias("bytes"), canonical(F.col("text")).alias("digest"), shown_tokens(F.col("text")).alias("tokens"))
    return d.select("doc_id", *keep, "bytes", "digest", sketch(F.col("tokens")).alias("sketch"))


def near_pairs(prints: DataFrame) -> DataFrame:
    """(a, b, shared), a < b: different texts of like size whose sketches share at least 28 values.

    Prefix filter: sets of at most 32 that share 28 share one of the first size - 27 values of each, so only those meet
    in the join. Documents with one digest are one class, represented by the smallest id; classes link through digests.
    A hot value is split by the adaptive skew join, nothing is left out.
    """
    reps = prints.groupBy("digest").agg(F.min(F.struct("doc_id", "bytes", "sketch")).alias("r")).select("r.*")
    reps = reps.where(F.size("sketch") >= SHARED)
    heads = reps.select("doc_id", "bytes", F.explode(F.slice("sketch", F.lit(1), F.size("sketch") - SHARED + 1)).alias("value"))
    x, y = heads.alias("x"), heads.alias("y")
    like = F.least("x.bytes", "y.bytes") * 4 >= F.greatest("x.bytes", "y.bytes") * 3
    met = x.join(y, (F.col("x.value") == F.col("y.value")) & (F.col("x.doc_id") < F.col("y.doc_id")) & like).select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).distinct()
    # only pairs that met fetch their sketches
    one, other = (reps.select(F.col("doc_id").alias(k), F.col("sketch").alias(f"sketch_{k}")) for k in "ab")
    counted = met.join(one, "a").join(other, "b").select("a", "b", F.size(F.array_intersect("sketch_a", "sketch_b")).alias("shared"))
    return counted.where(F.col("shared") >= SHARED)


def clusters(prints: DataFrame) -> DataFrame:
    """(doc_id, cluster): documents linked by equal digests or near pairs; the cluster is its smallest id."""
    prints = materialise(prints)
    same = prints.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    member = prints.select("doc_id", "digest").join(same, "digest").select("doc_id", "rep")
    linked = connected_components(near_pairs(prints).select("a", "b"))
    return member.join(linked, member["rep"] == linked["id"], "left").select("doc_id", F.coalesce("component", "rep").alias("cluster"))


def priority(split: Column) -> Column:
    out = F.lit(0)
    for name, rank in PRIORITY.items():
        out = F.when(split == name, rank).otherwise(out)
    return out


def representatives(clustered: DataFrame) -> DataFrame:
    """(cluster, doc_id) of the document with the highest split priority, the smallest id on ties."""
    best = F.min(F.struct((-priority(F.col("split"))).alias("p"), F.col("doc_id")))
    return clustered.groupBy("cluster").agg(best.alias("b")).select("cluster", "b.doc_id")


def assign_split(path_hash: Column, role: Column) -> Column:
    """Split of a file by the role of its source and the hash of its path."""
    bucket = lexing.unsigned_mod(path_hash, 100)
    return F.when(role == "style", F.when(bucket < 20, "style_validation").otherwise("style_train")).when(role == "test", "test").when(role == "unseen", "unseen_language").when(bucket < 15, "validation").otherwise("train")


def context_digests() -> Column:
    """For column nb, the digest of the shown tokens around each boundary: three lines before it to three after."""
    return F.expr(
        "IF(size(nb) < 2, array(), transform(sequence(0, size(nb) - 2), i -> named_struct('boundary_id', i, 'blank_lines', nb[i + 1].line_no - nb[i].line_no - 1, "
        "'digest', sha2(array_join(slice(enc, greatest(i - 3, 0) + 1, least(i + 4, size(nb) - 1) - greatest(i - 3, 0) + 1), ''), 256))))"
    )


def encoded_line(value: Column) -> Column:
    return F.array_join(F.transform(shown_tokens(value), lambda t: F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)), "")


def context_owners(contexts: DataFrame) -> DataFrame:
    """One owner per context digest: the highest split priority, then the first file and boundary."""
    first = F.min(F.struct((-priority(F.col("split"))).alias("p"), "doc_id", "boundary_id"))
    return contexts.groupBy("digest").agg(first.alias("f")).select("digest", "f.doc_id", "f.boundary_id")


def statement_label(structural: Column, left_multi: Column, right_multi: Column, left_kind: Column, right_kind: Column) -> Column:
    """0 at structure, else 1 where a side has several lines or the kinds differ."""
    return F.when(structural, 0).when(left_multi | right_multi | (left_kind != right_kind), 1).otherwise(0)


def safe_path(path: Column) -> Column:
    """A relative path that stays inside its folder."""
    return ~(path.rlike(r"^/|^$|\\|\x00") | path.rlike(r"(^|/)\.\.?(/|$)") | path.rlike("//"))


def rank_in(rows: DataFrame, by: list[str], order: list[str], name: str = "rn") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
