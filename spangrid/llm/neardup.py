"""Near-duplicate records with small edits.

SuperMinHash signatures over the set of five-word runs are cut into bands; records that share a band become candidates,
the exact Jaccard similarity of their run sets decides, and union-find grouping (connected components) makes groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import materialise, spread
from .arrow import long_lists, slices
from .copies import members, text_class, texts_of
from .shingles import run_hashes, run_set, shared, word_hashes
from .superminhash import band_keys, signature

#: 32 bands of 4 registers: a pair at similarity 0.7 is missed with probability below 0.0002, at 0.8 below 1e-7.
BANDS, ROWS = 32, 4


def _bands(min_words: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches):
            keep, keys = [], []
            for cls, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text is None or cls in seen:
                    continue
                words = word_hashes(text)
                if len(words) < min_words:
                    continue
                seen.add(cls)
                runs = np.unique(run_hashes(words))
                if not len(runs):
                    continue
                keep.append(cls)
                keys.append(band_keys(signature(runs, bands * rows), rows))
            yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int64()), long_lists(keys)], ["cls", "bands"])

    return run


def _jaccard(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_set = None, None
        for batch in slices(batches):
            a, b, text_a, text_b = (batch.column(k).to_pylist() for k in range(4))
            out: list[tuple[int, int, float]] = []
            for x, y, s, t in zip(a, b, text_a, text_b):
                if last != s:
                    last, last_set = s, run_set(s)
                other = run_set(t)
                both = shared(last_set, other)
                either = len(last_set) + len(other) - both
                if either and both >= threshold * either:
                    out.append((x, y, both / either))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.float64())], ["a", "b", "similarity"])

    return run


def signed_classes(records: DataFrame, min_words: int, text: str = "content", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(cls, bands): band keys of every text with at least min_words words, each text once or a few times."""
    source = spread(records.select(F.col(text).alias("content"))).select(text_class().alias("cls"), "content")
    return materialise(source.mapInArrow(_bands(min_words, bands, rows), "cls long, bands array<long>"))


def _verified(pairs: DataFrame, records: DataFrame, threshold: float, text: str) -> DataFrame:
    """(a, b, similarity) of those candidate pairs (a, b) of text classes whose run sets reach the threshold."""
    wanted = pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct()
    texts = texts_of(records, wanted, text)
    both = pairs.join(texts.withColumnsRenamed({"cls": "a", "text": "text_a"}), "a").join(texts.withColumnsRenamed({"cls": "b", "text": "text_b"}), "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(_jaccard(threshold), "a long, b long, similarity double").groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def similar_classes(records: DataFrame, signed: DataFrame, threshold: float, text: str = "content") -> DataFrame:
    """(a, b, similarity): pairs of text classes, a < b, whose run sets reach the threshold.

    A band that many classes share is split over tasks by the adaptive skew join; its pairs collapse before they are
    shuffled.
    """
    banded = signed.select("cls", F.explode("bands").alias("band"))
    pairs = materialise(
        banded.alias("x")
        .join(banded.alias("y"), (F.col("x.band") == F.col("y.band")) & (F.col("x.cls") < F.col("y.cls")))
        .select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b"))
        .distinct()
    )
    return _verified(pairs, records, threshold, text)


def star_links(records: DataFrame, signed: DataFrame, threshold: float, text: str = "content") -> DataFrame:
    """(a, b): enough of the pairs of similar_classes to have the same connected components, without all pairs of a band.

    Every class of a band is held against the band's smallest; two that both reach the threshold with it are linked
    through it. One that does not is held against all classes of the band, so no pair that could link is left out.
    """
    banded = materialise(signed.select("cls", F.explode("bands").alias("band")).distinct())
    centres = banded.groupBy("band").agg(F.min("cls").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    spokes = banded.join(centres, "band").where("cls <> a").select("band", "a", F.col("cls").alias("b"))
    near = materialise(_verified(materialise(spokes.select("a", "b").distinct()), records, threshold, text).select("a", "b"))
    apart = spokes.join(near, ["a", "b"], "left_anti").select("band", F.col("b").alias("x"), "a")
    # the centre itself has been tried
    others = apart.join(banded, "band").where("cls <> x AND cls <> a")
    rest = others.select(F.least("x", "cls").alias("a"), F.greatest("x", "cls").alias("b")).distinct()
    return near.unionByName(_verified(materialise(rest), records, threshold, text).select("a", "b")).distinct()


def similar_pairs(records: DataFrame, key: str = "file_id", threshold: float = 0.7, min_words: int = 200, text: str = "content") -> DataFrame:
    """(a, b): all pairs of records, a < b, at or above the threshold; copies are expanded.

    Null texts and texts of fewer than min_words words (or fewer than five) have no partner. A record delivered twice
    counts once.
    """
    signed = signed_classes(records, min_words, text)
    classes = similar_classes(records, signed, threshold, text)
    own = members(records.where(F.col(text).isNotNull()), key, text)
    left, right = own.select(F.col("cls").alias("a"), F.col(key).alias("ka")), own.select(F.col("cls").alias("b"), F.col(key).alias("kb"))
    across = classes.select("a", "b").join(left, "a").join(right, "b").where("ka != kb")
    # a class of one record has no copies to expand
    several = own.groupBy("cls").agg(F.count("*").alias("n")).where("n > 1").join(signed.select("cls"), "cls", "left_semi").select(F.col("cls").alias("a"))
    copies = left.join(several, "a", "left_semi").join(right, (F.col("a") == F.col("b")) & (F.col("ka") < F.col("kb")))
    out = across.select("ka", "kb").union(copies.select("ka", "kb"))
    return out.select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b")).distinct()


def near_duplicate_groups(records: DataFrame, key: str = "file_id", threshold: float = 0.8, min_words: int = 5, text: str = "content") -> DataFrame:
    """One row per record: its text class, its group (smallest class linked to it), the records of its group and the
    copies of its text.

    Columns: key, cls, group_cls, group_records, copies (other records with the same text). A null text is a record
    without class, group or copies, of a group of none. A record delivered twice counts once.
    """
    links = star_links(records, signed_classes(records, min_words, text), threshold, text)
    groups = connected_components(links)
    own = materialise(records.select(F.col(key), F.when(F.col(text).isNotNull(), text_class(text)).alias("cls")).distinct())
    sizes = own.where("cls is not null").groupBy("cls").agg(F.count("*").alias("n"))
    info = sizes.join(groups.withColumnsRenamed({"id": "cls", "component": "group_cls"}), "cls", "left").withColumn("group_cls", F.coalesce("group_cls", "cls"))
    whole = info.groupBy("group_cls").agg(F.sum("n").alias("group_records"))
    info = info.join(whole, "group_cls").select("cls", "group_cls", "group_records", (F.col("n") - 1).alias("copies"))
    return own.join(info, "cls", "left").select(key, "cls", "group_cls", F.coalesce("group_records", F.lit(0)).alias("group_records"), F.coalesce("copies", F.lit(0)).alias("copies"))
