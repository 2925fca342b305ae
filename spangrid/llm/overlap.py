"""Same or near-same records across splits.

Both sides send the minima of their rolling five-word hashes: training records all that lie under a fixed cut, evaluation
records as many of the smallest as a partner cannot lack altogether. That is winnowing with the whole record as its window:
with a window of a few words no number of shared minima follows from a share of the runs, with the whole record one does.
Joined minima make candidates, whose seeds are chained in order on both sides and extended word by word, which gives the
coverage of the evaluation record; the share of its five-word runs that the training record holds decides.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise, spread
from .arrow import long_lists, slices
from .copies import text_class, texts_of
from .shingles import RUN, run_hashes, shared, word_hashes

#: Hashes under this share of their range are minima. Above 1 - threshold, so that the minima of all but few evaluation
#: records outnumber the runs that a partner may lack (of those few the hashes above it are joined too), and by as many
#: again, so that half of a record's minima must be shared and the commonest half can be left out of the join.
CUT = 0.6
#: Bits of a hash that are dropped before it is shuffled; a chance meeting costs an exact check and loses nothing.
SHORTER = 16
#: The most common minima of the evaluation records, at most so many, that are left out of the join first, and how many
#: others a partner must share at least where some are left out.
HOT, NEEDED = 262_144, 4
#: Minima that a task holds at once to count the common ones.
COUNTED = 4_000_000
#: Hashes above the cut that are sent to every worker; beyond it they are joined by a shuffle.
LATE = 1_000_000


def _wanted(distinct: int, threshold: float) -> int:
    """The least whole number of shared runs that reaches the threshold."""
    return max(1, math.ceil(threshold * distinct - 1e-9))


def _minima(distinct: np.ndarray, cut: float) -> tuple[np.ndarray, np.ndarray]:
    """Ascending run hashes below and above the cut, shortened."""
    at = int(np.searchsorted(distinct, np.uint64(int(cut * 2**64)))) if cut < 1 else len(distinct)
    short = distinct >> np.uint64(SHORTER)
    return np.unique(short[:at]), np.unique(short[at:])


def _train_minima(cut: float, sought: np.ndarray | None = None, above: bool = False):
    """t, its number of distinct runs, and its minima with those sought above the cut, or all that are above it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in slices(batches):
            classes, sizes, prints = [], [], []
            for cls, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text is None or cls in done:
                    continue
                done.add(cls)
                distinct = np.unique(run_hashes(word_hashes(text)))
                low, high = _minima(distinct, cut)
                sent = high if above else low
                if sought is not None and len(sought):
                    sent = np.concatenate([low, high[np.isin(high, sought)]])
                if len(sent):
                    classes.append(cls)
                    sizes.append(len(distinct))
                    prints.append(sent)
            yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), pa.array(sizes, pa.int32()), long_lists(prints)], ["t", "size", "prints"])

    return run


def _record_minima(min_words: int, threshold: float, cut: float):
    """e, wanted (runs a partner shares), least (minima it shares), its minima, and its other hashes if its minima can't tell.

    A partner shares `wanted` of a record's m runs, so it lacks m - wanted at most, and of any k of the runs it shares
    k - (m - wanted) or more: `least`. Where that is none of those under the cut, the record sends all its runs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in slices(batches):
            classes, wanted, least, prints, more = [], [], [], [], []
            for cls, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text is None or cls in done:
                    continue
                words = word_hashes(text)
                distinct = np.unique(run_hashes(words))
                if len(words) < min_words or not len(distinct):
                    continue
                done.add(cls)
                low, high = _minima(distinct, cut)
                # shortened hashes may coincide, which only lowers what is asked for
                want = _wanted(len(distinct), threshold)
                lack = len(distinct) - want
                if len(low) > lack:
                    high = high[:0]
                classes.append(cls)
                wanted.append(want)
                least.append(max(1, len(low) + len(high) - lack))
                prints.append(low)
                more.append(high)
            yield pa.RecordBatch.from_arrays(
                [pa.array(classes, pa.int64()), pa.array(wanted, pa.int32()), pa.array(least, pa.int32()), long_lists(prints), long_lists(more)], ["e", "wanted", "least", "prints", "more"]
            )

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Minima that a task meets several times, with their numbers; what it meets once is not among the common ones."""
    held: list[np.ndarray] = []

    def counts() -> pa.RecordBatch:
        values, n = np.unique(np.concatenate(held) if held else np.empty(0, np.int64), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(values[n > 1]), pa.array(n[n > 1])], ["print", "n"])

    for batch in batches:
        held.append(batch.column(0).flatten().to_numpy(zero_copy_only=False))
        if sum(map(len, held)) >= COUNTED:
            yield counts()
            held = []
    yield counts()


def _probes(hot: np.ndarray):
    """e, wanted, least and the minima to join, without the hottest: up to least - NEEDED, which are taken off `least`.

    hot holds minima, the commonest first.
    """
    order = np.argsort(hot)
    ascending = hot[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least, prints = [], []
            for asked, low, high in zip(batch.column("least").to_pylist(), *(batch.column(c) for c in ("prints", "more"))):
                sent = np.concatenate([low.values.to_numpy(zero_copy_only=False), high.values.to_numpy(zero_copy_only=False)]).astype(np.int64)
                if len(ascending) and asked > NEEDED:
                    at = np.minimum(np.searchsorted(ascending, sent), len(ascending) - 1)
                    known = np.flatnonzero(ascending[at] == sent)
                    out = known[np.argsort(order[at[known]], kind="stable")][: asked - NEEDED]
                    sent, asked = np.delete(sent, out), asked - len(out)
                least.append(asked)
                prints.append(sent.view(np.uint64))
            yield pa.RecordBatch.from_arrays([batch.column("e"), batch.column("wanted"), pa.array(least, pa.int32()), long_lists(prints)], ["e", "wanted", "least", "prints"])

    return run


def chain(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Longest collinear chain of seeds: positions of equal runs, rising on both sides.

    a and b are run hashes in order. A run that occurs more than once in b is matched at its first place.
    """
    values, first = np.unique(b, return_index=True)
    if not len(values) or not len(a):
        return []
    at = np.searchsorted(values, a)
    at[at == len(values)] = len(values) - 1
    hits = np.flatnonzero(values[at] == a)
    seeds = list(zip(hits.tolist(), first[at[hits]].tolist()))
    tails: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for k, (_, y) in enumerate(seeds):
        at_len = bisect_left(tails, y)
        back.append(ends[at_len - 1] if at_len else -1)
        if at_len == len(tails):
            tails.append(y)
            ends.append(k)
        else:
            tails[at_len], ends[at_len] = y, k
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(seeds[k])
        k = back[k]
    return out[::-1]


def stretches(record: np.ndarray, other: np.ndarray, record_runs: np.ndarray, other_runs: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of the record's words inside the chained seeds, [start, end), each extended to both sides while words agree."""
    mask = np.zeros(len(record), dtype=bool)
    last = (-1, -1)
    for x, y in chain(record_runs, other_runs):
        mask[x : x + RUN] = True
        if (x - 1, y - 1) != last:
            i, j = x - 1, y - 1
            while i >= 0 and j >= 0 and not mask[i] and record[i] == other[j]:
                mask[i] = True
                i, j = i - 1, j - 1
        last = (x, y)
    if last[0] >= 0:
        i, j = last[0] + RUN, last[1] + RUN
        while i < len(record) and j < len(other) and record[i] == other[j]:
            mask[i] = True
            i, j = i + 1, j + 1
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def covered(record: np.ndarray, other: np.ndarray, record_runs: np.ndarray, other_runs: np.ndarray) -> float:
    """Share of the record's words inside the alignment."""
    return sum(b - a for a, b in stretches(record, other, record_runs, other_runs)) / len(record) if len(record) else 0.0


_SPANS = pa.list_(pa.struct([("at", pa.int32()), ("upto", pa.int32())]))


def _aligned(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None,)
        for batch in slices(batches):
            out: list[tuple] = []
            for t, e, train, record in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if last[0] != record:
                    words = word_hashes(record)
                    hashes = run_hashes(words)
                    last = (record, words, hashes, np.unique(hashes))
                _, words, hashes, distinct = last
                other = word_hashes(train)
                other_hashes = run_hashes(other)
                both = shared(distinct, np.unique(other_hashes))
                if len(distinct) and both >= _wanted(len(distinct), threshold):
                    spans = [{"at": a, "upto": b} for a, b in stretches(words, other, hashes, other_hashes)]
                    out.append((t, e, both / len(distinct), len(words), spans))
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), _SPANS)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], ["t", "e", "containment", "words", "spans"])

    return run


def candidates(train: DataFrame, held_out: DataFrame, threshold: float, min_words: int, cut: float = CUT) -> DataFrame:
    """(t, e): text classes that share as many minima as every pair at the threshold does, and a few more.

    A text that two tasks saw is sent twice, which only makes counts too high.
    """
    records = spread(held_out.select(text_class().alias("e"), "content"))
    minima = materialise(records.mapInArrow(_record_minima(min_words, threshold, cut), "e long, wanted int, least int, prints array<long>, more array<long>"))
    # bounded by HOT, whatever the number of records
    common = minima.select("prints").mapInArrow(_repeated, "print long, n long").groupBy("print").agg(F.sum("n").alias("n"))
    hot = common.orderBy(F.desc("n"), "print").limit(HOT).select("print").toArrow().column(0).to_numpy()
    probes = minima.mapInArrow(_probes(hot), "e long, wanted int, least int, prints array<long>").select(F.explode("prints").alias("print"), "e", "wanted", "least")
    late = minima.where(F.size("more") > 0).select(F.explode("more").alias("print")).distinct()
    few = late.limit(LATE + 1).toArrow().column(0).to_numpy()
    texts = spread(train.select(text_class().alias("t"), "content"))

    def sent(*how) -> DataFrame:
        return texts.mapInArrow(_train_minima(cut, *how), "t long, size int, prints array<long>").select(F.explode("prints").alias("print"), "t", "size")

    if len(few) <= LATE:
        theirs = sent(np.sort(few).view(np.uint64))
    else:
        theirs = sent().unionByName(sent(None, True).join(late, "print", "left_semi"))
    # a training text with fewer runs than a partner shares is none
    met = probes.join(theirs, "print").where("size >= wanted").groupBy("t", "e").agg(F.count("*").alias("n"), F.first("least").alias("least"))
    return materialise(met.where("n >= least").select("t", "e"))


def overlapping_classes(train: DataFrame, held_out: DataFrame, threshold: float = 0.7, min_words: int = 30, cut: float = CUT) -> DataFrame:
    """(t, e, containment, words, spans): text classes of the training and the evaluation side.

    Both inputs have one column `content`. containment is the share of the evaluation text's distinct five-word runs
    that the training text holds; spans are the stretches of its words inside the alignment. Null texts and evaluation
    texts of fewer than min_words words have no partner. No pair at the threshold is lost, whatever the cut; a cut of 1
    joins all runs.
    """
    pairs = candidates(train, held_out, threshold, min_words, cut)
    text_t = texts_of(train, pairs.select(F.col("t").alias("cls")).distinct()).withColumnsRenamed({"cls": "t", "text": "text_t"})
    text_e = texts_of(held_out, pairs.select(F.col("e").alias("cls")).distinct()).withColumnsRenamed({"cls": "e", "text": "text_e"})
    both = pairs.join(text_t, "t").join(text_e, "e").select("t", "e", "text_t", "text_e")
    return both.mapInArrow(_aligned(threshold), "t long, e long, containment double, words int, spans array<struct<at:int,upto:int>>")


def united_coverage(spans: DataFrame, by: list[str]) -> DataFrame:
    """by, coverage: share of a record's words inside any of its stretches. spans has `by`, words, spans.

    Stretches that begin at one word are merged before the rest, so a group is never longer than its record.
    """
    flat = spans.select(*by, "words", F.explode("spans").alias("s")).groupBy(*by, "words", F.col("s.at").alias("at")).agg(F.max("s.upto").alias("upto"))
    before = Window.partitionBy(*by).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.col("upto") - F.greatest(F.col("at"), F.coalesce(F.max("upto").over(before), F.lit(0))), F.lit(0))
    return flat.withColumn("fresh", fresh).groupBy(*by).agg((F.sum("fresh") / F.first("words")).alias("coverage"))
