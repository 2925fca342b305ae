"""Encoding of whole texts with a public byte-level BPE, by tree concatenation of long texts and long pieces.

A text longer than TEXT_LEAF characters is halved down to leaves, which are encoded side by side, wherever the cut falls;
each join is repaired by encoding a window around it again, which grows outwards until it begins and ends where both
sides have the same tokens. The pattern of the tokenizer cuts a text into pieces that never merge across. A piece longer
than LEAF bytes is halved likewise down to leaves, the halves are encoded side by side, and every join is repaired: a window of tokens around it is encoded
again and grows until its first token agrees with the left side and its last token with the right side. Two encodings
that agree at both ends of such a window join to the encoding of the whole, as all neighbouring tokens are then pairs
that the merges would leave alone.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread
from .arrow import slices

LEAF = 8192
#: Tokens on each side of a join in the first window.
REACH = 8
#: Characters of a leaf of a long text.
TEXT_LEAF = 1024
DEFAULT_FOLDER = "/opt/tokenizers"
# Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_encoders: dict[str, object] = {}


def encoder(path: str):
    """The tiktoken encoding of a rank file, once for each worker; from the copy that `ship` sent along, if there is one."""
    if path not in _encoders:
        import tiktoken

        sent = SparkFiles.get(os.path.basename(path)) if SparkFiles._root_directory or SparkFiles._is_running_on_worker else path
        with open(sent if os.path.exists(sent) else path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _encoders[path] = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


#: Bytes of a rank file that is sent to the workers; a larger one must lie in the same folder of each.
SHIPPED = 64 << 20
_shipped: set[tuple[str, str]] = set()


def ship(spark: SparkSession, path: str) -> str:
    """Send a rank file of the driver to all workers, once a session; returns its path."""
    mark = spark.sparkContext.applicationId, path
    if mark not in _shipped and os.path.exists(path) and os.path.getsize(path) <= SHIPPED:
        spark.sparkContext.addFile(path)
        _shipped.add(mark)
    return path


def join_halves(enc, left: list[int], right: list[int], reach: int = REACH) -> list[int]:
    """The encoding of the concatenation of two encoded byte strings."""
    while left and right:
        a, b = left[-reach:], right[:reach]
        window = enc._encode_single_piece(enc.decode_bytes(a + b))
        ends_left, ends_right = len(a) == len(left), len(b) == len(right)
        if (ends_left or window[0] == a[0]) and (ends_right or window[-1] == b[-1]):
            return left[: len(left) - len(a)] + window + right[len(b) :]
        reach *= 2
    return left or right


def encode_piece(enc, piece: bytes, leaf: int = LEAF, pool: ThreadPoolExecutor | None = None) -> list[int]:
    """Token ids of one piece of any length."""
    if len(piece) <= leaf:
        return enc._encode_single_piece(piece)
    leaves = [piece[at : at + leaf] for at in range(0, len(piece), leaf)]
    parts = list((pool.map if pool else map)(enc._encode_single_piece, leaves))
    while len(parts) > 1:
        pairs = [(parts[k], parts[k + 1]) for k in range(0, len(parts) - 1, 2)]
        rest = parts[len(pairs) * 2 :]
        parts = list((pool.map if pool else map)(lambda x: join_halves(enc, *x), pairs)) + rest
    return parts[0]


#: Between a sign and white space every text is cut, as no piece holds white space after anything else.
_CERTAIN = re.compile(r"(?<=\S)(?=\s)")


def join_texts(enc, left: str, a: list[int], right: str, b: list[int], plain: Callable[[str], list[int]]) -> list[int]:
    """The encoding of left + right, whose own encodings are a and b.

    The window reaches from a certain cut in the left text to one in the right text; it is good if what lies outside it
    is encoded alike with and without the part inside, else it grows to the next certain cuts.
    """
    reach = 64
    while True:
        near = [m.start() for m in _CERTAIN.finditer(left, max(0, len(left) - reach))]
        far = [m.start() for m in _CERTAIN.finditer(right, 0, min(len(right), reach + 1)) if m.start()]
        whole_left, whole_right = reach >= len(left), reach >= len(right)
        at = 0 if whole_left else near[0] if near else -1
        to = len(right) if whole_right else far[-1] if far else -1
        if at >= 0 and to >= 0:
            old_left, old_right = plain(left[at:]), plain(right[:to])
            same_left = at == 0 or a[len(a) - len(old_left) :] == old_left
            same_right = to == len(right) or b[: len(old_right)] == old_right
            if same_left and same_right:
                outer_left = a[: len(a) - len(old_left)] if at else []
                outer_right = b[len(old_right) :] if to < len(right) else []
                return outer_left + plain(left[at:] + right[:to]) + outer_right
        reach *= 2


def encode_text(enc, text: str, leaf: int = LEAF, pool: ThreadPoolExecutor | None = None, text_leaf: int = TEXT_LEAF) -> list[int]:
    """Token ids of a whole text, without special tokens."""

    def plain(part: str) -> list[int]:
        if len(part) <= leaf // 4 or not _LONG_RUN.search(part):
            return enc.encode_ordinary(part)
        import regex

        return [i for piece in regex.findall(PATTERN, part) for i in encode_piece(enc, piece.encode(), leaf, pool)]

    if len(text) <= text_leaf:
        return plain(text)
    texts = [text[at : at + text_leaf] for at in range(0, len(text), text_leaf)]
    lists = list((pool.map if pool else map)(plain, texts))
    while len(texts) > 1:
        joined = [join_texts(enc, texts[k], lists[k], texts[k + 1], lists[k + 1], plain) for k in range(0, len(texts) - 1, 2)]
        odd = len(texts) % 2
        lists = joined + (lists[-1:] if odd else [])
        texts = ["".join(texts[k : k + 2]) for k in range(0, len(texts), 2)]
    return lists[0]


#: A stretch in which a piece longer than a quarter of LEAF can hide: of one kind, without white space inside, or white space only.
_LONG_RUN = re.compile(rf"\S{{{LEAF // 4}}}|\s{{{LEAF // 4}}}")


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        with ThreadPoolExecutor(2) as pool:
            for batch in slices(batches):
                lists = [np.asarray(encode_text(enc, t, pool=pool) if t else [], dtype=np.int32) for t in batch.column(1).to_pylist()]
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists) if lists else np.empty(0, np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc", "ids"])

    return run


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in slices(batches):
            sizes = [len(encode_text(enc, t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["doc", "n_tokens"])

    return run


def rank_file(name: str = "byte_bpe_50k", folder: str = DEFAULT_FOLDER) -> str:
    return f"{folder}/{name}.tiktoken"


def token_ids(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, ids) of every row, without special tokens; strings of special tokens are ordinary text.

    A null text and an empty text have an empty list. Repeated rows come out as often as they came in.
    """
    kind = documents.schema[key].dataType.simpleString()
    rows = spread(documents.select(F.col(key).alias("doc"), F.col(text).alias("text")))
    return rows.mapInArrow(_encode(ship(documents.sparkSession, path or rank_file())), f"doc {kind}, ids array<int>").withColumnRenamed("doc", key)


def token_counts(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, n_tokens) of every row; null and empty texts have none. key may be a struct."""
    kind = documents.schema[key].dataType.simpleString()
    rows = spread(documents.select(F.col(key).alias("doc"), F.col(text).alias("text")))
    return rows.mapInArrow(_count(ship(documents.sparkSession, path or rank_file())), f"doc {kind}, n_tokens long").withColumnRenamed("doc", key)
