"""Words, five-word runs and winnowed fingerprints of texts, vectorised with NumPy.

A word is a longest run of ASCII letters, digits and underscores, or any other single character that is not white
space; letter case is ignored. Run hashes are 64 bits wide and the same on every worker.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash

RUN = 5
_WORD = re.compile(r"[A-Za-z0-9_]+|[^\sA-Za-z0-9_]")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_MEMO_LIMIT = 1 << 19


class _Memo(dict):
    """Word to hash; emptied when it grows too large for a worker."""

    def __missing__(self, word: str) -> int:
        if len(self) > _MEMO_LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_memo = _Memo()


def split_words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _C1
    x = (x ^ (x >> np.uint64(27))) * _C2
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    words = split_words(text)
    return np.fromiter(map(_memo.__getitem__, words), dtype=np.uint64, count=len(words))


def run_hashes(words: np.ndarray, run: int = RUN) -> np.ndarray:
    """Hash of each run of consecutive words, in order; empty for texts of fewer words."""
    n = len(words) - run + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    total = words[:n].copy()
    for k in range(1, run):
        total *= _BASE
        total += words[k : k + n]
    return mix(total)


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions of the winnowing selection: the rightmost minimum of every window of hashes.

    Two sequences that share `window` hashes in a row share a selected hash.
    """
    n = len(hashes)
    if n == 0:
        return np.empty(0, dtype=np.int64)
    if n <= window:
        return np.array([n - 1 - int(np.argmin(hashes[::-1]))])
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)
    rightmost = window - 1 - np.argmin(views[:, ::-1], axis=1)
    return np.unique(rightmost + np.arange(n - window + 1))


def fingerprints(text: str, window: int, run: int = RUN) -> np.ndarray:
    """Distinct winnowed run hashes of a text."""
    hashes = run_hashes(word_hashes(text), run)
    return np.unique(hashes[winnow(hashes, window)])


def run_set(text: str, run: int = RUN) -> np.ndarray:
    """Distinct run hashes of a text, ascending."""
    return np.unique(run_hashes(word_hashes(text), run))


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Number of values in both ascending sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int(np.count_nonzero(b[at] == a))
