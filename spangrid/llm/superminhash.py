"""SuperMinHash signatures.

Every element of a set walks through its own random permutation of the registers; the step number is the whole part
of the value it offers to the register it visits. Ranks of one element are therefore correlated across registers, which
lowers the variance of the estimate against plain MinHash, and a set's walk ends as soon as no register can improve.
All elements of a set take a step together, in NumPy.
"""

from __future__ import annotations

import numpy as np

from .shingles import mix

_STEP = np.uint64(0x9E3779B97F4A7C15)
_SCALE = 1.0 / (1 << 32)


#: Elements that walk together; bounds the memory of their permutations.
TOGETHER = 1 << 16


def signature(elements: np.ndarray, registers: int) -> np.ndarray:
    """Register values of a set of distinct 64-bit hashes; infinite where the set is empty."""
    values = np.full(registers, np.inf)
    for at in range(0, len(elements), TOGETHER):
        _walk(elements[at : at + TOGETHER], registers, values)
    return values


def _walk(elements: np.ndarray, registers: int, values: np.ndarray) -> None:
    """Lower the register values by a part of a set; those of other parts already stop the walk."""
    n = len(elements)
    order = np.broadcast_to(np.arange(registers, dtype=np.int32), (n, registers)).copy()
    rows, state = np.arange(n), elements.copy()
    for step in range(registers):
        if values.max() <= step:
            break
        state = state + _STEP
        draw = mix(state)
        fraction = (draw >> np.uint64(32)).astype(np.float64) * _SCALE
        pick = step + ((draw & np.uint64(0xFFFFFFFF)) % np.uint64(registers - step)).astype(np.int64)
        visited = order[rows, pick]
        order[rows, pick] = order[:, step]
        np.minimum.at(values, visited, fraction + step)


def band_keys(values: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of `rows` registers; the band's number is part of the key."""
    bits = values.view(np.uint64).reshape(-1, rows)
    keys = np.arange(1, len(bits) + 1, dtype=np.uint64) * _STEP
    for k in range(rows):
        keys = mix(keys ^ bits[:, k]) + _STEP
    return mix(keys)


def estimate(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity of two sets from their signatures."""
    return float(np.mean(a == b))
