"""Weights of the classifier as bytes: a header with the shape, float32 values, and a SHA-256 of all before it."""

from __future__ import annotations

import hashlib
import struct

import numpy as np

MAGIC, VERSION = b"SPANMLP1", 6
_NAMES = ("w1", "b1", "w2", "b2")


def encode(model: dict[str, np.ndarray]) -> bytes:
    if not all(np.isfinite(model[k]).all() for k in _NAMES):
        raise ValueError("a weight is not finite")
    (inputs, hidden), classes = model["w1"].shape, model["w2"].shape[1]
    body = MAGIC + struct.pack("<4I", inputs, hidden, classes, VERSION) + b"".join(np.ascontiguousarray(model[k], dtype="<f4").tobytes() for k in _NAMES)
    return body + hashlib.sha256(body).digest()


def decode(data: bytes) -> dict[str, np.ndarray]:
    body, digest = data[:-32], data[-32:]
    if hashlib.sha256(body).digest() != digest or body[:8] != MAGIC:
        raise ValueError("no weights, or damaged ones")
    inputs, hidden, classes, version = struct.unpack("<4I", body[8:24])
    if version != VERSION or len(body) != 24 + 4 * (inputs * hidden + hidden + hidden * classes + classes):
        raise ValueError("weights of another version or shape")
    values, out, at = np.frombuffer(body[24:], dtype="<f4").astype(np.float64), {}, 0
    for name, shape in zip(_NAMES, ((inputs, hidden), (hidden,), (hidden, classes), (classes,))):
        size = int(np.prod(shape))
        out[name] = values[at : at + size].reshape(shape)
        at += size
    return out
