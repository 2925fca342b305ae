"""Files written on the driver: formatted sources in place, and the classifier for other runtimes."""

from __future__ import annotations

import os
import struct
import tempfile

import numpy as np


def replace_file(path: str, old: bytes, new: bytes) -> bool:
    """Writes a file anew if it still holds `old` and `new` differs; the rename is atomic and the mode stays."""
    if old == new:
        return False
    with open(path, "rb") as f:
        if f.read() != old:
            raise RuntimeError(f"{path} has changed since it was read")
    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(new)
        os.chmod(temporary, os.stat(path).st_mode & 0o7777)
        os.replace(temporary, path)
    except BaseException:
        os.unlink(temporary)
        raise
    return True


# --- ONNX, as protocol-buffer fields


def _varint(value: int) -> bytes:
    out = b""
    while True:
        value, low = value >> 7, value & 127
        out += bytes([low | (128 if value else 0)])
        if not value:
            return out


def _field(number: int, value: int | bytes | str) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    data = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def _tensor(name: str, array: np.ndarray) -> bytes:
    return b"".join(_field(1, d) for d in array.shape) + _field(2, 1) + _field(8, name) + _field(9, np.ascontiguousarray(array, dtype="<f4").tobytes())


def _node(op: str, inputs: list[str], output: str) -> bytes:
    return b"".join(_field(1, i) for i in inputs) + _field(2, output) + _field(3, output) + _field(4, op)


def _value(name: str, width: int) -> bytes:
    shape = _field(1, _field(2, "batch")) + _field(1, _field(1, width))
    return _field(1, name) + _field(2, _field(1, _field(1, 1) + _field(2, shape)))


def onnx(model: dict[str, np.ndarray]) -> bytes:
    """The classifier as an ONNX model: two matrix products with biases and a rectifier between."""
    nodes = [_node("MatMul", ["input", "w1"], "m1"), _node("Add", ["m1", "b1"], "a1"), _node("Relu", ["a1"], "h"), _node("MatMul", ["h", "w2"], "m2"), _node("Add", ["m2", "b2"], "logits")]
    graph = b"".join(_field(1, n) for n in nodes) + _field(2, "classifier") + b"".join(_field(5, _tensor(k, model[k])) for k in ("w1", "b1", "w2", "b2"))
    graph += _field(11, _value("input", model["w1"].shape[0])) + _field(12, _value("logits", model["w2"].shape[1]))
    return _field(1, 8) + _field(7, graph) + _field(8, _field(2, 13))


# --- GGUF


def _text(value: str) -> bytes:
    return struct.pack("<Q", len(value.encode())) + value.encode()


def gguf(model: dict[str, np.ndarray], name: str = "classifier") -> bytes:
    """The classifier's weights as a GGUF file of version 3 with float32 tensors, aligned to 32 bytes."""
    keys = {"general.architecture": "mlp", "general.name": name, "general.alignment": 32, "mlp.inputs": model["w1"].shape[0], "mlp.hidden": model["w1"].shape[1], "mlp.classes": model["w2"].shape[1]}
    out = b"GGUF" + struct.pack("<IQQ", 3, 4, len(keys))
    for key, value in keys.items():
        out += _text(key) + (struct.pack("<I", 8) + _text(value) if isinstance(value, str) else struct.pack("<II", 4, value))
    data = b""
    for k in ("w1", "b1", "w2", "b2"):
        array = np.ascontiguousarray(model[k], dtype="<f4")
        out += _text(k) + struct.pack("<I", array.ndim) + b"".join(struct.pack("<Q", d) for d in reversed(array.shape)) + struct.pack("<IQ", 0, len(data))
        data += array.tobytes() + b"\0" * (-array.nbytes % 32)
    return out + b"\0" * (-len(out) % 32) + data


def read_gguf(data: bytes) -> dict[str, np.ndarray]:
    """The float32 tensors of a GGUF file of version 3, by its header."""
    version, tensors, keys = struct.unpack_from("<IQQ", data, 4)
    if data[:4] != b"GGUF" or version != 3:
        raise ValueError("no GGUF file of version 3")
    at = 24

    def text() -> str:
        nonlocal at
        (n,) = struct.unpack_from("<Q", data, at)
        at += 8 + n
        return data[at - n : at].decode()

    for _ in range(keys):
        text()
        (kind,) = struct.unpack_from("<I", data, at)
        at += 4
        if kind == 8:
            text()
        else:
            at += 4
    heads = []
    for _ in range(tensors):
        name = text()
        (dims,) = struct.unpack_from("<I", data, at)
        shape = struct.unpack_from(f"<{dims}Q", data, at + 4)[::-1]
        _, offset = struct.unpack_from("<IQ", data, at + 4 + 8 * dims)
        at += 16 + 8 * dims
        heads.append((name, shape, offset))
    base = at + -at % 32
    return {name: np.frombuffer(data, "<f4", int(np.prod(shape)), base + offset).reshape(shape) for name, shape, offset in heads}
