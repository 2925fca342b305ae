import io
import json

import numpy as np
import pytest

from spangrid import cli
from spangrid.operators import model
from spangrid.sources import exports


def test_onnx_runs_elsewhere():
    ort = pytest.importorskip("onnxruntime")
    m = model.initial(4, 12, 5)
    x = np.random.default_rng(0).normal(size=(7, 12)).astype(np.float32)
    got = ort.InferenceSession(exports.onnx(m), providers=["CPUExecutionProvider"]).run(None, {"input": x})[0]
    assert np.allclose(got, model.forward(m, x), atol=1e-4)


def test_gguf_layout():
    data = exports.gguf(model.initial(4, 12, 5))
    assert data[:4] == b"GGUF" and len(data) % 32 == 0


def test_replace_file(tmp_path):
    p = tmp_path / "a.py"
    p.write_bytes(b"x")
    p.chmod(0o640)
    assert exports.replace_file(str(p), b"x", b"y") and p.read_bytes() == b"y" and p.stat().st_mode & 0o777 == 0o640
    assert not exports.replace_file(str(p), b"y", b"y")
    with pytest.raises(RuntimeError):
        exports.replace_file(str(p), b"x", b"z")
    assert p.read_bytes() == b"y"


def test_command_line(tmp_path, capsys, monkeypatch):
    (tmp_path / "a.js").write_text("function f() {\n  return 1;\n}\nfunction g() {\n  return 2;\n}\nconst b = 1;\n")
    (tmp_path / "b.txt").write_text("no code")
    assert cli.main(["-p", str(tmp_path), "--check"]) == 1
    assert cli.main(["-p", str(tmp_path), "--stats"]) == 0
    line = json.loads(capsys.readouterr().out)
    assert line["changes"] > 0 and line["path"].endswith("a.js")
    assert cli.main(["-p", str(tmp_path), "--write"]) == 0 and cli.main(["-p", str(tmp_path), "--check"]) == 0
    (tmp_path / "bad.py").write_bytes(b"\xff")
    assert cli.main(["-p", str(tmp_path), "--check"]) == 2
    monkeypatch.setattr("sys.stdin", io.TextIOWrapper(io.BytesIO(b"a();\n")))
    assert cli.main([]) == 0 and capsys.readouterr().out.endswith("a();\n")
