import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from spangrid.operators import metrics, model, ranking, units
from spangrid.operators.components import connected_components
from spangrid.operators.scanner import scan
from spangrid.sources import dataset, files, globs, patches, weights
from spangrid.streaming import events


def test_components(spark):
    edges = [(1, 2), (2, 3), (4, 5), (6, 6), (3, 9), (9, 1), (None, 4)] + [(100, k) for k in range(101, 160)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 4: 4, 5: 4, 6: 6, **dict.fromkeys(range(100, 160), 100)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    chain = spark.createDataFrame([(k, k + 1) for k in range(200)], "a long, b long")
    assert connected_components(chain).select("component").distinct().collect()[0][0] == 0


def test_global_rank(spark):
    words = [f"w{(k * 7919) % 1000:04d}" for k in range(500)]
    got = {r.w: r["rank"] for r in ranking.global_rank(spark.createDataFrame([(w,) for w in words], "w string"), "w").collect()}
    assert got == {w: n + 1 for n, w in enumerate(sorted(words))}


def test_metrics(spark):
    rows = spark.createDataFrame([("a", 0, 0), ("a", 1, 1), ("a", 1, 0), ("b", 2, 1)], "g string, t int, p int")
    c = metrics.confusion(rows, "t", "p", "g").select("g", metrics.accuracy().alias("acc"), metrics.macro_f1().alias("f1"), metrics.blank_precision().alias("bp"), metrics.blank_recall().alias("br"))
    got = {r.g: r for r in c.collect()}
    assert got["a"].acc == pytest.approx(2 / 3) and got["a"].bp == 1 and got["a"].br == 0.5
    assert got["a"].f1 == pytest.approx((2 / 3 + 2 / 3) / 2) and got["b"].f1 == 0 and got["b"].bp == 0


def test_gate_and_argmax(spark):
    z = spark.createDataFrame([([1.0, 1.0, 0.0],), ([0.0, 5.0, 0.0],)], "z array<double>")
    got = z.select(metrics.argmax(F.col("z")).alias("a"), metrics.gated(F.col("z"), 0.9, 255).alias("g")).collect()
    assert [(r.a, r.g) for r in got] == [(0, 255), (1, 1)]


def test_gradients_against_differences():
    rng = np.random.default_rng(0)
    m, x = model.initial(1, 6, 5), rng.normal(size=(9, 6))
    y = np.eye(3)[rng.integers(3, size=9)]
    _, g = model.gradients(m, x, y)
    for k in m:
        it = np.ndindex(m[k].shape)
        for at in list(it)[:6]:
            up, down = ({n: a.copy() for n, a in m.items()} for _ in range(2))
            up[k][at] += 1e-5
            down[k][at] -= 1e-5
            assert abs((model.gradients(up, x, y)[0] - model.gradients(down, x, y)[0]) / 2e-5 - g[k][at]) < 2e-3


def test_training_learns_a_plane():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 8))
    y = (x[:, 0] > 0.3).astype(int) + (x[:, 0] > 1).astype(int)
    fitted, losses = model.train(x, y, rng.integers(3, size=900), epochs=25, rate=0.01)
    assert np.mean(model.forward(fitted, x).argmax(1) == y) > 0.9 and losses[-1] < 0.5 * losses[0]


def test_weights_round_trip_and_damage():
    m = model.initial(5)
    data = weights.encode(m)
    assert all(np.allclose(m[k], v, atol=1e-6) for k, v in weights.decode(data).items())
    with pytest.raises(ValueError):
        weights.decode(data[:-1] + b"x")
    m["b1"][0] = np.nan
    with pytest.raises(ValueError):
        weights.encode(m)


@pytest.mark.parametrize(
    "pattern, yes, no",
    [
        ("*.ts", ["a.ts", ".ts"[1:] + ".ts"], ["a/b.ts", ".a.ts"]),
        ("**/*.ts", ["a.ts", "a/b/c.ts"], [".x/a.ts", "a/.b.ts"]),
        ("a/[!x-z]?.js", ["a/bc.js"], ["a/xc.js", "a/b.js"]),
        ("[ab.py", ["[ab.py"], ["a.py"]),
        ("src/**", ["src/a/b", "src/a"], ["lib/a"]),
        ("[^a]b", ["cb"], ["ab"]),
    ],
)
def test_globs(pattern, yes, no):
    import re

    regex = re.compile(globs.glob_regex(pattern))
    assert all(regex.fullmatch(p) for p in yes) and not any(regex.fullmatch(p) for p in no)
    assert globs.has_pattern(pattern)


def test_patch_paths(spark):
    patch = "*** Add File: a\n+x\n*** Update File: b\n*** Move to: c\n*** Update File: d"
    got = spark.createDataFrame([(patch,), ("",)], "p string").select(patches.changed_paths(F.col("p")).alias("x")).collect()
    assert got[0].x == ["a", "c", "d"] and got[1].x == []


def test_files_with_underscores_are_read(spark, tmp_path):
    for name in ("_a.py", ".b.py", "c.py", "d.bin"):
        (tmp_path / name).write_bytes(b"x = 1\n")
    (tmp_path / "vendor").mkdir()
    (tmp_path / "vendor" / "e.py").write_bytes(b"")
    got = {r.name for r in files.read_directory(spark, str(tmp_path)).collect()}
    assert got == {"_a.py", ".b.py", "c.py"}
    assert {os.path.basename(p) for p in files.expand("*.py", str(tmp_path))} == {"_a.py", "c.py"}


def test_dataset_checks(spark, tmp_path):
    good = spark.createDataFrame([(1, 0, 2, 1, [0.5] * 192, "train")], dataset.SCHEMA)
    dataset.write_dataset(good, str(tmp_path / "a"))
    assert dataset.read_dataset(spark, str(tmp_path / "a")).count() == 1
    bad = spark.createDataFrame([(1, 0, 2, 3, [0.5] * 191, "train")], dataset.SCHEMA)
    dataset.write_dataset(bad, str(tmp_path / "b"))
    with pytest.raises(ValueError):
        dataset.read_dataset(spark, str(tmp_path / "b"))


def test_units():
    text = "if (a) {\n    b();\n} else {\n    c();\n}\nx = foo(\n    1,\n    2,\n);\ny();\n"
    lines = [x for x in scan(text)[0] if not x.blank]
    starting, ending = units.units(lines)
    assert (starting[0].first, starting[0].last, starting[0].role) == (0, 4, "control")
    assert (starting[5].last, starting[5].role) == (8, "assignment") and starting[9].role == "call"
    assert ending[4].first == 0 and units.interiors(lines)[6]


def test_streams(spark, sf_dir, tmp_path):
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    want = {tuple(r) for r in events.latest(table).collect()}
    assert {tuple(r) for r in events.run_latest(spark, f"{sf_dir}/events.parquet", f"file://{tmp_path}").collect()} == want
    assert events.windowed_counts(table).agg(F.sum("n")).first()[0] == table.count()
