"""Channels of vectors and flags of lines, against values worked out by hand for one small text, and a second way to the
bags; and that layout queries shuffle no text."""

import math

import numpy as np
import pytest

from spangrid.operators import features, layout, scanner
from spangrid.operators.roles import ROLES
from spangrid.plans.registry import QUERIES

#       0           1        2            3            4     5            6       7            8    9
TEXT = "load(a)\n// why\nif (b) {\n  total = 1\n  go(x,\n     y)\n\n\n}\nreturn total\nclass C {\n  let k = 2;\n}\n"
LINES = ["load(a)", "// why", "if (b) {", "total = 1", "go(x,", "y)", "}", "return total", "class C {", "let k = 2;", "}"]
# boundaries that may change: every one but that after the comment
LEFT = [0, 2, 3, 4, 5, 6, 7, 8, 9]


@pytest.fixture(scope="module")
def got():
    found, x = features.vectors(TEXT)
    assert [b.before for b in found] == LEFT and [b.after for b in found] == [k + 1 for k in LEFT]
    return x


def hot(first: int, role: str | None) -> list[float]:
    return [float(name == role) for name in ROLES]


def test_depths_and_comments(got):
    depth = [(0, 0, 0), (1, 0, 0), (1, 0, 0), (1, 1, 0), (1, 0, 0), (0, 0, 0), (0, 0, 0), (1, 0, 0), (1, 0, 0)]
    assert np.allclose(got[:, 5:8], np.array(depth) / 8)
    assert got[:, 16].tolist() == [0] * 9 and got[:, 17].tolist() == [1] + [0] * 8


def test_roles_of_both_lines(got):
    roles = ["call", "other", "control", "assignment", "call", "other", "closing", "exit", "binding", "binding", "closing"]
    for row, k in zip(got, LEFT):
        assert row[128:136].tolist() == hot(128, roles[k]) and row[136:144].tolist() == hot(136, roles[k + 1])


def test_neighbours_of_one_indentation(got):
    before = [None, "call", None, "assignment", None, "control", "closing", "exit", None]
    # a comment is no neighbour but has one
    after = {0: "control", 2: "call", 3: None, 4: None, 5: "exit", 6: "binding", 7: "closing", 8: None, 9: None}
    for row, k, b in zip(got, LEFT, before):
        assert row[144:152].tolist() == hot(144, b), k
        assert row[152:160].tolist() == hot(152, after[k]), k


def test_units_on_both_sides(got):
    # units: load 0-0, if 2-6, total 3-3, go 4-5, y none ends later, return 7-7, class 8-10, let 9-9
    left = {0: ("call", 1), 3: ("assignment", 1), 5: ("call", 2), 6: ("control", 5), 7: ("exit", 1), 9: ("binding", 1)}
    right = {0: ("control", 5), 2: ("assignment", 1), 3: ("call", 2), 4: ("other", 1), 6: ("exit", 1), 7: ("binding", 3), 8: ("binding", 1)}
    for row, k in zip(got, LEFT):
        for held, roles, several, there, size in ((left, 160, 176, 181, 184), (right, 168, 177, 182, 185)):
            role, n = held.get(k, (None, 0))
            assert row[roles : roles + 8].tolist() == hot(roles, role), (k, roles)
            assert row[there] == (n > 0) and row[several] == (n > 1)
            assert row[size] == pytest.approx(math.log2(1 + n) / 10 if n else 0)
        a, z = left.get(k), right.get(k)
        assert row[180] == bool(a and z and a[0] == z[0]), k
    # one indentation on both sides: load and if, total and go, if and return, return and class
    assert [k for row, k in zip(got, LEFT) if row[183]] == [0, 3, 6, 7]
    # of these all are siblings but the inside of parentheses
    assert [k for row, k in zip(got, LEFT) if row[178]] == [0, 3, 6, 7]
    # no unit on a side, or inside something that is no body
    assert [k for row, k in zip(got, LEFT) if row[179]] == [2, 4, 5, 8, 9]
    assert [k for row, k in zip(got, LEFT) if row[186]] == [0]


def test_bags_by_another_way(got):
    def slow(line: str) -> np.ndarray:
        out, words, at = np.zeros(32), [], 0
        while at < len(line):
            end = at + 1
            if line[at].isalnum() or line[at] == "_":
                while end < len(line) and (line[end].isalnum() or line[end] == "_"):
                    end += 1
            if not line[at].isspace():
                words.append(line[at:end].lower())
            at = end
        for w in words:
            h = 14695981039346656037
            for byte in w.encode():
                h = (h ^ byte) * 1099511628211 % 2**64
            out[h % 32] += -1 if (h >> 32) % 2 else 1
        return out / math.sqrt(max(1, len(words)))

    for row, k in zip(got, LEFT):
        assert np.allclose(row[32:64], slow(LINES[k])) and np.allclose(row[64:96], slow(LINES[k + 1]))


@pytest.mark.parametrize("first, last", [(5, 7), (16, 17), (32, 95), (96, 127), (128, 143), (144, 159), (160, 186)])
def test_channels_asked_for_are_those_of_the_whole(got, first, last):
    some = features.vectors(TEXT, range(first, last + 1))[1]
    assert (some[:, first : last + 1] == got[:, first : last + 1]).all()


def test_flags_of_lines():
    lines, still_open = scanner.scan("a = `x\n\ny`\n  # c\nb \\\n\\\\ d\n(\n")
    assert not still_open and [x.protected for x in lines] == [True, True, True, False, False, True, False]
    assert [(x.protected_before, x.protected_after) for x in lines[:3]] == [(False, True), (True, True), (True, False)]
    assert [x.comment for x in lines] == [False, False, False, True, False, False, False]
    assert lines[4].continued and (lines[5].protected_before, lines[5].protected_after) == (True, True) and lines[6].parentheses == 1


@pytest.fixture(scope="module")
def spread_tables(spark, sf_dir, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.read.parquet(f"{sf_dir}/source_files.parquet").repartition(8).write.parquet(f"{folder}/source_files.parquet")
    return folder


@pytest.mark.parametrize("name", ["lay01_lines", "lay07_gaps", "lex01_token_counts", "fea02_indents", "cor01_canonical_digest", "flt11_minimum_boundaries"])
def test_no_text_is_shuffled(spark, spread_tables, sf_dir, name):
    spark.conf.set("spark.sql.files.openCostInBytes", str(64 << 20))
    try:
        df = QUERIES[name](spark, spread_tables)
        plan = df._jdf.queryExecution().executedPlan().toString()
        rows = df.count()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    shuffles = [x for x in plan.splitlines() if "Exchange" in x and "Broadcast" not in x]
    assert not any("content" in x or "text" in x or "RoundRobin" in x for x in shuffles), plan
    assert rows == QUERIES[name](spark, sf_dir).count()


def test_first_delivery_with_and_without_places(spark, tmp_path, monkeypatch):
    rows = [(1, "a", 5), (1, "b", 3), (2, "c", 1), (3, None, 1), (3, "d", 2), (4, "e", 1), (4, "e", 1)]
    df = spark.createDataFrame(rows, "file_id long, content string, ingested_at long")
    df.write.parquet(str(tmp_path / "t"))
    want = [(1, "b"), (2, "c"), (4, "e")]
    stored = spark.read.parquet(str(tmp_path / "t"))
    for files in (df, stored):
        assert sorted(tuple(r) for r in layout.first_delivery(files).select("doc_id", "text").collect()) == want
    monkeypatch.setattr(layout, "REPEATED", 1)
    assert sorted(tuple(r) for r in layout.first_delivery(stored).select("doc_id", "text").collect()) == want
