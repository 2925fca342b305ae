"""Held-out languages: vectors stay in their task, the sample is the one of all boundaries, and short ways agree with the long ones."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spangrid.operators import features, metrics, model, scanner, units
from spangrid.plans import evaluation_queries as q

PIECES = ["a", "b1", "r", "_", "é", " ", "  ", "\t", "\n", "\n", "\n", "\r\n", "\r", '"', "'", "`", '"""', "'a", "\\", "/", "//", "/*", "*/", "#", "--", "--[", "[[", "]]", "[=[", "%", "%w(", "%q", 'r"', 'r#"', '"#', 'R"x(', ')x"',
          "$", "$a$", "<", "<a>", "</a>", '<a b="c">', "<b", "<<EOF", "EOF", "<!--", "-->", "(*", "*)", "{-", "-}", "!", "m!", "(", ")", "[", "]", "{", "}", ";", ":", ": >", ": |", "=", "=>", "=begin", "=end", "__END__", "return ", ",", "."]


def texts(n, longest=40):
    rng = random.Random(5)
    return [scanner.as_bytes("".join(rng.choices(PIECES, k=rng.randint(1, longest)))) for _ in range(n)]


def test_lines_taken_whole_are_as_scanned():
    for text in texts(20_000):
        assert scanner.scan(text) == scanner.scan(text, plain=False), text


def test_vectors_without_boundaries_are_the_same():
    for text in (*texts(1_500), *(t.replace("\r", "") for t in texts(3_000))):
        found, x = features.vectors(text)
        gaps, y = features.gaps_and_vectors(text)
        assert [b.blank_lines for b in found] == gaps.tolist() and x.tobytes() == y.tobytes(), text


def test_neighbours_by_looking_at_every_line():
    rng = random.Random(4)
    for _ in range(300):
        c = units.Columns([x for x in scanner.scan("".join(" " * rng.randint(0, 2) + rng.choice(("// c", "a = b", "f()", "return", "{-")) + "\n" for _ in range(rng.randint(1, 60))))[0] if not x.blank])
        for step, got in zip((-1, 1), units._neighbours(c)):
            want = []
            for at in range(c.size):
                near = [k for k in range(at + step, at + step * (units.NEAR + 1), step) if 0 <= k < c.size]
                near = list(itertools.takewhile(lambda k: c.indent[k] >= c.indent[at], near))
                want.append(next((c.role_numbers[k] for k in near if c.indent[k] == c.indent[at] and not c.comment[k] and not c.protected[k]), -1))
            assert got.tolist() == want


def test_bags_and_first_words_of_several_lines():
    values = [v for t in texts(2_000) for v in t.split("\n")] + ["²", "1²", "12 ab", "x" * 600, "a " * 300, ""]
    assert np.array_equal(features.bags(values), np.array([features.bag(v) for v in values]))
    runs = [[w for w in features._TOKEN.findall(v) if w[0] >= "\x80" or w[0] == "_" or w[0].isascii() and w[0].isalnum()] for v in values]
    assert [features.first_word(v) for v in values] == [next((w for w in r if not w.isdigit()), "") for r in runs]


@pytest.fixture(scope="module")
def files(spark):
    rng = random.Random(3)
    gap = lambda: "\n" * rng.choice((1, 1, 1, 2, 2, 3, 4))
    rows = [(n, "".join(rng.choice(("f(x);", "if (a) {", "}", "// c", "let b = 2;", "'x")) + gap() for _ in range(rng.randint(0, 12))), n % 3) for n in range(90)]
    return spark.createDataFrame([*rows, (None, "a();\nb();\n", 0), (91, None, 1)], "doc_id long, text string, held_out int").repartition(3)


@pytest.mark.parametrize("likely", [0, 3, 12, 1000])
def test_the_sample_is_that_of_all_boundaries(files, likely):
    x, y, g = q.transfer_sample(files, per_label=4, likely=likely)
    v = features.boundary_vectors(files).where("doc_id IS NOT NULL AND blank_lines <= 2").join(files.select("doc_id", "held_out"), "doc_id")
    rows = v.withColumn("h", F.xxhash64("doc_id", "boundary_id")).collect()
    want = [r for k in range(3) for b in range(3) for r in sorted((r for r in rows if (r.held_out, r.blank_lines) == (k, b)), key=lambda r: r.h)[:4]]
    assert len(want) == 36 and y.tolist() == [r.blank_lines for r in want] and g.tolist() == [r.held_out for r in want]
    assert np.array_equal(x, np.array([r.input for r in want]))


def test_counts_are_those_of_each_boundary(files):
    fitted = {0: model.initial(1), 1: model.initial(2)}
    got = {r.held_out: tuple(r)[1:] for r in metrics.counted(model.choice(fitted, files, "held_out"), "gap_label", "prediction", "n", "held_out").collect()}
    want = {k: [0] * 9 for k in range(3)}
    for r in files.where("text IS NOT NULL").collect():
        for b, v in zip(*features.vectors(scanner.as_bytes(r.text))):
            if b.blank_lines <= 2 and r.held_out in fitted:
                want[r.held_out][3 * b.blank_lines + int(model.forward(fitted[r.held_out], v[None].astype(float)).argmax())] += 1
    assert got == {k: tuple(c) for k, c in want.items()}


def test_no_vector_is_handed_on(spark, sf_dir):
    assert "input#" not in q.evl06(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
