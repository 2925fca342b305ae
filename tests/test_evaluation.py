"""Operators of evaluation, leakage, structure and streams on small fixtures, against values worked out by hand or brute force."""

import datetime as dt
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spangrid.operators import containment, evaluation, formatting, scanner, trees, units
from spangrid.plans.evaluation_queries import pick_cases
from spangrid.plans.text_queries import rule_of
from spangrid.sources.patches import changed_paths
from spangrid.streaming import events


def nonblank(text):
    return [x for x in scanner.scan(scanner.as_bytes(text))[0] if not x.blank]


# --- sessions


def test_a_session_gives_what_formatting_gives():
    text = "a();\nif (b) {\n  c();\n}\nd();\nclass E {\n  f();\n}\ng();\n"
    for batch in (1, 2, 100):
        session = formatting.Session(text)
        while len(x := session.encode(batch)):
            session.accept(np.eye(3)[formatting.rule_labels(x)])
        out, changes, candidates, abstained = session.finish()
        assert (out, changes, candidates) == formatting.format_text(text) and abstained == 0


def test_a_session_keeps_gaps_below_its_confidence_and_refuses_bad_calls():
    text = "a();\n\nb();\nc();\n"
    session = formatting.Session(text, 0.9)
    x = session.encode(1)
    with pytest.raises(RuntimeError):
        session.encode(1)
    with pytest.raises(ValueError):
        session.accept(np.full((1, 3), np.nan))
    session.accept(np.array([[0.4, 0.3, 0.3]]))
    with pytest.raises(RuntimeError):
        session.finish()
    assert len(session.encode(9)) == 1 and len(x) == 1
    session.accept(np.array([[0.0, 0.0, 1.0]]))
    assert session.finish() == ("a();\n\nb();\n\n\nc();\n", 1, 2, 1)
    for bad in (-0.1, 1.1, float("nan")):
        with pytest.raises(ValueError):
            formatting.Session(text, bad)
    with pytest.raises(ValueError):
        formatting.Session("a\rb")
    open_ = formatting.Session("a = 'x\n\n")
    assert len(open_.encode(5)) == 0 and open_.finish() == ("a = 'x\n\n", 0, 0, 0)


def test_sessions_over_documents(spark):
    rows = [(1, "a();\nb();\n"), (2, "x\ry"), (3, None), (4, "")]
    got = {r.doc_id: r for r in formatting.format_in_sessions(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {1, 2, 4} and got[2].text is None and got[4].candidates == 0 and got[1].candidates == 1


# --- evaluation


def test_regression_and_style_of_small_cases(spark):
    decide = lambda a, b: rule_of(a["value"], b["value"], a["indent"], b["indent"])
    rows = [(1, "\nif (a) {\n}\nb();\n", "\nif (a) {\n}\n\nb();\n"), (2, "b();\r\n// c\r\nd();  \r\n\r\n", "b();\r\n// c\r\n\r\nd();  \r\n\r\n"), (3, " \n", " \n"), (4, "one", "one")]
    d = spark.createDataFrame(rows, "case_id long, source string, expected string")
    d = evaluation.formatted(evaluation.formatted(d, "source", "actual", decide), "actual", "repeated", decide)
    got = {r.case_id: r for r in d.collect()}
    assert got[1].actual == rows[0][2] and got[2].actual == "b();\r\n\r\n// c\r\nd();  \r\n\r\n" and got[3].actual == " \n" and got[4].actual == "one"
    m = {r.case_id: r for r in evaluation.regression(d, "actual", "repeated", "source", "expected", "case_id").collect()}
    assert [m[k].exact_output for k in (1, 2, 3, 4)] == [True, False, True, True] and all(r.idempotent and r.nonblank_preserved for r in m.values())
    assert [(m[k].gaps_total, m[k].gaps_correct) for k in (1, 2, 3, 4)] == [(2, 2), (2, 0), (0, 0), (0, 0)]
    a = evaluation.assertions(d, "actual", "source", "expected", "case_id").orderBy("case_id", "after_line").collect()
    assert [(r.case_id, r.after_line, r.expected, r.actual, r.passed) for r in a] == [(1, 2, 0, 0, True), (1, 3, 1, 1, True), (2, 1, 0, 1, False), (2, 2, 1, 0, False)]
    s = evaluation.style_counts(evaluation.assertions(d, "actual", "source", "expected", "case_id")).first()
    assert tuple(s) == (4, 2, 2, 1, 2, 1)
    sums = evaluation.regression_sums(evaluation.regression(d.where("case_id <> 2"), "actual", "repeated", "source", "expected"))
    gate = lambda *x: evaluation.regression_gate(sums, *x).first().passed
    assert gate("m", "m", 0.5, 0.5) and not gate("m", "n", 0.5, 0.5) and not gate("m", "m", 0.5, 0.4)


def test_early_stop(spark):
    scores = {"a": [0.5, 0.6, 0.60005, 0.6, 0.6, 0.6, 0.6, 0.9], "b": [0.1, 0.2], "c": [0.3, 0.2, 0.1, 0.2, 0.4, 0.1]}
    rows = [(k, n, s) for k, v in scores.items() for n, s in enumerate(v)]
    random.Random(1).shuffle(rows)
    got = {r.run: (r.best_epoch, r.best_score, r.stopped_at) for r in evaluation.early_stop(spark.createDataFrame(rows, "run string, epoch long, score double"), "run", "epoch", "score").collect()}
    assert got == {"a": (1, 0.6, 6), "b": (1, 0.2, 1), "c": (4, 0.4, 5)}


def test_cases_are_picked_once_and_few_of_a_file():
    found = [(g, d, c) for g in (0, 16, 17) for d in range(3) for c in range(20)]
    picked = pick_cases(found, per_file=3, per_group=30)
    assert len({(d, c) for _, d, c in picked}) == len(picked) == 60
    for g, want in ((0, 30), (16, 30), (17, 0)):
        assert sum(x[0] == g for x in picked) == want
    first = [x for x in picked if x[0] == 0][:9]
    assert all(sum(x[1] == d for x in first) == 3 for d in range(3))


# --- leakage


@pytest.mark.parametrize("automaton", [True, False])
def test_containment_against_brute_force(spark, monkeypatch, automaton):
    if not automaton:
        monkeypatch.setattr(containment, "ahocorasick", None)
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("ab \n") for _ in range(n))
    rows = [(k, word(rng.randint(0, 40))) for k in range(60)] + [(90, None), (91, " ")]
    stated = [(k, word(rng.randint(1, 6))) for k in range(12)] + [(50, None), (51, "\n"), (52, "ab"), (53, "a b")]
    squeeze = lambda t: "".join((t or "").split())
    r, s = spark.createDataFrame(rows, "file_id long, content string"), spark.createDataFrame(stated, "case_id long, input_text string")
    pairs = [(a, b, squeeze(x), squeeze(y)) for (a, x), (b, y) in itertools.product(rows, stated) if squeeze(x) and squeeze(y)]
    for size in (1 << 20, 7):
        assert {tuple(x) for x in containment.containments(r, s, block_bytes=size).collect()} == {(a, b) for a, b, x, y in pairs if y in x}
        assert {tuple(x) for x in containment.containments(r, s, inside=True, block_bytes=size).collect()} == {(a, b) for a, b, x, y in pairs if x in y}
    assert containment.containments(r, s.limit(0)).count() == 0


# --- structure


def test_statements_stand_side_by_side():
    lines = nonblank("a = f(\n  1,\n)\n# note\nif a:\n  b()\n  c()\nd()\n")
    got = {(p.left_first, p.left_last, p.right_first) for p in trees.statements(lines)}
    assert (0, 2, 4) in got and (4, 6, 7) in got and (5, 5, 6) in got and trees.statements([]) == []


def test_regions_of_tests_are_found_by_their_braces():
    text = "fn a() {}\n#[cfg(test)]\nmod tests {\n  fn b() {\n  }\n}\nfn c() {}\n"
    ((start, end),) = trees.excluded(nonblank(text), "rs")
    assert text[start:end] == "#[cfg(test)]\nmod tests {\n  fn b() {\n  }\n}\n"
    assert trees.excluded(nonblank(text), "go") == []
    zig = 'const a = 1;\ntest "x" {\n  b();\n}\nconst c = 2;\n'
    ((start, end),) = trees.excluded(nonblank(zig), "zig")
    assert zig[start:end] == 'test "x" {\n  b();\n}\n'


def test_fingerprints_follow_tokens_nesting_and_literals():
    same = ["a(b);\nc();\n", "a( b ) ;\n\n\n  c();\n"]
    other = ["a(b);\nd();\n", "a(b);{\nc();}\n", "a(b);\n'c()';\n"]
    prints = [trees.fingerprint(t) for t in same + other]
    assert prints[0] == prints[1] and len(set(prints)) == 4
    assert trees.fingerprint("a(") is None and trees.fingerprint("x = '") is None
    assert trees.fingerprint("`a\n\nb`\n") != trees.fingerprint("`a\nb`\n")
    assert trees.safe("a();\nb = `x\n\ny`;\nc();\n") == "ok" and trees.safe("{") == "open"


def test_openers_against_stacks():
    rng = random.Random(2)
    for _ in range(50):
        depths = [max(-1, d) for d in itertools.accumulate(rng.choice([-2, -1, 0, 1, 2]) for _ in range(30))]
        stack, want = [], []
        for k, d in enumerate(depths):
            want.append(stack[-1] if stack else -1)
            stack = stack[: max(d, 0)] + [k] * (max(d, 0) - len(stack))
        assert units.openers(np.array(depths)).tolist() == want


# --- streams, patches


def test_queues_go_on_after_failures_and_debounce_waits(spark):
    at = lambda ms: dt.datetime(2024, 1, 1) + dt.timedelta(milliseconds=ms)
    rows = [(1, 1, at(0), True, None), (2, 1, at(100), False, None), (3, 1, at(400), True, True), (4, 1, at(900), True, None), (5, 1, at(1500), None, False), (6, 2, at(0), True, None)]
    d = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, works boolean, hold boolean")
    got = {r.event_id: (r.place, r.ok, r.done) for r in events.fifo(d, "user_id", ["ts"], F.coalesce("works", F.lit(False))).collect()}
    assert got == {1: (1, True, 1), 2: (2, False, 1), 3: (3, True, 2), 4: (4, True, 3), 5: (5, False, 3), 6: (1, True, 1)}
    fired = {r.event_id for r in events.debounced(d, "user_id", "ts", "180 MILLISECONDS", F.col("hold")).collect()}
    assert fired == {2, 5, 6}


def test_patches_with_moves(spark):
    patch = "*** Move to: lost\n*** Add File: a\n+x\n*** Update File: b\n*** Move to: c\n*** Move to: d\n*** Update File: e"
    assert spark.createDataFrame([(patch,), ("",)], "p string").select(changed_paths(F.col("p")).alias("x")).collect() == [(["a", "d", "e"],), ([],)]


# --- property checks see what breaks them


def test_property_checks_see_breaks(spark, monkeypatch):
    from spangrid.operators import guards, lexing, metrics, model

    texts = spark.createDataFrame([("a b\n",), ("",)], "t string").select("t", F.array_join(F.slice(lexing.tokens(F.col("t")), 1, 2), "").alias("cut"))
    assert [r.cut == r.t for r in texts.collect()] == [False, True]
    assert spark.sql("SELECT is_valid_utf8(CAST(X'61FF' AS STRING)) AS a, is_valid_utf8(CAST(X'61' AS STRING)) AS b").first() == (False, True)
    assert not guards.lines_differ("a();\nb();\n") and not guards.vectors_move("a();\nb();\n")
    render = scanner.render
    monkeypatch.setattr(scanner, "render", lambda text, found, labels: render(text, found, labels).replace("b", "c"))
    assert guards.lines_differ("a();\nb();\n") and guards.vectors_move("a();\nb();\n")
    z = spark.createDataFrame([([1.0, 2.0, 3.0], [3.0, 2.0, 1.0])], "a array<double>, b array<double>")
    r = z.select(metrics.softmax(F.col("a")).alias("x"), model.softmax_batches(F.col("b")).alias("y"), model.softmax_batches(F.col("a")).alias("z")).first()
    assert np.allclose(r.x, r.z) and not np.allclose(r.x, r.y)
