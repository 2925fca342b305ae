"""Training-data operators on small tables: brute force, and nulls, empty and repeated rows, ties and clashing names."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from spangrid.llm import canonical, mixture, neardup, overlap, pieces, prose, provenance, shingles, syntax, tokens
from spangrid.llm.queries import ORACLES, QUERIES

NAMES = ("cls", "k", "t", "a", "b", "e", "doc", "text_a", "valid", "signal", "rn", "band", "form", "own", "limit", "size")


def clashing():
    """Columns that no operator should trip over."""
    return {c: F.lit(c) for c in NAMES}


def corpus(seed=1, n=40):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        words = [f"{rng.choice('abcdefgh')}{rng.randint(0, 400)}" for _ in range(rng.randint(220, 400))]
        rows.append((k, " ".join(words)))
        for j in range(rng.randint(0, 3)):
            copy = list(words)
            for _ in range(rng.choice([0, 1, 4, 12, 30])):
                copy[rng.randrange(len(copy))] = f"z{rng.random()}"
            rows.append((1000 + 10 * k + j, " ".join(copy)))
    return rows + [(9001, None), (9002, ""), (9003, " \n"), (9004, "too short"), rows[0], rows[0]]


def jaccard(a, b):
    x, y = set(shingles.run_set(a).tolist()), set(shingles.run_set(b).tolist())
    return len(x & y) / len(x | y) if x | y else 0


def test_near_duplicates_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "file_id long, content string").withColumns(clashing())
    texts = {k: t for k, t in rows if t and len(shingles.split_words(t)) >= 200}
    want = {(a, b) for a, b in itertools.combinations(sorted(texts), 2) if jaccard(texts[a], texts[b]) >= 0.7}
    got = [tuple(r) for r in neardup.similar_pairs(df).collect()]
    assert sorted(got) == sorted(want) and want
    groups = {r.file_id: r for r in neardup.near_duplicate_groups(df, "file_id", 0.7, 200).collect()}
    assert len(groups) == len({k for k, _ in rows})
    for a, b in want:
        assert groups[a].group_cls == groups[b].group_cls
    assert groups[9001].cls is None and groups[9004].group_records == 1 and groups[9001].group_records == 0


def test_a_hot_group_of_copies(spark):
    base = corpus(3, 1)[0][1]
    rows = [(k, base) for k in range(60)] + [(100, base + " tail"), (101, "x " * 300)]
    got = neardup.similar_pairs(spark.createDataFrame(rows, "file_id long, content string"))
    assert got.count() == 60 * 59 // 2 + 60


def test_overlap_against_brute_force(spark):
    rows = corpus(7)
    train = [t for k, t in rows if k % 2 == 0]
    held = [t for k, t in rows if k % 2] + [" ".join((rows[0][1] or "").split()[40:80])]
    got = {(r.t, r.e) for r in overlap.overlapping_classes(spark.createDataFrame([(t,) for t in train], "content string"), spark.createDataFrame([(t,) for t in held], "content string")).collect()}
    texts = sorted({t for t in train + held if t})
    ids = {r.t: r.h for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    want = set()
    for t, e in itertools.product({x for x in train if x}, {x for x in held if x}):
        runs = set(shingles.run_set(e).tolist())
        if len(shingles.split_words(e)) >= 30 and runs and len(runs & set(shingles.run_set(t).tolist())) >= 0.7 * len(runs):
            want.add((ids[t], ids[e]))
    assert got == want and want


def test_empty_tables(spark):
    files = spark.createDataFrame([], "file_id long, path string, lang string, repository string, content string")
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    limits = spark.createDataFrame([], "lang string, max_bytes int, overlap_bytes int")
    targets = spark.createDataFrame([], "source string, target_share double, max_repeats int")
    assert neardup.similar_pairs(files).count() == 0 and neardup.near_duplicate_groups(files).count() == 0
    assert overlap.overlapping_classes(files.select("content"), files.select("content")).count() == 0
    assert pieces.oversized_pieces(files, limits).count() == 0
    assert provenance.provenance(files).count() == 0 and syntax.syntax_rates(syntax.syntax_verdicts(files)).count() == 0
    assert prose.prose_in_code(files, prose.train_identifier(docs)).count() == 0
    assert tokens.token_ids(docs).count() == 0 and canonical.look_alike_pairs(docs).count() == 0 and canonical.form_report(docs).count() == 0
    records, shares = mixture.mixture(docs, targets)
    assert records.count() == 0 and shares.count() == 0


def test_token_ids(spark):
    rows = [(1, "a b"), (2, ""), (3, None), (3, None), (4, "x" * 40_000)]
    got = tokens.token_ids(spark.createDataFrame(rows, "doc_id long, text string").withColumns(clashing())).collect()
    enc = tokens.encoder(tokens.rank_file())
    assert len(got) == 5
    for r in got:
        assert r.ids == enc.encode_ordinary(dict(rows)[r.doc_id] or "")


def test_look_alikes(spark):
    rows = [(1, "abc"), (2, "ａbc"), (3, "abc"), (4, None), (5, ""), (6, "\u200b"), (7, "Abc"), (2, "ａbc"), (8, "аbc")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns(clashing())
    got = sorted(tuple(r) for r in canonical.look_alike_pairs(df).collect())
    assert got == [(1, 2), (1, 8), (2, 3), (2, 8), (3, 8)]
    assert {r.doc_id: r.canonical for r in canonical.canonical_texts(df).collect()} == {1: "abc", 2: "abc", 3: "abc", 4: None, 5: "", 6: "", 7: "Abc", 8: "abc"}


def test_pieces_of_files(spark):
    text = "".join(f"def f{k}():\n    return 'ä{k}'\n\n" for k in range(200))
    rows = [(1, "py", text), (1, "py", text), (2, None, text[:500]), (3, "xx", "é" * 400), (4, "py", None), (5, "py", "")]
    limits = spark.createDataFrame([("py", 900, 100), ("default", 300, 20)], "lang string, max_bytes int, overlap_bytes int")
    df = spark.createDataFrame(rows, "file_id long, lang string, content string").withColumns(clashing())
    got = pieces.oversized_pieces(df, limits).orderBy("file_id", "piece").collect()
    assert {r.file_id for r in got} == {1, 2, 3}
    for r in got:
        assert r.n_bytes == len(r.text.encode()) <= (900 if r.file_id == 1 else 300)
    whole = {k: t for k, _, t in rows}
    for key in (1, 2, 3):
        joined, end = b"", 0
        for r in [x for x in got if x.file_id == key]:
            assert r.start_byte <= end
            joined += r.text.encode()[end - r.start_byte :]
            end = r.end_byte
        assert joined.decode() == whole[key]
    assert pieces.oversized_pieces(df, limits.where("lang = 'zz'")).count() == 0


def test_mixture_shares_and_caps(spark):
    rng = random.Random(9)
    rows = [(k, " ".join(["word"] * rng.randint(5, 60)), "big" if k % 3 else "small") for k in range(1500)] + [(5000 + k, "tiny text here", "tiny") for k in range(4)]
    rows += [(9001, None, "big"), (9002, "", "big"), (9003, "no source", None), (9004, "not listed", "other"), rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns(clashing())
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 3), ("tiny", 0.05, 2), ("absent", 0.05, 2)], "source string, target_share double, max_repeats int")
    total = 23_000
    for block in (100_000, 37):
        records, shares = mixture.mixture(df, targets, total, block=block)
        got = {r.source: r for r in shares.collect()}
        assert got["tiny"].lacking_tokens == pytest.approx(0.05 * total - 24)
        assert got["absent"].tokens == 0 and got["tiny"].copies == 8
        for name, share in (("big", 0.5), ("small", 0.4)):
            assert got[name].tokens == pytest.approx(share * total, rel=0.02)
        assert all(r.most_copies <= r.max_repeats for r in got.values())
        assert records.count() == 1504 and records.where("doc_id > 9000").count() == 0
        assert sorted(records.collect()) == sorted(mixture.mixture(df, targets, total, block=block)[0].collect())


def test_mixture_keeps_shares_to_one_another(spark):
    """By default the size is the largest at which no source that occurs lacks anything."""
    rows = [(k, "word " * 9 + "end", "big") for k in range(4000)] + [(5000 + k, "word " * 9 + "end", "small") for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.3, 2), ("absent", 0.1, 2), ("barred", 0.0, 0)], "source string, target_share double, max_repeats int")
    got = {r.source: r for r in mixture.mixture(df, targets)[1].collect()}
    assert got["small"].copies == 400 and got["small"].lacking_tokens == 0 and got["big"].copies == 800
    assert got["big"].reached_share == pytest.approx(0.6 / 0.9) and got["absent"].tokens == got["barred"].tokens == 0



def test_prose_syntax_and_provenance_of_files(spark):
    rows = [
        (1, "r/a", "typescript", "src/a.ts", "// Please try again after the value has been saved.\nf();\n"), (2, "r/a", "java", "src/A.java", "class A {"), (3, None, None, "vendor/b/c.py", "x = 1\n"), (4, "r/b", "go", None, "package a\n"),
        (5, "r/b", "go", "a.go", None), (6, "r/b", "go", "b.go", " \n"), (7, "r/b", "go", "c.txt", "free text"), (2, "r/a", "java", "src/A.java", "class A {"),
    ]
    df = spark.createDataFrame(rows, "file_id long, repository string, lang string, path string, content string").withColumns(clashing())
    found = prose.prose_in_code(df, prose.build_identifier([], [])).collect()
    assert [(r.file_id, r.nl_lang) for r in found] == [(1, "en")] and 0 < found[0].share < 1
    v = {r.file_id: r for r in syntax.syntax_verdicts(df).collect()}
    assert set(v) == {1, 2, 3} and not v[2].valid and v[2].cause == "truncation" and v[2].cost >= 1
    rates = {(r.repository, r.lang): (r.files, r.invalid) for r in syntax.syntax_rates(syntax.syntax_verdicts(df)).collect()}
    assert rates[("r/a", "java")] == (1, 1)
    p = {r.file_id: (r.signal, r.recurring) for r in provenance.provenance(df).collect()}
    assert p[3] == ("vendored", False) and p[1] == (None, False) and p[5] == (None, False) and len(p) == 7


def test_recurring_files(spark):
    text = " ".join(f"call{k}(x, {k});" for k in range(200))
    rows = [(k, f"owner{k}/repo", "a.ts", text + f" own{k}();") for k in range(6)] + [(50, "owner9/repo", "a.ts", " ".join(f"other{k}(y);" for k in range(200)))]
    df = spark.createDataFrame(rows, "file_id long, repository string, path string, content string")
    p = {r.file_id: r.recurring for r in provenance.provenance(df).collect()}
    assert all(p[k] for k in range(6)) and not p[50]


def test_recurrence_tells_copies_of_tool_written_files(spark, tmp_path):
    def body(word):
        rng = random.Random(word)
        expr = lambda d: f"{word}{rng.randint(0, 99)}" if d == 0 or rng.random() < 0.2 else rng.choice(["{} + {}", "f({}, {})", "({}) * {}", "g({})[{}]"]).format(expr(d - 1), expr(d - 1))
        return "".join(f"let {word}{k} = {expr(3)};\n" for k in range(60))

    note = "// Code generated by stubs. DO NOT EDIT.\n"
    rows = [(k, f"owner{k}/repo", "a.ts", note + body("made")) for k in range(6)]
    rows += [(10, "owner10/repo", "src/own.ts", "\n" + body("made")), (11, "owner10/fork", "src/own.ts", body("made") + "tail();\n"), (12, None, "b.ts", body("made"))]
    # hand-written and widely copied, kept in a tool's folder by some; written by a tool for one owner only; vendored, copied without a note
    rows += [(20 + k, f"owner{k}/repo", "gen/b.ts" if k < 5 else "src/b.ts", body("hand")) for k in range(9)]
    rows += [(30 + k, f"owner5/repo{k}", "a.ts", note + body("once")) for k in range(6)] + [(36, "owner6/repo", "a.ts", body("once"))]
    rows += [(40 + k, f"owner{k}/repo", "vendor/c.ts", body("lib")) for k in range(6)] + [(46, "owner7/repo", "src/c.ts", body("lib"))]
    df = spark.createDataFrame(rows, "file_id long, repository string, path string, content string")
    want = {*range(6), 10, 11, 12, *range(20, 25), *range(30, 36), *range(40, 46)}
    df.write.parquet(f"{tmp_path}/source_files.parquet")
    found = [r.file_id for r in QUERIES["p2_found"](spark, str(tmp_path)).collect()]
    assert sorted(found) == sorted(want)
    p = {r.file_id: (r.signal, r.recurring) for r in provenance.provenance(df.withColumns(clashing())).collect()}
    assert {k for k, (signal, _) in p.items() if signal} == want and p[10] == ("generated", True) and p[25] == (None, True) and p[36] == (None, False)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_every_query_runs(name, spark, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    rows = df.collect()
    if name.endswith("_found"):
        assert len(rows) == len(set(rows))
    if name in ORACLES:
        import duckdb

        con = duckdb.connect()
        for t in ("source_files", "size_limits"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        assert sorted(map(tuple, rows)) == sorted(con.execute(ORACLES[name]).fetchall())


def test_overlap_of_short_records_with_common_runs(spark):
    """Insertions that leave over 0.7 of the runs and two winnowed ones, which other training texts hold too."""
    words = [f"w444339_{k}" for k in range(49)]
    held = " ".join(words)
    edited = list(words)
    for at in (35, 24, 13):
        edited.insert(at, "new")
    near = " ".join(edited)
    others = [" ".join([f"x{j}_{k}" for k in range(40)] + words[3:8] + [f"y{j}"] + words[38:43]) for j in range(6)]
    a = shingles.run_set(held)
    assert shingles.shared(a, shingles.run_set(near)) >= 0.7 * len(a)
    assert len(set(shingles.fingerprints(held, 8)) & set(shingles.fingerprints(near, 8))) == 2
    frame = lambda texts: spark.createDataFrame([(t,) for t in texts], "content string")
    assert overlap.overlapping_classes(frame([near, *others]), frame([held])).count() == 1


def test_a_run_that_every_text_holds_and_any_cut(spark, monkeypatch):
    """2,000 texts share a notice; only the edited copies of a record are its partners, whatever is left out of the join."""
    notice = "this notice stands at the head of each and every file of the whole collection without any change"
    train = [f"{notice} " + " ".join(f"t{k}_{n}" for n in range(30)) for k in range(2000)]
    body = [f"e_{n}" for n in range(120)]
    held = [f"{notice} " + " ".join(body), f"{notice} " + " ".join(f"z{n}" for n in range(30))]
    train += [f"{notice} " + " ".join(body[:60] + ["edit"] + body[60:]), " ".join(body)]
    frame = lambda texts: spark.createDataFrame([(t,) for t in texts], "content string")
    ids = {r.content: r.h for r in frame(train + held).select("content", F.xxhash64("content").alias("h")).collect()}
    want = {(ids[t], ids[held[0]]) for t in train[-2:]}
    for cut in (0.31, 0.5, 1.0):
        assert {(r.t, r.e) for r in overlap.overlapping_classes(frame(train), frame(held), cut=cut).collect()} == want
    monkeypatch.setattr(overlap, "LATE", 0)
    assert {(r.t, r.e) for r in overlap.overlapping_classes(frame(train), frame(held), cut=0.31).collect()} == want


def test_coverage_is_united_over_training_texts(spark):
    rows = [("a", 10, [(0, 4)]), ("a", 10, [(2, 6), (8, 9)]), ("a", 10, [(0, 3)]), ("b", 4, [(0, 4)]), (None, 2, [(1, 2)])]
    spans = spark.createDataFrame(rows, "k string, words int, spans array<struct<at:int,upto:int>>")
    assert {r.k: r.coverage for r in overlap.united_coverage(spans, ["k"]).collect()} == {"a": 0.7, "b": 1.0, None: 0.5}


def test_groups_of_many_near_copies_without_all_pairs(spark):
    """400 texts that differ from one another in a word, and a chain whose ends are far apart."""
    rng = random.Random(3)
    base = [f"w{k}" for k in range(260)]
    rows = [(k, " ".join([*base[: k % 250], f"edit{k}", *base[k % 250 + 1 :]])) for k in range(400)]
    chain = [f"c{k}" for k in range(300)]
    for k in range(6):
        rows.append((1000 + k, " ".join(chain)))
        for at in rng.sample(range(300), 5):
            chain[at] = f"d{k}_{at}"
    df = spark.createDataFrame(rows, "file_id long, content string")
    signed = neardup.signed_classes(df, 200)
    links = neardup.star_links(df, signed, 0.7)
    assert links.count() < 400 * 40
    pairs = neardup.similar_classes(df, signed, 0.7)
    from spangrid.operators.components import connected_components

    assert sorted(connected_components(links).collect()) == sorted(connected_components(pairs.select("a", "b")).collect())
    got = {r.file_id: r for r in neardup.near_duplicate_groups(df, "file_id", 0.7, 200).collect()}
    assert len({got[k].group_cls for k in range(400)}) == 1 and got[0].group_records == 400
    assert got[1000].group_cls != got[0].group_cls and all(r.copies == 0 for r in got.values())
