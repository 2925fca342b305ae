import hashlib

from pyspark.sql import functions as F

from spangrid.operators import corpus, features, layout, lexing, roles, units

LINES = [
    "", "end", "end;", "} else {", "return x;", "if (a) {", "const a = 1;", "import a.b;", "a = b", "a.b = c", "a[0] = b", "Foo bar = baz;", "Map<String, List<X>> m = f();", "a == b", "x => y", "f(x)",
    "a.b", "@decorated thing", "@", "12 = a", "foo: bar = baz", "value", "Foo bar;", "x += 1", "a <= b", "{", "// note", "Δx = 3", "try foo.bar(x)", "a != b", "yield", "@ Foo = bar", "a . b c", "A<B<C<D<E<F<G<H<int>>>>>>>> x = y;", "A<B<C<D<E<F<G<H<f(x)>>>>>>>> x;", "a < b(c)", "a.b<c>(d)", "x.1 y", "a.<T>b = c", "名 前 = 1", "a ? b : c = d", "let<", "q >= (r)",
]


def test_roles_agree_with_the_single_line_form(spark):
    rows = spark.createDataFrame([(x,) for x in LINES], "v string").select("v", roles.role(F.col("v")).alias("r")).collect()
    assert {r.v: r.r for r in rows} == {x: units.role(x.encode().decode("latin-1")) for x in LINES}
    assert units.role("Foo bar = baz;") == "binding" and units.role("a.b = c") == "assignment" and units.role("f(x)") == "call"


def test_fnv_equals_the_plain_loop(spark):
    words = ["", "a", "Foo", "名字", "É", "x" * 60]

    def plain(w):
        v = 14695981039346656037
        for b in w.encode():
            v = ((v ^ (b + 32 if 65 <= b <= 90 else b)) * 1099511628211) % 2**64
        return v

    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", lexing.fnv1a(F.col("w")).alias("h"), lexing.unsigned_mod(lexing.fnv1a(F.col("w")), 100).alias("m")).collect()
    for r in got:
        assert r.h % 2**64 == plain(r.w) == features.fnv1a(r.w.encode().decode("latin-1"))
        assert r.m == plain(r.w) % 100


def test_lines_of_odd_texts(spark):
    texts = ["", "\n", "a", "a\n", "a\r\nb", "\n\n", " \t\r\n x"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counts = {r.doc_id: r.n for r in d.select("doc_id", F.size(layout.pieces()).alias("n")).collect()}
    assert [counts[k] for k in range(len(texts))] == [0, 1, 1, 1, 2, 2, 2]
    assert layout.boundaries(d).count() == 1


def test_tokens_are_lossless(spark):
    text = "const 名字 = '🍃';\r\n\r\nΔelta(42)\n\t\x0b x"
    r = spark.createDataFrame([(text,)], "t string").select(lexing.tokens(F.col("t")).alias("x")).first()
    assert "".join(r.x) == text


def test_sketch_and_near_pairs_against_brute_force(spark):
    base = " ".join(f"word{k}" for k in range(300))
    texts = [base, base.replace("word7 ", "other7 "), base + " tail", "short text", "", base.replace("word", "term"), base]
    d = spark.createDataFrame(list(enumerate(texts)) + [(9, None)], "doc_id long, text string")
    p = corpus.fingerprints(d)
    got = {r.doc_id: r for r in p.collect()}
    assert 9 not in got and got[0].digest == got[6].digest

    def brute(text):
        h, out = [features.fnv1a(t) for t in text.split()], set()
        for k in range(len(h) - 4):
            v = 14695981039346656037
            for x in h[k : k + 5]:
                v = ((v ^ x) * 1099511628211) % 2**64
            out.add(v)
        return sorted(out)[:32]

    for k, text in enumerate(texts):
        assert [v % 2**64 for v in got[k].sketch] == brute(text)
    pairs = {(r.a, r.b) for r in corpus.near_pairs(p).collect()}
    want = {(a, b) for a in range(6) for b in range(a + 1, 6) if len(set(brute(texts[a])) & set(brute(texts[b]))) >= 28}
    assert pairs == want
    assert {r.doc_id: r.cluster for r in corpus.clusters(p).collect()}[6] == 0
    assert hashlib.sha256(b"5:short4:text").hexdigest() == got[3].digest
