"""Parts of the training-data operators that need no Spark, against brute force and round trips."""

import itertools
import math
import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spangrid.llm import arrow, canonical, chart, mixture, overlap, pieces, prose, provenance, shingles, superminhash, syntax, tokens
from spangrid.llm.lexers import blanked, extension

# --- shingles, winnowing, signatures


def test_words_and_runs():
    assert shingles.split_words("Foo_1(bar, 'Ä');") == ["foo_1", "(", "bar", ",", "'", "ä", "'", ")", ";"]
    assert len(shingles.run_set("a b c d")) == 0 and len(shingles.run_set("a b c d e")) == 1
    assert shingles.shared(np.array([1, 3, 5], np.uint64), np.array([3, 5, 9], np.uint64)) == 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=0, max_size=60), st.integers(1, 9))
def test_winnowing_selects_a_minimum_of_every_window(values, window):
    h = np.array(values, dtype=np.uint64)
    got = set(shingles.winnow(h, window).tolist())
    want = set()
    for k in range(max(1, len(values) - window + 1) if values else 0):
        part = values[k : k + window]
        want.add(k + max(i for i, v in enumerate(part) if v == min(part)))
    assert got == want


WINDOW = 8


def test_shared_runs_leave_a_shared_fingerprint():
    rng = random.Random(1)
    for _ in range(50):
        common = [f"w{rng.random()}" for _ in range(WINDOW + shingles.RUN - 1)]
        a, b = (" ".join([f"x{rng.random()}" for _ in range(40)] + common + [f"y{rng.random()}" for _ in range(40)]) for _ in range(2))
        assert shingles.shared(shingles.fingerprints(a, WINDOW), shingles.fingerprints(b, WINDOW))


def test_superminhash_estimates_jaccard():
    rng = np.random.default_rng(4)
    errors = []
    for _ in range(40):
        both, a, b = (rng.integers(0, 2**63, 300, dtype=np.uint64) for _ in range(3))
        x, y = np.unique(np.concatenate([both, a[:100]])), np.unique(np.concatenate([both, b[:100]]))
        errors.append(superminhash.estimate(superminhash.signature(x, 256), superminhash.signature(y, 256)) - 300 / 500)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.045
    x = rng.integers(0, 2**63, 20, dtype=np.uint64)
    assert (superminhash.signature(x, 64) == superminhash.signature(x[::-1].copy(), 64)).all()
    assert np.isinf(superminhash.signature(x[:0], 8)).all() and np.isfinite(superminhash.signature(x[:1], 8)).all()
    keys = superminhash.band_keys(superminhash.signature(x, 8), 4)
    assert len(set(keys.tolist())) == 2


def test_chain_and_coverage():
    a = shingles.word_hashes(" ".join(f"a{k}" for k in range(60)))
    b = np.concatenate([shingles.word_hashes("p q r"), a[:25], shingles.word_hashes("z"), a[26:]])
    got = overlap.covered(a, b, shingles.run_hashes(a), shingles.run_hashes(b))
    assert got == pytest.approx(59 / 60)
    assert overlap.chain(np.array([1, 2, 3], np.uint64), np.array([3, 2, 1], np.uint64)) and overlap.chain(a[:0], b) == []


def test_no_partner_lacks_the_minima_asked_for():
    """Whatever three tenths of a record's runs a partner lacks, it shares `least` of what the record sends."""
    rng = random.Random(5)
    for m in (26, 27, 40, 90, 300):
        text = " ".join(f"w{m}_{k}" for k in range(m + shingles.RUN - 1))
        batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], ["e", "content"])
        out = next(overlap._record_minima(30, 0.7, overlap.CUT)(iter([batch])))
        sent, least = set(out["prints"][0].as_py()) | set(out["more"][0].as_py()), out["least"][0].as_py()
        runs = np.unique(shingles.run_hashes(shingles.word_hashes(text)))
        for _ in range(30):
            kept = rng.sample(list(range(m)), math.ceil(0.7 * m - 1e-9))
            low, high = overlap._minima(runs[sorted(kept)], overlap.CUT)
            assert len(sent & set(np.concatenate([low, high]).astype(np.int64).tolist())) >= least
        hot = np.array(sorted(sent, reverse=True)[: m // 2], dtype=np.int64)
        probed = next(overlap._probes(hot)(iter([out])))
        left, asked = set(probed["prints"][0].as_py()), probed["least"][0].as_py()
        assert len(sent) - len(left) == least - asked and asked >= min(least, overlap.NEEDED)


# --- tokens


@pytest.fixture(scope="module")
def enc():
    return tokens.encoder(tokens.rank_file())


def test_tree_concatenation_equals_direct_encoding(enc):
    rng = random.Random(3)
    for alphabet, n in (("ab", 3000), ("aaaaaaaab", 5000), ("あ漢x", 2000), ("!?-", 3000), ("0123456789", 4000), (" ", 2500)):
        piece = "".join(rng.choice(alphabet) for _ in range(n)).encode()
        want = enc._encode_single_piece(piece)
        for leaf in (7, 64, 501):
            assert tokens.encode_piece(enc, piece, leaf) == want


def test_texts_with_and_without_long_pieces(enc):
    long = "x" * 5000 + " tail  \n\n" + "é" * 4000 + "   " + "=" * 9000 + "\n<|endoftext|> ok   "
    for text in ("", " ", "a b", "naïve  text\n\n end ", long, long * 3):
        assert tokens.encode_text(enc, text, leaf=256, text_leaf=20_000) == enc.encode_ordinary(text)


def test_ids_agree_with_the_other_library(enc):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{tokens.DEFAULT_FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    for text in ("for (int i = 0; i < n; i++) {\n\treturn;\n}", "Здравствуй, мир! 你好 <|endoftext|>", "  a   b\u00a0c"):
        assert t.encode(text, add_special_tokens=False).ids == tokens.encode_text(enc, text)


@pytest.mark.parametrize("leaf", [7, 64, 1024])
def test_long_texts_are_joined_from_halves(enc, leaf):
    rng = random.Random(leaf)
    texts = ["", "word", " " * 3000, "x" * 5000, "a \n \n  b" * 400, "it'll we've" * 300, "é漢🍃" * 900, "end " + "y" * 9000 + " end" * 600]
    texts += ["".join(rng.choice(["a", "B", " ", "  ", "\n", "7", "'s", ".", "é", "漢"]) for _ in range(rng.randint(1, 3000))) for _ in range(12)]
    for text in texts:
        assert tokens.encode_text(enc, text, text_leaf=leaf) == enc.encode_ordinary(text)


def test_slices_bound_rows_and_bytes():
    texts = ["x" * n for n in (10, 10, 5000, 10, 0, 3000)] + [None, "y"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts)], ["k", "t"])
    got = [s.column(0).to_pylist() for s in arrow.slices(iter([batch]), 3, 100)]
    assert got == [[0, 1], [2], [3, 4], [5], [6, 7]] and list(arrow.slices(iter([batch.slice(0, 0)]))) == []


def test_signature_in_parts_is_that_of_the_whole(monkeypatch):
    x = np.random.default_rng(8).integers(0, 2**63, 3000, dtype=np.uint64)
    whole = superminhash.signature(x, 64)
    monkeypatch.setattr(superminhash, "TOGETHER", 100)
    assert (superminhash.signature(x, 64) == whole).all()


# --- mixture


@settings(max_examples=80, deadline=None)
@given(st.lists(st.floats(0, 1), max_size=60), st.integers(0, 9))
def test_pivot_keeps_the_sum(p, seed):
    rng = random.Random(seed)
    taken, left, mass = mixture.pivot(p, [rng.random() for _ in p])
    total = sum(x for x in taken if x is not None) + (mass if left is not None else 0)
    assert total == pytest.approx(sum(p), abs=1e-6)
    assert all(x in (0, 1) for k, x in enumerate(taken) if k != left)


def test_pivot_is_unbiased():
    rng, p, n = random.Random(5), [0.2, 0.7, 0.5, 0.9, 0.4], 6000
    hits = np.zeros(5)
    for _ in range(n):
        taken, left, mass = mixture.pivot(p, [rng.random() for _ in p])
        for k, x in enumerate(taken):
            hits[k] += x if x is not None else rng.random() < mass
    assert np.abs(hits / n - p).max() < 0.03


# --- look-alikes


def forms(texts):
    import duckdb
    import pyarrow as pa

    con = duckdb.connect()
    con.register("part", pa.table({"doc": list(range(len(texts))), "text": texts}))
    return [r[1] for r in con.execute(canonical.canonical_sql("text", "part") + " ORDER BY doc").fetchall()]


@pytest.mark.parametrize(
    "a, b",
    [
        ("ｆｏｏ（１）", "foo(1)"), ("ﬁne ﬀ", "fine ff"), ("cafe\u0301", "café"), ("a\u200bb\ufeff\u00ad\u2060c", "abc"), ("a\u00a0b\u2003c\u3000d", "a b c d"), ("раураl", "paypal"), ("ΑΒΕ", "ABE"), ("ё", "ë"),
        ("е\u0301", "é"), ("ab\u200dc\u200c", "abc"), ("Ο\u0301", "Ó"),
        ("Г\u0301П", "Γ\u0301Π"), ("ὀ", "o\u0313"), ("Ὰ", "À"), ("ĳs ǉ", "ijs lj"), ("a\u2066b\u2069c\u061c", "abc"),
    ],
)
def test_same_look(a, b):
    x, y = forms([a, b])
    assert x == y == unicodedata.normalize("NFC", b)


@pytest.mark.parametrize("a, b", [("x²", "x2"), ("Ab", "ab"), ("é", "e"), ("👨\u200d👩\u200d👧", "👨👩👧"), ("⚠\ufe0f", "⚠"), ("Ⅳ", "IV"), ("⅓", "1/3"), ("𝒙", "x"), ("म\u094d\u200dन", "म\u094dन"), ("a\tb", "a b"), ("a  b", "a b"), ("к", "k"), ("a\u202ebc", "abc")])
def test_other_look(a, b):
    x, y = forms([a, b])
    assert x != y


def test_forms_of_null_and_empty():
    assert forms([None, "", "\u200b"]) == [None, "", ""]


# --- pieces


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["", "}", "  x = 1;", "äöü漢字🍃 word", "if (a) {", "y" * 300, "a(';');b();" * 30, "  end"]), max_size=80), st.integers(12, 400), st.integers(0, 390))
def test_pieces_cover_the_text(lines, limit, overlap_):
    data = "\n".join(lines).encode()
    if limit < overlap_ + 7:
        with pytest.raises(ValueError):
            pieces.split(data, limit, overlap_)
        return
    got = pieces.split(data, limit, overlap_)
    assert got[0][0] == 0 and got[-1][1] == len(data)
    for (a, b, _), (c, d, _) in zip(got, got[1:]):
        assert b < d and (overlap_ <= b - c <= overlap_ + 3 or c == 0)
    for a, b, _ in got:
        assert b - a <= limit and data[a:b].decode() is not None


def test_overlaps_are_as_asked():
    assert [b - c for (_, b, _), (c, _, _) in itertools.pairwise(pieces.split(b"x" * 60, 20, 10))] == [10] * len(pieces.split(b"x" * 60, 20, 10)[1:])
    with pytest.raises(ValueError):
        pieces.split(b"x" * 40, 12, 10)


def test_long_lines_are_cut_after_statements():
    line = b'function a(){b(";;;");c()}' * 40
    for a, b, cut in pieces.split(line, 200, 0)[:-1]:
        assert cut == "block" and line[:b].endswith(b"}")
    for a, b, cut in pieces.split(b"call(1, 'a;b');" * 40, 100, 0)[:-1]:
        assert cut == "statement" and (b % 15) == 0


def test_cuts_fall_on_function_ends():
    body = "".join(f"fn f{k}() {{\n    a();\n    b();\n}}\n\n" for k in range(60))
    got = pieces.split(body.encode(), 400, 50)
    assert all(kind in ("function", "end") for _, _, kind in got)
    assert pieces.split(b"short", 100, 10) == [(0, 5, "end")] and pieces.split(b"", 100, 10) == [(0, 0, "end")]
    assert max(b - a for a, b, _ in pieces.split(("x" * 5000).encode(), 300, 20)) <= 300


# --- prose


def test_spans_join_lines_and_literals():
    text = 'a(); // one two\n// three four\nb("x " +\n  "y"); /* c\n * d */\n'
    assert [" ".join(s.split()) for s in prose.spans("ts", text)] == ["one two three four", "x y", "c d"]
    assert list(prose.spans("py", "'''doc'''\nx = 'a'  # n\n"))[0] == "doc"


def test_languages_from_seeds_alone():
    idf = prose.build_identifier([], [])
    for lang, text in prose.SEEDS.items():
        for sentence in [s for s in prose._SENTENCE.split(text) if prose.script_languages(s)]:
            assert idf.language(sentence) == lang
    for code in ("SELECT id FROM spans WHERE len > ?", "if (x.y > 0) { return z; }", "for (let i = 0; i < n; i++) {", "a1,b2,c3,d4,e5,f6", "/usr/local/bin", "key = value * 2 + foo"):
        assert idf.language(code) is None
    assert idf.language("") is None


def test_labels_of_quoting_documents_are_cleaned():
    en = "please try again after the value has been saved"
    rows = [("en", en)] * 9 + [("es", en), ("es", "hay que guardar el valor antes de seguir con la línea")]
    assert ("es", en) not in prose.clean_labels(rows) and ("en", en) in prose.clean_labels(rows)


# --- syntax


GOOD = {
    "ts": "import { a } from './b';\nexport class A<T> extends B implements C {\n  private x: Map<string, T[]> = new Map();\n  async f(a: number, b?: string): Promise<void> {\n    for (const [k, v] of this.x) { if (k) continue; else g(v!); }\n    const h = (z: number) => ({ z, y: `t${z}` });\n    try { await h(1); } catch (e) { throw e; } finally { }\n    switch (a) { case 1: break; default: return; }\n  }\n}\ntype U = A<number> | null;\nenum E { A, B = 2 }\n",
    "js": "const a = 1\nlet b = [1, , 2]\nfunction f({ x, y = 2 }, ...r) { return x ? y : r[0] }\nvar q=function(){for(var i=0;i<3;i++)q[i]^=7};if(a>1){b=2;f()}a&&(b?f(1):f('x'))\nexport default f\n",
    "py": "import os\nfrom .a import (b, c)\n\n@d.e\nclass A(B):\n    \"\"\"Doc.\"\"\"\n    x: int = 3\n\n    async def f(self, *a, b=1, **k) -> list[int]:\n        try:\n            return [y for y in a if y and not b]\n        except (E, G) as e:\n            raise H from e\n        else:\n            pass\n        while x[1:2]: x += 1\n\nif __name__ == '__main__':\n    print(f'{1}', {'a': 1, **z})\n",
    "java": "package a.b;\nimport static c.D.e;\npublic final class A<T extends B> implements C {\n  @Override public <K> List<? super T> f(final int[] a, String... b) throws E {\n    for (Map.Entry<K, T> x : y.entrySet()) { z += (int) x.getValue(); }\n    Runnable r = () -> { return; };\n    int[] q = {1, 2};\n    do { i++; } while (i < 3);\n    return a.length > 0 ? null : new ArrayList<>() {{ add(1); }};\n  }\n}\n",
    "rs": "use a::b::{self, C};\n#[derive(Debug)]\npub struct A<'a> { pub x: &'a str, y: Vec<Option<u8>> }\nimpl<'a> A<'a> {\n    pub fn f(&mut self, n: usize) -> Result<(), E> {\n        let Some(v) = self.y.get(n) else { return Err(E::new()); };\n        match v { Some(1..=3) | None => {}, Some(z) if *z > 4 => g!(z), _ => h(|a| a + 1)?, }\n        while let Some(q) = self.y.pop() { println!(\"{}\", q.unwrap()); }\n        Ok(())\n    }\n}\n",
    "zig": "const std = @import(\"std\");\npub fn f(a: *T, comptime n: usize) !?[]const u8 {\n    var x: [4]u8 = undefined;\n    for (a.items) |i| { if (i.k > 1) continue; }\n    defer a.deinit();\n    const y = a.g() catch |e| return e;\n    while (x.len < n) : (n += 1) {}\n    return switch (y) { .a => null, else => |v| v };\n}\ntest \"t\" { try f(.{}, 1); }\n",
    "go": "package a\n\nimport (\n\t\"fmt\"\n\tb \"c/d\"\n)\n\ntype T struct {\n\tA int `json:\"a\"`\n\tb.C\n}\n\nfunc (t *T) F(x, y int, z ...string) (int, error) {\n\tif v, ok := t.m[x]; ok && v != nil {\n\t\treturn 0, fmt.Errorf(\"%d\", x)\n\t} else if y > 1 {\n\t\tgo func() { ch <- 1 }()\n\t}\n\tfor i := 0; i < 3; i++ {\n\t\ts = append(s, []int{1, 2}...)\n\t}\n\treturn 1, nil\n}\n",
    "cpp": "#include <a>\nnamespace n {\ntemplate <typename T> class A : public B<T> {\n public:\n  explicit A(int x) : x_(x) {}\n  virtual ~A() = default;\n  bool operator==(const A& o) const { return x_ == o.x_; }\n private:\n  std::vector<std::pair<int, T*>> v_{};\n};\nstatic const int k[] = {1, 2};\nint main() { for (auto& e : v) e->f(); auto l = [&](int a) { return a << 1; }; delete p; return 0; }\n}\n",
    "cs": "using A.B;\nnamespace N {\n  public sealed class C<T> : D, IE where T : class {\n    public int X { get; private set; } = 1;\n    [Attr(1)] private readonly Dictionary<string, List<T>> d = new();\n    public async Task<int?> F(ref int a, params string[] b) => await G(out var q);\n    void H() { foreach (var x in d) { if (x is null) throw new E($\"{x}\"); } using (var s = new S()) { } }\n  }\n}\n",
    "rb": "require 'a'\nmodule M\n  class A < B\n    attr_reader :x, :y\n    def f(a, b = 1, *c, d: 2)\n      @x ||= a.map { |e| e + 1 }\n      c.each do |z|\n        next if z.nil?\n        puts \"#{z}\", key: 1\n      end\n      case a\n      when 1, 2 then g\n      else h\n      end\n    rescue E => e\n      raise e unless b\n    end\n  end\nend\n",
    "kt": "package a.b\n\nimport c.D\n\ndata class A(val x: Int = 1, private var y: List<String>?) : B(x), C {\n    companion object { const val K = 1 }\n    override fun f(a: (Int) -> Unit): String = when (x) {\n        1, 2 -> \"a\"\n        in 3..4 -> g { it + 1 }\n        else -> y?.first() ?: throw E()\n    }\n    init {\n        for ((k, v) in m) if (k) continue else println(v)\n    }\n}\n",
    "swift": "import A\n\npublic struct S<T: P>: Q {\n    private(set) var x: [String: Int] = [:]\n    let y: T?\n    var z: Int { return x.count }\n    init?(_ a: Int, with b: T...) throws { guard let c = a as? Int, c > 1 else { return nil } }\n    func f(a: Int) -> [T] {\n        switch a {\n        case 1, 2:\n            break\n        case let n where n > 3:\n            return x.map { $0.value }\n        default: return []\n        }\n    }\n}\nenum E { case a(Int), b }\n",
}


@pytest.mark.parametrize("ext", GOOD)
def test_valid_source_is_accepted(ext):
    v = syntax.judge(ext, GOOD[ext])
    assert v.valid, syntax.language(ext).check(GOOD[ext])
    assert syntax.judge(ext, GOOD[ext].replace("\n", "\r\n")).valid


@pytest.mark.parametrize("ext", GOOD)
def test_damage_is_found(ext):
    text = GOOD[ext]
    half = text[: text.rfind("(")] + "("
    assert not syntax.judge(ext, half).valid
    line = text.index("\n", len(text) // 3) + 1
    marked = text[:line] + "<<<<<<< HEAD\n" + text[line : line + 1] + "\n=======\n>>>>>>> x\n" + text[line:]
    v = syntax.judge(ext, marked)
    assert not v.valid and v.cause == "conflict"
    assert not syntax.judge(ext, "<!DOCTYPE html>\n<html><body><p class=\"a\">x</p></body></html>\n").valid


def test_markers_in_literals_and_comments_are_fine():
    assert syntax.judge("js", "const a = `\n<<<<<<< HEAD\n=======\n>>>>>>> x\n`;\n").valid
    assert syntax.judge("py", "# <<<<<<< HEAD\nx = '''\n=======\n'''\n").valid


def test_very_long_parts():
    terms = " + ".join(f"f{k}(x, {k}).y" for k in range(3000))
    assert syntax.judge("js", f"var a = {terms};\n").valid and not syntax.judge("js", f"var a = {terms} +;\n").valid
    names = ",".join(f"a{k}={k}" for k in range(4000))
    assert syntax.judge("js", f"var {names};").valid and not syntax.judge("js", f"var {names},;").valid
    assert syntax.judge("py", "x = [" + ", ".join(map(str, range(20000))) + "]\n").valid
    assert syntax.judge("java", "class A { static final String D = \"" + "A" * 300_000 + "\"; }\n").valid


def test_other_languages_are_named():
    assert syntax.judge("ts", GOOD["js"]).valid and not syntax.judge("js", GOOD["ts"]).valid
    v = syntax.judge("java", GOOD["py"])
    assert not v.valid and (v.cause, v.other) == ("mismatch", "py")
    assert syntax.judge("py", "def f(a):\n\ndef g(b):\n    pass\n").valid is False


def test_long_parts_are_parsed_like_short_ones():
    for n in (10, 300):
        calls = " + ".join(f"f{k}(x, {k}).y" for k in range(n))
        assert syntax.judge("js", f"var a = {calls};\n").valid
        assert not syntax.judge("js", f"var a = {calls} + f(x y).y;\n", False).valid
        names = ", ".join(f"a{k}" for k in range(n))
        assert syntax.judge("js", f"var {names};\n").valid
        assert not syntax.judge("js", f"var {names}, 5, b;\n", False).valid


def test_chart_against_all_strings_of_a_grammar():
    from itertools import product

    g = chart.Grammar("S = E\nS = L\nE = E + E\nE = E * E\nE = T\nL = T , L\nL = T ; M\nM = L\nM = T\nT = a\nT = - T\n")
    good: dict[str, set[str]] = {name: set() for name in ("S", "E", "L", "M", "T")}
    changed = True
    while changed:  # all strings of up to seven tokens, by applying the rules until nothing is new
        rules = {"T": {"a"} | {"-" + t for t in good["T"]}, "M": good["L"] | good["T"], "L": {t + "," + x for t in good["T"] for x in good["L"]} | {t + ";" + m for t in good["T"] for m in good["M"]}}
        rules |= {"E": good["T"] | {a + op + b for a in good["E"] for b in good["E"] for op in "+*" if len(a + b) < 7}, "S": good["E"] | good["L"]}
        new = {name: {s for s in found if len(s) <= 7} for name, found in rules.items()}
        changed, good = new != good, new
    for s in map("".join, (x for n in range(1, 8) for x in product("a+,;-", repeat=n))):
        assert g.starts_of(s, lambda c: frozenset(c), good) == {name for name in good if s in good[name]}, s


def test_least_repair_against_brute_force():
    g = chart.Grammar("S = a S b\nS = a b\n")
    terms = lambda c: frozenset({c})
    good = {"ab", "aabb", "aaabbb", "aaaabbbb"}

    def distance(s, t):
        row = list(range(len(t) + 1))
        for x in s:
            now = [row[0] + 1]
            for k, y in enumerate(t):
                now.append(min(now[-1] + 1, row[k + 1] + 1, row[k] + (x != y)))
            row = now
        return row[-1]

    rng = random.Random(2)
    for _ in range(60):
        s = "".join(rng.choice("abc") for _ in range(rng.randint(0, 7)))
        assert g.repair(s, terms, ["S"])[0] == min(distance(s, t) for t in good)
        assert bool(g.starts_of(s, terms, ["S"])) == (s in good)


def test_python_agrees_with_the_compiler():
    import ast

    for text in ("x = 1\n", "def f():\n  return\n", "if x:\ny = 1\n", "try:\n  a\nb\n", "a = [1,\n 2]\n", "for x in y: pass\n", "else:\n  a\n", "  a = 1\n", "class A: pass\n", "a = (1\n", "x = lambda: 0\n", "del a, b\n", "f(**a, *b)\n"):
        try:
            ast.parse(text)
            ok = True
        except SyntaxError:
            ok = False
        assert syntax.judge("py", text).valid == ok or text.startswith("f(**"), text


# --- provenance


@pytest.mark.parametrize(
    "path, text, want",
    [
        ("vendor/x/a.ts", "f();\n", "vendored"), ("lib/vendor_api/a.ts", "f();\n", ""), ("src/a.min.js", "f();\n", "minified"), ("src/minifier/a.js", "f();\n", ""), ("gen/a.go", "package a\n", "generated"), ("src/generators/a.go", "package a\n", ""),
        ("a.go", "// Code generated by stubs. DO NOT EDIT.\npackage a\n", "generated"), ("a.go", "// Do not edit the buffer after the cache has been sealed.\npackage a\n", ""), ("a.go", "// Copied unchanged from the upstream tree of x 1.2\npackage a\n", "vendored"),
        ("a.js", "var a=1;" * 400, "minified"), ("a.java", "<!DOCTYPE html>\n<html></html>\n", "page"), ("a.zig", "version lfs/1\noid sha256:" + "ab" * 32 + "\nsize 3\n", "pointer"), ("a.ts", '{"a": [1, 2], "b": {"c": null}}\n', "data"),
        ("a.rs", "pub static A: &[u8] = &[\n" + "    0x01, 0x02, 0x03, 0x04,\n" * 40 + "];\n", "data"), ("a.py", "x = '" + "A" * 90 + "'\n" + "".join(f"def f{k}(a):\n    return a + {k}\n\n\n" for k in range(3)), ""), ("a.py", "", ""), (None, "f()\n", ""),
        ("a.ts", "".join(f'export const A{k} = {{ name: "a{k}", tag: {k} }};\n' for k in range(40)), "generated"),
    ],
)
def test_file_signals(path, text, want):
    assert provenance.file_signal(path, text) == want


def test_lexers_blank_comments_and_strings():
    assert blanked("js", "a('x', /\"/g) // y\n").replace(" ", "") == 'a(",")\n'
    assert blanked("rs", "fn f<'a>(x: &'a str) { g('b') }").count('"') == 1
    assert extension("a/b.TS") == "ts" and extension("a.b/c") == "" and extension(None) == ""


def test_notes_anywhere_in_a_file():
    lines = "".join(f"import pkg{k}.part{k * 7};\n" for k in range(200)) + "\n"
    body = "class A {\n" + "".join(f"    int f{k}(int a) {{ return a * {k} + g{k * 3}(a); }}\n\n" for k in range(30)) + "}\n"
    assert provenance.note_signal("java", lines + body) == ""
    for note, want in (("// @generated", "generated"), ("// Vendored from lib 1.2, unchanged", "vendored"), ("/* Changes to this file will be lost. */", "generated"), ("// mirrored from foo 1.2", "vendored"), ("// local patches are listed below", "vendored")):
        assert provenance.note_signal("java", lines + note + "\n" + body) == want, note
    for note in ("// the event is emitted by the parser", "// limits taken from RFC 7231", "// origin: the top left corner", "// unsaved changes will be lost", "// sizes extracted from the first 4 bytes"):
        assert provenance.note_signal("java", lines + note + "\n" + body) == "", note
    for note in ("DO NOT MODIFY THIS FILE BY HAND", "changes will be lost", "source of truth is schema.x"):
        assert provenance.note_signal("java", f"// {note}\nclass A {{}}\n") == "generated", note
    for note in ("mirrored from foo 1.2", "local patches are kept"):
        assert provenance.note_signal("java", f"// {note}\nclass A {{}}\n") == "vendored", note
    assert provenance.content_signal("js", "<!-- " + "word " * 200 + "-->\n<!-- b -->\n<div>\n</div>\n") == "page"


# notes in words that no sample table has; what is told apart is said in the pattern, not where it stands
TOLD = """Emitted from schema.idl; your changes vanish on the next build.
Vendor drop of libfoo 2.3
a nightly job puts it here
Compiled with rulec from rules.peg, please don't touch by hand.
This module is produced by the codegen step.
The exporter rewrites this file every night.
Hand edits get lost, change the template instead.
Your edits will be overwritten the next time the build runs.
Rendered from page.tmpl
DO NOT EDIT.
This whole file was written by a script from the wiki tables.
Not meant to be edited; see gen/.
Any tweaks here disappear when the tables are regenerated.
Regenerate with: make tables
The source of truth lives in the schema repository.
Machine-written code
The build clobbers local changes on every run.
Scaffolded by newproj from the default layout
Verbatim copy of tinyjson 0.9.1
Lifted unchanged from the quickmath sources
Pulled from https://code.example.org/x/y unchanged
Forked from upstream fastmap, see there for history
Report issues upstream, not to us.
Bundled snapshot of minilog
Third-party code, not ours
Imported from parselib 4.2, see NOTICE
The sync bot mirrors this file hourly.
Vendored, version 3.1
Downloaded from zipkit v1.8 without any changes""".splitlines()
UNTOLD = """Do not edit the row after it was sealed.
The generated id is stored with the token.
Auto-generated keys are returned by the driver.
Edits are lost when the window closes.
Changes to the config are picked up at once.
Never change the order of these fields.
Generates the file name from the title.
Created by the caller and handed to the worker.
Written by hand because the generator is slow here.
Values taken from table 4 of the report.
Copied from the input buffer into the output.
The upstream server may be slow to answer.
Returns a copy of the list.
This file may be copied under the terms of the license.
Builds the tree from the tokens.
A third party may call this at any time.
The import script must run first.
The snapshot is taken before the write.
Mirrors the behaviour of the old parser.
The origin of the coordinate system is top left.
Regenerates the session token for a user.
The tool prints a line for each file.
The job is done when the queue is empty.
Overwrites the file if it exists.
We build the index from scratch.
Manual override of the limit.
It is created automatically when the first row arrives.
Run this again after a failure.
Synced to disk once a second.
Derived from the base class""".splitlines()


def test_notes_in_other_words():
    filler = "".join(f"x{k} = {k}\n" for k in range(900))
    for at in (lambda note: f"# {note}\n{filler}", lambda note: f"{filler}# {note}\n{filler}", lambda note: f"{filler}\n# {note}"):
        told = [bool(provenance.note_signal("py", at(n))) for n in TOLD]
        untold = [bool(provenance.note_signal("py", at(n))) for n in UNTOLD]
        missed, wrong = [n for n, x in zip(TOLD, told) if not x], [n for n, x in zip(UNTOLD, untold) if x]
        assert len(missed) <= 1 and len(wrong) <= 2, (missed, wrong)
    assert provenance.note_signal("py", "a = 1  # Vendored, version 3.1\n") == ""


def test_repairs_cover_all_failing_parts_at_any_length():
    cases = {"js": ("f({x});\n", "f(1 2);\n"), "java": ("class A {{ int f = {x}; }}\n", "class A {{ int f = 1 2; }}\n"), "go": ("package a\nvar b = {x}\n", "package a\nvar b = 1 2\n")}
    for ext, (good, bad) in cases.items():
        for n in (3, 40, 400):
            terms = [f"v{k}" for k in range(n)]
            frame = good.replace("{{", "{").replace("}}", "}")
            assert syntax.judge(ext, frame.replace("{x}", " + ".join(terms))).valid
            for at in (0, n // 2, n - 1):
                broken = [*terms[:at], f"{terms[at]} 7", *terms[at + 1 :]]
                verdict = syntax.judge(ext, frame.replace("{x}", " + ".join(broken)))
                assert not verdict.valid and verdict.cost >= 1, (ext, n, at)
        one = syntax.judge(ext, bad.replace("{{", "{").replace("}}", "}"))
        assert not one.valid
    two = syntax.judge("js", "const a = => 1;\ng();\nlet b = => 3;\n")
    assert two.cause == "broken" and two.cost == 2
    assert syntax.judge("js", "f();\ng(1, {\n").cause == "truncation"
    marked = syntax.judge("rs", "fn a() {\n    vec![\n<<<<<<< ours\n1\n=======\n2\n>>>>>>> theirs\n]\n    let x 1;\n}\n")
    assert marked.cause == "conflict"
    assert syntax.judge("js", "def f(x):\n    return x\n").cause == "mismatch"


def _sentences(g, longest):
    """All strings of up to that many terminals, by symbol."""
    good: dict[str, set[str]] = {name: set() for name in g.rules}
    changed = True
    while changed:
        changed = False
        for name, bodies in g.rules.items():
            for body in bodies:
                found = {""}
                for x in body:
                    found = {a + b for a in found for b in (good[x] if x in good else {x}) if len(a + b) <= longest}
                if not found <= good[name]:
                    good[name] |= found
                    changed = True
    return good


def test_search_and_table_find_the_least_repair():
    rng = random.Random(7)
    for text in ("S = E\nE = E + E\nE = T\nT = a\nT = ( E )\nT = ( )\n", "S = A B\nA = a A\nA = c\nB = b B a\nB = d\nS = S ; S\n", "S = x~ T y~ T\nT = a T b\nT = c\nT = S c S\n"):
        g = chart.Grammar(text)
        good = _sentences(g, 9)["S"]
        signs = sorted({x for bodies in g.rules.values() for b in bodies for x in b if x not in g.rules}) + ["?"]
        for _ in range(40):
            s = "".join(rng.choice(signs) for _ in range(rng.randint(0, 6)))
            want = min(_edits(s, t) for t in good)
            for cost, places in (g.repair(s, lambda c: frozenset({c}), ["S"]), chart.Table(g, ["S"]).repair([frozenset({c}) for c in s])):
                assert cost == want and 0 < len(places) <= cost if want else (cost, places) == (0, []), (text, s)


def _edits(s, t):
    row = list(range(len(t) + 1))
    for x in s:
        now = [row[0] + 1]
        for k, y in enumerate(t):
            now.append(min(now[-1] + 1, row[k + 1] + 1, row[k] + (x != y)))
        row = now
    return row[-1]


def test_costs_have_no_bound(monkeypatch):
    # many parts, many edits in a part, a long statement, many lines: each of the faults counts
    assert syntax.judge("js", "const a = => 1;\ng();\n" * 20).cost == 20
    wrong = " + ".join(["v = => 1"] * 9)
    assert syntax.judge("js", f"f({wrong});\n").cost >= 9
    sum_ = " + ".join(f"v{k}" for k in range(60))
    long = f"const a = {sum_} + => {sum_};\n"
    assert syntax.judge("js", long).cost == 1
    by_search = [syntax.judge("js", x).cost for x in (long, "var => = 1 1 1;\n")]
    monkeypatch.setattr(chart, "QUICK", 1)
    monkeypatch.setattr(syntax, "_languages", {})
    assert [syntax.judge("js", x).cost for x in (long, "var => = 1 1 1;\n")] == by_search
    assert any(b.table for b in syntax.language("js").grammar.bounds.values())
    assert syntax.judge("py", "x = = 1\ny = 2\n" * 12).cost == 12
    assert syntax.judge("py", "if x = = 1:\n    y = 2\nelse:\n    z = 3\nw = = 4\n").cost == 2
    assert syntax.judge("rb", "x = = 1\ny = 2\n" * 12).cost == 12


def test_indents_of_any_width():
    wide = " " * 20_000
    assert syntax.judge("py", f"if x:\n{wide}a\n{wide}b\n").valid
    assert not syntax.judge("py", f"if x:\n{wide}a\n{wide} b\n").valid
    assert syntax.judge("py", f"if x:\n{wide}if y:\n{wide} b\n{wide}c\n").valid
