"""Queries of corpus preparation over the source files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corpus, layout, lexing
from ..session import materialise, table
from .registry import query
from .text_queries import BOUNDS, DOCS, FIRST_WORD, HEADER_SQL, NONBLANK, TOKEN_RE, docs, has_header_mark

_SHOWN = f"list_filter(regexp_extract_all(@, '{TOKEN_RE}'), lambda t: NOT regexp_matches(t, '^[ \\t\\x0B\\f\\r\\n]'))"


def shown(column: str) -> str:
    return _SHOWN.replace("@", column)


CANON = f"sha256(array_to_string(list_transform({shown('text')}, lambda t: strlen(t) || ':' || t), ''))"
_M64 = "18446744073709551616"
_P64 = "1099511628211"
_WORD_HASH = f"""list_reduce(list_prepend(CAST(14695981039346656037 AS HUGEINT), list_transform(range(strlen(t)), lambda k: CAST(('0x' || substr(hex(encode(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))), CAST(2 * k + 1 AS INT), 2)) AS HUGEINT))), lambda a, b: (xor(a, b) * {_P64}) % {_M64})"""


def _fold() -> str:
    out = "CAST(14695981039346656037 AS HUGEINT)"
    for k in (4, 3, 2, 1, 0):
        h = f"lag(h, {k}) OVER w" if k else "h"
        out = f"((xor({out}, {h}) * {_P64}) % {_M64})"
    return out


SKETCHES = f"""{DOCS}, tk AS (SELECT doc_id, unnest(toks) AS t, unnest(range(len(toks))) AS pos FROM (SELECT doc_id, {shown('text')} AS toks FROM docs)),
th AS (SELECT t, {_WORD_HASH} AS h FROM (SELECT DISTINCT t FROM tk)), sh AS (SELECT doc_id, pos, {_fold()} AS v FROM tk JOIN th USING (t) WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
top AS (SELECT doc_id, v, row_number() OVER (PARTITION BY doc_id ORDER BY v) AS r FROM (SELECT DISTINCT doc_id, v FROM sh WHERE pos >= 4)), sk AS (SELECT doc_id, v, r FROM top WHERE r <= 32),
info AS (SELECT doc_id, strlen(text) AS bytes, {CANON} AS digest, split FROM docs), rep AS (SELECT min(doc_id) AS doc_id FROM info GROUP BY digest),
near AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM sk x JOIN sk y ON x.v = y.v AND x.doc_id < y.doc_id JOIN info i ON i.doc_id = x.doc_id JOIN info j ON j.doc_id = y.doc_id
  WHERE x.doc_id IN (SELECT doc_id FROM rep) AND y.doc_id IN (SELECT doc_id FROM rep) AND least(i.bytes, j.bytes) * 4 >= greatest(i.bytes, j.bytes) * 3 GROUP BY ALL HAVING count(*) >= 28)"""
CLUSTERS = (
    SKETCHES.replace(DOCS, "walk_base AS (SELECT 1), " + DOCS, 1)
    + """, edges AS (SELECT a, b FROM near UNION SELECT i.doc_id, r.m FROM info i JOIN (SELECT digest, min(doc_id) AS m FROM info GROUP BY digest) r USING (digest)), twoway AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(a, b) AS (SELECT doc_id, doc_id FROM info UNION SELECT r.a, e.b FROM reach r JOIN twoway e ON e.a = r.b), cl AS (SELECT a AS doc_id, min(b) AS cluster FROM reach GROUP BY a)"""
)


@query("cor01_canonical_digest", f"WITH {DOCS} SELECT doc_id, {CANON} AS digest FROM docs")
def cor01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", corpus.canonical(F.col("text")).alias("digest"))


@query("cor02_sketch", f"WITH {SKETCHES} SELECT doc_id, md5(string_agg(lower(lpad(to_hex(CAST(v AS UBIGINT)), 16, '0')), ',' ORDER BY v)) AS sketch_digest, count(*) AS size FROM sk GROUP BY doc_id")
def cor02(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = corpus.fingerprints(docs(spark, sf_dir)).where("size(sketch) > 0")
    text = F.array_join(F.transform("sketch", lambda v: F.lower(F.lpad(F.hex(v), 16, "0"))), ",")
    return p.select("doc_id", F.md5(text).alias("sketch_digest"), F.size("sketch").cast("long").alias("size"))


@query("jon07_near_pairs", f"WITH {SKETCHES} SELECT a, b, shared FROM near")
def jon07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.near_pairs(corpus.fingerprints(docs(spark, sf_dir)))


@query("set05_sketch_overlap", f"WITH {SKETCHES} SELECT shared, count(*) AS pairs FROM near GROUP BY shared")
def set05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jon07(spark, sf_dir).groupBy(F.col("shared").cast("long").alias("shared")).agg(F.count("*").alias("pairs"))


@query("agg21_sketch_sizes", f"WITH {SKETCHES} SELECT size, count(*) AS files FROM (SELECT doc_id, count(*) AS size FROM sk GROUP BY doc_id) GROUP BY size")
def agg21(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = corpus.fingerprints(docs(spark, sf_dir)).where("size(sketch) > 0")
    return p.groupBy(F.size("sketch").cast("long").alias("size")).agg(F.count("*").alias("files"))


@query("cor03_similar_files", f"WITH {SKETCHES} SELECT a, b FROM near")
def cor03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jon07(spark, sf_dir).select("a", "b")


@query("cor04_clusters", f"WITH RECURSIVE {CLUSTERS} SELECT doc_id, cluster FROM cl")
def cor04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.clusters(corpus.fingerprints(docs(spark, sf_dir)))


_PRIO = "CASE split " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in corpus.PRIORITY.items()) + " ELSE 0 END"


@query("cor05_representatives", f"WITH RECURSIVE {CLUSTERS}, o AS (SELECT cluster, doc_id, row_number() OVER (PARTITION BY cluster ORDER BY {_PRIO} DESC, doc_id) AS rn FROM cl JOIN info USING (doc_id)) SELECT cluster, doc_id FROM o WHERE rn = 1")
def cor05(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = corpus.fingerprints(docs(spark, sf_dir), "split")
    c = corpus.clusters(p)
    return corpus.representatives(c.join(p.select("doc_id", "split"), "doc_id"))


_PATH_HASH = _WORD_HASH.replace("strlen(t)", "strlen(raw)").replace("translate(t,", "translate(raw,")


@query("cor06_split_assignment", f"""WITH f AS (SELECT f.file_id, f.repository || '/' || f.path AS raw, c.source_role AS role, max(CASE WHEN f.layout_corrected THEN f.split END) AS sample FROM source_files f JOIN corpus_sources c ON c.repository = f.repository GROUP BY ALL), h AS (SELECT *, CAST({_PATH_HASH} % 100 AS INT) AS bucket FROM f)
SELECT file_id, CASE WHEN sample IS NOT NULL THEN sample WHEN role = 'style' THEN CASE WHEN bucket < 20 THEN 'style_validation' ELSE 'style_train' END WHEN role = 'test' THEN 'test' WHEN role = 'unseen' THEN 'unseen_language' WHEN bucket < 15 THEN 'validation' ELSE 'train' END AS split FROM h""")
def cor06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split that an edited sample of the file gives, else by the source's role and the path's hash."""
    c = table(spark, sf_dir, "corpus_sources").select("repository", F.col("source_role").alias("role"))
    sample = F.max(F.when(F.col("layout_corrected"), F.col("split"))).alias("sample")
    f = table(spark, sf_dir, "source_files").groupBy("file_id", "repository", "path").agg(sample).join(c, "repository")
    raw = F.concat_ws("/", "repository", "path")
    return f.select("file_id", F.coalesce("sample", corpus.assign_split(lexing.fnv1a(raw), F.col("role"))).alias("split"))


@query("scl12_unsigned_bucket", f"WITH f AS (SELECT DISTINCT path AS raw FROM source_files) SELECT raw AS path, CAST({_PATH_HASH} % 100 AS INT) AS bucket FROM f")
def scl12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "source_files").select("path").distinct().select("path", lexing.unsigned_mod(lexing.fnv1a(F.col("path")), 100).cast("int").alias("bucket"))


@query("scl06_fnv_order", f"WITH f AS (SELECT DISTINCT path AS raw FROM source_files), h AS (SELECT raw, {_PATH_HASH} AS v FROM f) SELECT raw AS path, row_number() OVER (ORDER BY v) <= 32 AS among_smallest FROM h")
def scl06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which paths have the 32 smallest unsigned hashes; the 32 alone come together."""
    h = table(spark, sf_dir, "source_files").select("path").distinct().withColumn("v", lexing.unsigned_order(lexing.fnv1a(F.col("path"))))
    least = h.orderBy("v").limit(32).agg(F.max("v").alias("most"))
    return h.crossJoin(F.broadcast(least)).select("path", (F.col("v") <= F.col("most")).alias("among_smallest"))


@query("srt02_smallest_hashes", f"WITH {SKETCHES} SELECT doc_id, lower(lpad(to_hex(CAST(v AS UBIGINT)), 16, '0')) AS least FROM sk WHERE r = 1")
def srt02(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = corpus.fingerprints(docs(spark, sf_dir)).where("size(sketch) > 0")
    return p.select("doc_id", F.lower(F.lpad(F.hex(F.get("sketch", F.lit(0))), 16, "0")).alias("least"))


_ENC = f"array_to_string(list_transform({shown('value')}, lambda t: strlen(t) || ':' || t), '')"
CONTEXTS = f"""{NONBLANK}, e AS (SELECT doc_id, nb_pos, line_no, {_ENC} AS enc FROM nonblank), cx AS (SELECT doc_id, nb_pos AS boundary_id, lead(line_no) OVER w - line_no - 1 AS blank_lines,
  sha256(string_agg(enc, '') OVER (PARTITION BY doc_id ORDER BY nb_pos ROWS BETWEEN 3 PRECEDING AND 4 FOLLOWING)) AS digest FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY nb_pos)), ctx AS (SELECT * FROM cx WHERE blank_lines IS NOT NULL)"""


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, split, boundary_id, blank_lines, digest; slices of a document's own array instead of a window."""
    nb = layout.with_nonblank(docs(spark, sf_dir)).withColumn("enc", F.transform("nb", lambda x: corpus.encoded_line(x["value"])))
    return nb.select("doc_id", "split", F.explode(corpus.context_digests()).alias("c")).select("doc_id", "split", "c.*")


@query("win05_context_digest", f"WITH {CONTEXTS} SELECT doc_id, boundary_id, digest FROM ctx")
def win05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contexts(spark, sf_dir).select("doc_id", "boundary_id", "digest")


_OWNERS = f"WITH {CONTEXTS}, k AS (SELECT ctx.*, split FROM ctx JOIN (SELECT doc_id, split FROM docs) USING (doc_id) WHERE blank_lines <= 2 AND split <> 'rejected'), o AS (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY {_PRIO} DESC, doc_id, boundary_id) AS rn FROM k)"


def owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.context_owners(contexts(spark, sf_dir).where("blank_lines <= 2 AND split <> 'rejected'"))


@query("cor07_context_owners", _OWNERS + " SELECT digest, doc_id, boundary_id FROM o WHERE rn = 1")
def cor07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return owners(spark, sf_dir)


@query("jon03_owned_rows", _OWNERS + " SELECT doc_id, count(*) AS owned FROM o WHERE rn = 1 GROUP BY doc_id")
def jon03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return owners(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("owned"))


_GIVEN = DOCS.replace("docs AS (", "given AS (", 1)
_EARLY = f"""{_GIVEN}, p AS (SELECT doc_id, list_transform(list_filter(list_zip(range(len(l)), l), lambda x: trim(x[2], chr(32) || chr(9) || chr(13)) <> ''), lambda x: x[1]) AS spots FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM given)),
early AS (SELECT doc_id, split, {HEADER_SQL.replace('{t}', 'text')} AS tool, len(list_filter(range(1, len(spots)), lambda k: spots[k + 1] - spots[k] <= 3)) < 3 AS few FROM given JOIN p USING (doc_id)),
docs AS (SELECT g.* FROM given g JOIN early e USING (doc_id) WHERE NOT e.tool AND NOT e.few AND coalesce(e.split, '') <> 'rejected')"""
_KEPT = f"kept AS (SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY cluster ORDER BY {_PRIO} DESC, doc_id) AS rn FROM cl JOIN info USING (doc_id)) WHERE rn = 1)"


@query("cor08_rejections", f"WITH RECURSIVE {CLUSTERS.replace(DOCS, _EARLY)}, {_KEPT} SELECT CASE WHEN tool THEN 'generated_header' WHEN few THEN 'insufficient_boundaries' WHEN split = 'rejected' THEN 'rejected_before' WHEN kept.doc_id IS NULL THEN 'duplicate' ELSE 'kept' END AS reason, count(*) AS files FROM early LEFT JOIN kept USING (doc_id) GROUP BY ALL")
def cor08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons in order: a tool's mark at the head, fewer than three boundaries of at most two blank lines, rejected
    before, a near copy of a file of higher split priority (of the whole cluster one file stays).

    A text that is no UTF-8 cannot be in a string column (flt01 counts them); reasons that need a syntax tree
    (parse failure, a tree that changes with the gaps) are cor11 to cor13.
    """
    d = layout.with_nonblank(docs(spark, sf_dir))
    # lambdas see elements only, as a filter that is pushed down would work out a whole array anew for each of them
    spots = F.transform("nb", lambda x: x["line_no"])
    close = F.size(F.filter(F.zip_with(spots, F.slice(spots, F.lit(2), F.greatest(F.size(spots) - 1, F.lit(0))), lambda a, b: b - a), lambda gap: gap <= 3))
    d = d.select("doc_id", "split", "text", has_header_mark(F.col("text")).alias("tool"), (close < 3).alias("few"))
    passed = ~F.col("tool") & ~F.col("few") & (F.coalesce("split", F.lit("")) != "rejected")
    p = materialise(corpus.fingerprints(d.where(passed), "split"))
    kept = corpus.representatives(corpus.clusters(p).join(p.select("doc_id", "split"), "doc_id")).select("doc_id", F.lit(True).alias("kept"))
    reason = F.when(F.col("tool"), "generated_header").when(F.col("few"), "insufficient_boundaries").when(F.col("split") == "rejected", "rejected_before").when(F.col("kept").isNull(), "duplicate").otherwise("kept")
    return d.drop("text").join(kept, "doc_id", "left").groupBy(reason.alias("reason")).agg(F.count("*").alias("files"))


_FW = FIRST_WORD
_KIND_SQL = "CASE WHEN {w} IN ('const', 'let', 'var', 'val') THEN 'binding' WHEN {w} IN ('if', 'switch', 'match') THEN 'conditional' WHEN {w} IN ('for', 'while', 'loop') THEN 'loop' WHEN {w} IN ('return', 'yield') THEN 'result' WHEN {w} IN ('import', 'use', 'package') THEN 'import' ELSE 'other' END"


@query("cor09_statement_labels", f"WITH {BOUNDS}, k AS (SELECT {_KIND_SQL.format(w=_FW.format(v='lv'))} AS lk, {_KIND_SQL.format(w=_FW.format(v='rv'))} AS rk, substr(rv, 1, 1) IN ('}}', ')', ']') AS s, suffix(lv, '{{') AS lm, suffix(rv, '{{') AS rm FROM bounds) SELECT CASE WHEN s THEN 0 WHEN lm OR rm OR lk <> rk THEN 1 ELSE 0 END AS label, count(*) AS n FROM k GROUP BY ALL")
def cor09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weak labels from statement kinds; kinds come from first words, as no external parser is at hand."""
    b = layout.boundaries(docs(spark, sf_dir)).select(F.col("l.value").alias("lv"), F.col("r.value").alias("rv"))

    def kind(c: str):
        w = lexing.first_word(F.col(c))
        return F.when(w.isin("const", "let", "var", "val"), "binding").when(w.isin("if", "switch", "match"), "conditional").when(w.isin("for", "while", "loop"), "loop").when(w.isin("return", "yield"), "result").when(w.isin("import", "use", "package"), "import").otherwise("other")

    label = corpus.statement_label(F.substring("rv", 1, 1).isin("}", ")", "]"), F.col("lv").endswith("{"), F.col("rv").endswith("{"), kind("lv"), kind("rv"))
    return b.groupBy(label.alias("label")).agg(F.count("*").alias("n"))


@query("cor14_layout_corrected", "WITH f AS (SELECT file_id, bool_or(coalesce(sha256(content) <> sha256, false)) AS corrected, max(boundaries) AS boundaries, max(split) AS split FROM source_files WHERE content IS NOT NULL GROUP BY file_id) SELECT file_id, corrected, CASE WHEN corrected THEN 0 ELSE coalesce(boundaries, 0) END AS allowed_boundaries, corrected AND coalesce(split = 'rejected', false) AS rejected_edit FROM f")
def cor14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose text is not the one recorded: nothing of their layout is allowed any more, and one that was rejected
    before is an error."""
    f = table(spark, sf_dir, "source_files").where("content IS NOT NULL")
    changed = F.coalesce(F.sha2("content", 256) != F.col("sha256"), F.lit(False))
    f = f.select("file_id", "boundaries", "split", changed.alias("c")).groupBy("file_id").agg(F.bool_or("c").alias("corrected"), F.max("boundaries").alias("boundaries"), F.max("split").alias("split"))
    allowed = F.when(F.col("corrected"), 0).otherwise(F.coalesce("boundaries", F.lit(0)))
    return f.select("file_id", "corrected", allowed.alias("allowed_boundaries"), (F.col("corrected") & F.coalesce(F.col("split") == "rejected", F.lit(False))).alias("rejected_edit"))


@query("cor15_feedback_rows", f"WITH {BOUNDS} SELECT regexp_extract(path, '^([^/]*)/', 1) AS folder, count(*) AS n FROM bounds JOIN (SELECT doc_id, path, layout_corrected FROM docs) USING (doc_id) WHERE layout_corrected AND blank_lines <= 2 GROUP BY ALL")
def cor15(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = layout.boundaries(docs(spark, sf_dir).where("layout_corrected"), "path").where("blank_lines <= 2")
    return b.groupBy(F.regexp_extract("path", "^([^/]*)/", 1).alias("folder")).agg(F.count("*").alias("n"))


@query("cor16_materialised_samples", "WITH g AS (SELECT case_id, ext, list_filter(list_transform(string_split(input_text, chr(10)), lambda x: rtrim(x, chr(13))), lambda x: trim(x, chr(32) || chr(9) || chr(13)) <> '') AS l FROM golden_pairs), n AS (SELECT ext, count(*) >= 30 AS enough FROM g WHERE len(l) > 0 GROUP BY ext) SELECT case_id, md5('begin' || chr(10) || array_to_string(list_transform(range(len(l)), lambda k: l[k + 1] || repeat(chr(10), 1 + k % 2)), '') || 'end' || chr(10)) AS digest, array_to_string(list_transform(range(len(l)), lambda k: k % 2), ',') AS gaps, CASE WHEN suffix(l[len(l)], chr(92)) THEN len(l) END AS held_line, enough FROM g JOIN n USING (ext) WHERE len(l) > 0")
def cor16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Golden inputs between wrapper lines, with gaps of 0 and 1 in turn, the gaps as a list, the last line if the gap
    after it may not change (it continues), and whether its language has the thirty samples that are asked for."""
    lines = "filter(transform(split(input_text, '\\n', -1), x -> rtrim('\\r', x)), x -> trim(BOTH ' \\t\\r' FROM x) <> '')"
    g = table(spark, sf_dir, "golden_pairs").select("case_id", "ext", F.expr(lines).alias("l")).where("size(l) > 0")
    enough = g.groupBy("ext").agg((F.count("*") >= 30).alias("enough"))
    body = F.expr("array_join(transform(l, (x, k) -> concat(x, repeat('\\n', 1 + k % 2))), '')")
    gaps = F.expr("array_join(transform(l, (x, k) -> CAST(k % 2 AS STRING)), ',')")
    held = F.when(F.get("l", F.size("l") - 1).endswith("\\"), F.size("l").cast("long"))
    return g.join(enough, "ext").select("case_id", F.md5(F.concat(F.lit("begin\n"), body, F.lit("end\n"))).alias("digest"), gaps.alias("gaps"), held.alias("held_line"), "enough")


@query("cor17_safe_paths", "SELECT path, NOT (regexp_matches(path, '^/|^$|\\\\') OR regexp_matches(path, '(^|/)\\.\\.?(/|$)') OR regexp_matches(path, '//')) AS safe FROM (SELECT DISTINCT unnest([path, '../' || path, 'a/../' || path, '/' || path, replace(path, '/', '//')]) AS path FROM source_files)")
def cor17(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    each = F.array(p, F.concat(F.lit("../"), p), F.concat(F.lit("a/../"), p), F.concat(F.lit("/"), p), F.replace(p, F.lit("/"), F.lit("//")))
    return table(spark, sf_dir, "source_files").select(F.explode(each).alias("path")).distinct().select("path", corpus.safe_path(F.col("path")).alias("safe"))
