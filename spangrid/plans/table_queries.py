"""Queries over the row tables: filters, joins, aggregates, windows, sorts, sets, scalars, selection, evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ratio
from ..operators import metrics
from ..session import table
from ..sources.files import CODE_EXTENSIONS, EXCLUDED_DIRS
from .registry import query

# Languages in the order of their numbers.
LANGUAGES = ("typescript", "javascript", "python", "java", "rust", "zig", "go", "cpp", "csharp", "ruby", "kotlin", "swift")

ROWS_SQL = """b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id, boundary_id ORDER BY ingested_at) AS rn FROM boundary_rows) WHERE rn = 1 AND gap_label IS NOT NULL AND gap_label <= 2)"""
SCORED_SQL = ROWS_SQL + """, s AS (SELECT *, coalesce(lag(gap_label) OVER (PARTITION BY file_id ORDER BY boundary_id), 0) AS prediction FROM b)"""


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled boundaries, each once, with a label of 0 to 2: the rows that can be trained on.

    Dealt by file, which serves this window and every later one within a file.
    """
    w = Window.partitionBy("file_id", "boundary_id").orderBy("ingested_at")
    return table(spark, sf_dir, "boundary_rows").repartition("file_id").withColumn("rn", F.row_number().over(w)).where("rn = 1 AND gap_label IS NOT NULL AND gap_label <= 2").drop("rn")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a prediction: the label of the boundary before, 0 for the first. Stands in for a model's labels."""
    w = Window.partitionBy("file_id").orderBy("boundary_id")
    return rows(spark, sf_dir).withColumn("prediction", F.coalesce(F.lag("gap_label").over(w), F.lit(0)))


# --- sources and paths

# Parts and marks of paths that are left out.
EXCLUDED_PARTS = ("test", "tests", "testing", "__tests__", "fixtures", "snapshots", "generated", "vendor", "third_party", "node_modules")
EXCLUDED_MARKS = (".test.", ".spec.", "_test.", "_tests.", "_fuzz.", "testutil.", "/fuzz.", ".generated.", ".min.")
# The extension of each language, in the order of LANGUAGES.
TARGET_EXTENSIONS = (".ts", ".js", ".py", ".java", ".rs", ".zig", ".go", ".cpp", ".cs", ".rb", ".kt", ".swift")


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "source_files").select("file_id", "repository", "lang", "path").distinct()


def is_code(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/](\.[^./]*)$", 1).isin(*CODE_EXTENSIONS)


def skipped_directory(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.exists(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p.startswith(".") | p.isin(*EXCLUDED_DIRS))


@query("src04_code_extension", f"SELECT DISTINCT file_id, path, regexp_extract(path, '[^/](\\.[^./]*)$', 1) IN {CODE_EXTENSIONS} AS is_code FROM source_files")
def src04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths(spark, sf_dir).select("file_id", "path", is_code(F.col("path")).alias("is_code")).distinct()


@query("src05_skipped_directories", f"SELECT DISTINCT file_id, path FROM source_files WHERE len(list_filter(string_split(path, '/')[:-2], lambda p: prefix(p, '.') OR p IN {EXCLUDED_DIRS})) > 0")
def src05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths(spark, sf_dir).where(skipped_directory(F.col("path"))).select("file_id", "path").distinct()


def _glob(name: str, pattern: str) -> None:
    from ..sources.globs import glob_regex

    regex = glob_regex(pattern)

    @query(name, f"SELECT DISTINCT file_id, path FROM source_files WHERE regexp_full_match(path, '{regex}')")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return paths(spark, sf_dir).where(F.col("path").rlike(f"^(?:{regex})$")).select("file_id", "path").distinct()


_glob("src06_recursive_glob", "**/[cm]*/**/*-*.ts")
_glob("src07_segment_glob", "*/util/?[a-z]*.js")
_glob("src08_negated_class_glob", "src/*/[!a-m]*.java")


@query("src09_has_pattern", "SELECT split, case_name, regexp_matches(case_name, '[*?\\[\\\\]') AS has_pattern, count(*) AS n FROM golden_pairs GROUP BY ALL")
def src09(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "golden_pairs")
    return g.groupBy("split", "case_name", F.col("case_name").rlike(r"[*?\[\\]").alias("has_pattern")).agg(F.count("*").alias("n"))


_TARGET_SQL = "CASE lang " + " ".join(f"WHEN '{x}' THEN suffix(path, '{e}')" + (" OR suffix(path, '.h') OR suffix(path, '.cc')" if x == "cpp" else "") for x, e in zip(LANGUAGES, TARGET_EXTENSIONS)) + " ELSE false END"


@query("src11_target_files", f"SELECT DISTINCT file_id, path FROM source_files WHERE {_TARGET_SQL} AND NOT list_has_any(string_split(path, '/'), {list(EXCLUDED_PARTS)}) AND " + " AND ".join(f"NOT contains(path, '{m}')" for m in EXCLUDED_MARKS))
def src11(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    ends = F.lit(False)
    for lang, ext in zip(LANGUAGES, TARGET_EXTENSIONS):
        hit = p.endswith(ext) | ((p.endswith(".h") | p.endswith(".cc")) if lang == "cpp" else F.lit(False))
        ends = F.when(F.col("lang") == lang, hit).otherwise(ends)
    clean = ~F.arrays_overlap(F.split(p, "/"), F.array(*map(F.lit, EXCLUDED_PARTS)))
    for m in EXCLUDED_MARKS:
        clean = clean & ~p.contains(m)
    return paths(spark, sf_dir).where(F.coalesce(ends, F.lit(False)) & clean).select("file_id", "path").distinct()


@query("src12_path_prefix", "SELECT DISTINCT f.file_id, c.source_id FROM source_files f JOIN (SELECT source_id, repository, unnest(paths) AS p FROM corpus_sources) c ON c.repository = f.repository AND (c.p = '.' OR f.path = c.p OR prefix(f.path, c.p || '/'))")
def src12(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "corpus_sources").select("source_id", "repository", F.explode("paths").alias("p"))
    f = paths(spark, sf_dir).select("file_id", "repository", "path")
    return f.join(c, (f["repository"] == c["repository"]) & ((c["p"] == ".") | (f["path"] == c["p"]) | f["path"].startswith(F.concat(c["p"], F.lit("/"))))).select("file_id", "source_id").distinct()


@query("src16_manifest", "SELECT file_id, len(class_counts) AS classes, class_counts[1] AS gap0, class_counts[2] AS gap1, class_counts[3] AS gap2 FROM source_files")
def src16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest's nested counts, through JSON and a fixed schema that fails on anything else."""
    f = table(spark, sf_dir, "source_files").select("file_id", F.to_json("class_counts").alias("j"))
    c = F.from_json("j", "array<bigint>", {"mode": "FAILFAST"})
    return f.select("file_id", F.when(F.col("j").isNotNull(), F.size(c)).cast("long").alias("classes"), *(F.get(c, F.lit(k)).alias(f"gap{k}") for k in range(3)))


@query("src17_fixture_pairs", "SELECT i.split, i.ext, count(*) AS pairs, count(o.output_text) AS with_output FROM golden_pairs i LEFT JOIN golden_pairs o ON o.case_id = i.case_id GROUP BY ALL")
def src17(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "golden_pairs")
    o = g.select("case_id", "output_text")
    return g.select("case_id", "split", "ext").join(o, "case_id", "left").groupBy("split", "ext").agg(F.count("*").alias("pairs"), F.count("output_text").alias("with_output"))


# an edit patch of each file: one added, one moved twice, one updated
PATCH_SQL = "'*** Add File: a/' || path || chr(10) || '+x' || chr(10) || '*** Update File: ' || path || chr(10) || '*** Move to: moved/' || path || chr(10) || '*** Move to: again/' || path || chr(10) || '*** Update File: z/' || path"


@query("src18_patch_paths", f"""WITH p AS (SELECT DISTINCT file_id, {PATCH_SQL} AS patch FROM source_files), l AS (SELECT file_id, unnest(string_split(patch, chr(10))) AS line, unnest(range(len(string_split(patch, chr(10))))) AS n FROM p),
e AS (SELECT *, regexp_extract(line, '^\\*\\*\\* (Add File|Update File|Move to): (.*)$', 1) AS op, regexp_extract(line, '^\\*\\*\\* (Add File|Update File|Move to): (.*)$', 2) AS path FROM l),
m AS (SELECT *, count(*) FILTER (op <> 'Move to') OVER (PARTITION BY file_id ORDER BY n) AS entry FROM e WHERE op <> '')
SELECT file_id, arg_max(path, n) AS path FROM m WHERE entry > 0 GROUP BY file_id, entry""")
def src18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed paths of patches; a move gives the file of the line before it a new name."""
    from ..sources.patches import changed_paths

    patch = F.concat(F.lit("*** Add File: a/"), "path", F.lit("\n+x\n*** Update File: "), "path", F.lit("\n*** Move to: moved/"), "path", F.lit("\n*** Move to: again/"), "path", F.lit("\n*** Update File: z/"), "path")
    p = table(spark, sf_dir, "source_files").select("file_id", patch.alias("patch")).distinct()
    return p.select("file_id", F.explode(changed_paths(F.col("patch"))).alias("path"))


# --- filters on rows


@query("flt07_trainable", "SELECT gap_label, count(*) AS n FROM boundary_rows WHERE gap_label <= 2 AND source_id IS NOT NULL GROUP BY gap_label")
def flt07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "boundary_rows").where("gap_label <= 2 AND source_id IS NOT NULL").groupBy("gap_label").agg(F.count("*").alias("n"))


@query("flt08_line_ranges", f"WITH {ROWS_SQL} SELECT file_id, boundary_id FROM b WHERE (boundary_id >= 10 AND boundary_id + 1 <= 19) OR (boundary_id >= 40 AND boundary_id + 1 <= 44)")
def flt08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both neighbours inside one of a file's allowed ranges."""
    r = F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((10, 19), (40, 44))))
    inside = F.exists(r, lambda x: (F.col("boundary_id") >= x["start"]) & (F.col("boundary_id") + 1 <= x["end"]))
    return rows(spark, sf_dir).where(inside).select("file_id", "boundary_id")


@query("flt09_excluded_ranges", f"WITH {ROWS_SQL}, r AS (SELECT DISTINCT file_id, coalesce(boundaries, 0) // 2 AS a, coalesce(boundaries, 0) // 2 + 5 AS z FROM source_files) SELECT file_id, boundary_id FROM b WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.file_id = b.file_id AND b.boundary_id >= r.a AND b.boundary_id < r.z)")
def flt09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anti join on half-open ranges; the file is an equality key, so it stays a hash or merge join."""
    half = F.floor(F.coalesce("boundaries", F.lit(0)) / 2)
    r = table(spark, sf_dir, "source_files").select(F.col("file_id").alias("f"), half.alias("a"), (half + 5).alias("z")).distinct()
    b = rows(spark, sf_dir)
    return b.join(r, (b["file_id"] == r["f"]) & (b["boundary_id"] >= r["a"]) & (b["boundary_id"] < r["z"]), "left_anti").select("file_id", "boundary_id")


@query("flt14_leave_language_out", f"WITH {ROWS_SQL} SELECT h.language_id AS held_out, count(*) AS n FROM b JOIN (SELECT unnest(range(12)) AS language_id) h ON b.language_id <> h.language_id GROUP BY ALL")
def flt14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows left when a language is held out: the total less its own, so no row is copied twelve times."""
    per = rows(spark, sf_dir).groupBy("language_id").agg(F.count("*").alias("own"))
    total = per.agg(F.sum("own").alias("total"))
    held = spark.range(12).select(F.col("id").alias("held_out"))
    return held.join(per, held["held_out"] == per["language_id"], "left").crossJoin(total).select("held_out", (F.col("total") - F.coalesce("own", F.lit(0))).alias("n"))


@query("flt15_held_out_language", f"WITH {ROWS_SQL} SELECT file_id, boundary_id, gap_label FROM b WHERE language_id = 5")
def flt15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir).where("language_id = 5").select("file_id", "boundary_id", "gap_label")


# --- model operators on logits; logits are made from the stored confidence

LOGITS_SQL = ROWS_SQL + """, z AS (SELECT file_id, boundary_id, gap_label, language_id, CAST(coalesce(confidence, 0.5) * 2 AS DOUBLE) AS z0, CAST((boundary_id % 7) / 4.0 AS DOUBLE) AS z1, CAST((boundary_id % 5) / 3.0 - coalesce(confidence, 0.5) AS DOUBLE) AS z2 FROM b),
p AS (SELECT *, greatest(z0, z1, z2) AS m FROM z), q AS (SELECT *, exp(z0 - m) AS e0, exp(z1 - m) AS e1, exp(z2 - m) AS e2 FROM p), r AS (SELECT *, e0 / (e0 + e1 + e2) AS p0, e1 / (e0 + e1 + e2) AS p1, e2 / (e0 + e1 + e2) AS p2 FROM q)"""


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.coalesce("confidence", F.lit(0.5))
    z = F.array(c * 2, F.col("boundary_id") % 7 / 4.0, F.col("boundary_id") % 5 / 3.0 - c)
    return rows(spark, sf_dir).select("file_id", "boundary_id", "gap_label", "language_id", z.cast("array<double>").alias("logits"))


@query("mod02_softmax", f"WITH {LOGITS_SQL} SELECT file_id, boundary_id, round(p0, 6) AS p0, round(p1, 6) AS p1, round(p2, 6) AS p2 FROM r")
def mod02(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = logits(spark, sf_dir).withColumn("p", metrics.softmax(F.col("logits")))
    return p.select("file_id", "boundary_id", *(F.round(F.get("p", F.lit(k)), 6).alias(f"p{k}") for k in range(3)))


@query("mod03_classify", f"WITH {LOGITS_SQL} SELECT gap_label, CASE WHEN z0 >= z1 AND z0 >= z2 THEN 0 WHEN z1 >= z2 THEN 1 ELSE 2 END AS prediction, count(*) AS n FROM r GROUP BY ALL")
def mod03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logits(spark, sf_dir).groupBy("gap_label", metrics.argmax(F.col("logits")).alias("prediction")).agg(F.count("*").alias("n"))


@query("mod04_cross_entropy", f"WITH {LOGITS_SQL} SELECT language_id, round(avg(-ln(CASE gap_label WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END)), 6) AS loss FROM r GROUP BY language_id")
def mod04(spark: SparkSession, sf_dir: str) -> DataFrame:
    loss = metrics.cross_entropy(F.col("logits"), F.col("gap_label"))
    return logits(spark, sf_dir).groupBy("language_id").agg(F.round(F.avg(loss), 6).alias("loss"))


_TOP_SQL = "greatest(p0, p1, p2)"
_ARG_SQL = "CASE WHEN z0 >= z1 AND z0 >= z2 THEN 0 WHEN z1 >= z2 THEN 1 ELSE 2 END"


@query("mod05_gate", f"WITH {LOGITS_SQL} SELECT CASE WHEN {_TOP_SQL} < 0.5 THEN 255 ELSE {_ARG_SQL} END AS label, count(*) AS n FROM r GROUP BY ALL")
def mod05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logits(spark, sf_dir).groupBy(metrics.gated(F.col("logits"), 0.5, 255).alias("label")).agg(F.count("*").alias("n"))


@query("mod08_accept", f"WITH {LOGITS_SQL} SELECT file_id, count(*) FILTER ({_TOP_SQL} < 0.5) AS abstained, count(*) FILTER ({_TOP_SQL} >= 0.5 AND {_ARG_SQL} <> gap_label) AS changes, count(*) AS candidates FROM r GROUP BY file_id")
def mod08(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = logits(spark, sf_dir).withColumn("label", metrics.gated(F.col("logits"), 0.5, 255))
    return z.groupBy("file_id").agg(F.count_if(F.col("label") == 255).alias("abstained"), F.count_if((F.col("label") != 255) & (F.col("label") != F.col("gap_label"))).alias("changes"), F.count("*").alias("candidates"))


@query("snk03_check_mode", f"WITH {LOGITS_SQL} SELECT CAST(max(CASE WHEN {_TOP_SQL} >= 0.5 AND {_ARG_SQL} <> gap_label THEN 1 ELSE 0 END) AS INT) AS exit_code FROM r")
def snk03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mod08(spark, sf_dir).agg(F.max((F.col("changes") > 0).cast("int")).alias("exit_code"))


@query("snk04_stats_line", f"WITH {LOGITS_SQL}, t AS (SELECT file_id, count(*) FILTER ({_TOP_SQL} >= 0.5 AND {_ARG_SQL} <> gap_label) AS changes, count(*) AS candidates FROM r GROUP BY file_id) SELECT file_id, '{{\"changes\":' || changes || ',\"candidates\":' || candidates || '}}' AS line FROM t")
def snk04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mod08(spark, sf_dir).select("file_id", F.to_json(F.struct("changes", "candidates")).alias("line"))


@query("snk10_sample_names", "SELECT DISTINCT file_id, regexp_extract(path, '([^/]*)\\.[^./]*$', 1) || '--' || substr(sha256(repository || ':' || path), 1, 8) || regexp_extract(path, '\\.[^./]*$') AS name FROM source_files WHERE repository IS NOT NULL")
def snk10(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = paths(spark, sf_dir).where("repository IS NOT NULL")
    stem, ext = F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1), F.regexp_extract("path", r"\.[^./]*$", 0)
    return p.select("file_id", F.concat(stem, F.lit("--"), F.substring(F.sha2(F.concat_ws(":", "repository", "path"), 256), 1, 8), ext).alias("name")).distinct()


# --- joins


@query("jon04_sample_lookup", "WITH f AS (SELECT DISTINCT file_id, repository, path FROM source_files), s AS (SELECT repository, path, min(file_id) AS first_id FROM f GROUP BY ALL) SELECT f.file_id, s.first_id FROM f LEFT JOIN s ON s.repository = f.repository AND s.path = f.path")
def jon04(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "source_files").select("file_id", "repository", "path").distinct()
    s = f.groupBy("repository", "path").agg(F.min("file_id").alias("first_id"))
    return f.join(s, ["repository", "path"], "left").select("file_id", "first_id")


_REVIEWED = "f AS (SELECT file_id, max(split) AS split FROM source_files GROUP BY file_id)"


@query("jon05_reviewed_split", f"WITH {ROWS_SQL}, {_REVIEWED} SELECT CASE WHEN f.file_id IS NULL THEN 'replay' WHEN f.split IN ('train', 'style_train') THEN 'train' ELSE coalesce(f.split, 'replay') END AS part, count(*) AS n FROM b LEFT JOIN f USING (file_id) GROUP BY ALL")
def jon05(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "source_files").groupBy("file_id").agg(F.max("split").alias("split"))
    part = F.when(F.col("split").isin("train", "style_train"), "train").otherwise(F.coalesce("split", F.lit("replay")))
    return rows(spark, sf_dir).join(f, "file_id", "left").groupBy(part.alias("part")).agg(F.count("*").alias("n"))


@query("jon06_feedback_semi", f"WITH {ROWS_SQL} SELECT count(*) AS n FROM b WHERE file_id IN (SELECT file_id FROM source_files WHERE layout_corrected)")
def jon06(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "source_files").where("layout_corrected").select("file_id")
    return rows(spark, sf_dir).join(c, "file_id", "left_semi").agg(F.count("*").alias("n"))


@query("jon09_expected_outputs", "SELECT case_id, strlen(input_text) AS input_bytes, strlen(output_text) AS output_bytes FROM golden_pairs WHERE output_text IS NOT NULL")
def jon09(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "golden_pairs")
    o = g.where("output_text IS NOT NULL").select("case_id", F.octet_length("output_text").cast("long").alias("output_bytes"))
    return g.select("case_id", F.octet_length("input_text").cast("long").alias("input_bytes")).join(o, "case_id")


_GAPS = "list_filter(list_zip(range(len({p})), {p}), lambda x: trim(x[2], chr(32) || chr(9) || chr(13)) <> '')"


@query("jon10_gap_zip", f"""WITH g AS (SELECT case_id, string_split(input_text, chr(10)) AS ip, string_split(output_text, chr(10)) AS op FROM golden_pairs WHERE output_text IS NOT NULL),
h AS (SELECT case_id, list_transform({_GAPS.format(p='ip')}, lambda x: x[1]) AS i, list_transform({_GAPS.format(p='op')}, lambda x: x[1]) AS o FROM g)
SELECT case_id, CAST(len(list_filter(range(least(len(i), len(o)) - 1), lambda k: i[k + 2] - i[k + 1] = o[k + 2] - o[k + 1])) AS INT) AS equal_gaps, CAST(len(o) - 1 AS INT) AS gaps FROM h""")
def jon10(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "golden_pairs").where("output_text IS NOT NULL")
    at = {c: F.expr(f"transform(filter(transform(split({t}, '\\n', -1), (x, i) -> IF(trim(BOTH ' \\t\\r' FROM x) = '', -1, i)), k -> k >= 0), k -> k)") for c, t in (("i", "input_text"), ("o", "output_text"))}
    g = g.select("case_id", *(e.alias(c) for c, e in at.items()))
    same = F.expr("size(filter(IF(least(size(i), size(o)) < 2, array(), sequence(0, least(size(i), size(o)) - 2)), k -> i[k + 1] - i[k] = o[k + 1] - o[k]))")
    return g.select("case_id", same.alias("equal_gaps"), (F.size("o") - 1).alias("gaps"))


@query("jon13_broadcast_names", f"WITH {ROWS_SQL}, n AS (SELECT unnest({list(LANGUAGES)}) AS language, unnest(range(12)) AS language_id) SELECT language, count(*) AS n FROM b JOIN n USING (language_id) GROUP BY language")
def jon13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names are twelve constants, so the broadcast has a fixed size."""
    names = spark.createDataFrame(list(enumerate(LANGUAGES)), "language_id int, language string")
    return rows(spark, sf_dir).join(F.broadcast(names), "language_id").groupBy("language").agg(F.count("*").alias("n"))


@query("jon14_expectations", f"WITH {ROWS_SQL}, e AS (SELECT DISTINCT file_id, 3 AS boundary_id, 1 AS expected FROM source_files) SELECT count(*) AS expectations, count(b.gap_label) AS found, count(*) FILTER (b.gap_label = e.expected) AS met FROM e LEFT JOIN b USING (file_id, boundary_id)")
def jon14(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "source_files").select("file_id", F.lit(3).alias("boundary_id"), F.lit(1).alias("expected")).distinct()
    j = e.join(rows(spark, sf_dir).select("file_id", "boundary_id", "gap_label"), ["file_id", "boundary_id"], "left")
    return j.agg(F.count("*").alias("expectations"), F.count("gap_label").alias("found"), F.count_if(F.col("gap_label") == F.col("expected")).alias("met"))


# --- aggregates

_CELLS = ", ".join(f"count(*) FILTER (gap_label = {t} AND prediction = {p}) AS c{t}{p}" for t in range(3) for p in range(3))


@query("agg01_confusion", f"WITH {SCORED_SQL} SELECT language_id, {_CELLS} FROM s GROUP BY language_id")
def agg01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(scored(spark, sf_dir), "gap_label", "prediction", "language_id")


@query("agg02_accuracy", f"WITH {SCORED_SQL} SELECT language_id, round(count(*) FILTER (gap_label = prediction) / count(*), 6) AS accuracy FROM s GROUP BY language_id")
def agg02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(scored(spark, sf_dir), "gap_label", "prediction", "language_id").select("language_id", F.round(metrics.accuracy(), 6).alias("accuracy"))


_F1 = "WITH " + SCORED_SQL + ", k AS (SELECT language_id, unnest([0, 1, 2]) AS c FROM (SELECT DISTINCT language_id FROM s)), f AS (SELECT k.language_id, c, count(*) FILTER (gap_label = c) AS t, count(*) FILTER (prediction = c) AS p, count(*) FILTER (gap_label = c AND prediction = c) AS h FROM k JOIN s ON s.language_id = k.language_id GROUP BY ALL), m AS (SELECT language_id, avg(2.0 * h / (t + p)) AS f1 FROM f WHERE t > 0 GROUP BY language_id)"


@query("agg03_macro_f1", _F1 + " SELECT language_id, round(f1, 6) AS macro_f1 FROM m")
def agg03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean F1 over the classes that occur in truth."""
    return metrics.confusion(scored(spark, sf_dir), "gap_label", "prediction", "language_id").select("language_id", F.round(metrics.macro_f1(), 6).alias("macro_f1"))


_BLANK = "coalesce(count(*) FILTER (gap_label > 0 AND gap_label = prediction) / nullif(count(*) FILTER ({} > 0), 0), 0)"


@query("agg04_blank_precision_recall", f"WITH {SCORED_SQL} SELECT language_id, round({_BLANK.format('prediction')}, 6) AS blank_precision, round({_BLANK.format('gap_label')}, 6) AS blank_recall FROM s GROUP BY language_id")
def agg04(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = metrics.confusion(scored(spark, sf_dir), "gap_label", "prediction", "language_id")
    return c.select("language_id", F.round(metrics.blank_precision(), 6).alias("blank_precision"), F.round(metrics.blank_recall(), 6).alias("blank_recall"))


@query("agg05_mean_language_f1", _F1 + " SELECT round(avg(f1), 6) AS score, count(*) AS languages FROM m")
def agg05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(scored(spark, sf_dir), "gap_label", "prediction", "language_id").select(metrics.macro_f1().alias("f1")).agg(F.round(F.avg("f1"), 6).alias("score"), F.count("*").alias("languages"))


@query("agg06_threshold_curve", f"WITH {LOGITS_SQL}, t AS (SELECT unnest([0.0, 0.5, 0.7, 0.8, 0.9, 0.95]) AS threshold), a AS (SELECT threshold, gap_label, CASE WHEN {_TOP_SQL} < threshold THEN 0 ELSE {_ARG_SQL} END AS prediction FROM r, t) SELECT CAST(threshold AS DOUBLE) AS threshold, {_CELLS} FROM a GROUP BY threshold")
def agg06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass: rows are counted per label, guess and confidence step, and the curve sums over steps."""
    steps = (0.0, 0.5, 0.7, 0.8, 0.9, 0.95)
    z = logits(spark, sf_dir).withColumn("top", F.array_max(metrics.softmax(F.col("logits")))).withColumn("guess", metrics.argmax(F.col("logits")))
    level = F.lit(0)
    for t in steps[1:]:
        level = level + (F.col("top") >= t).cast("int")
    cells = z.groupBy("gap_label", "guess", level.alias("level")).agg(F.count("*").alias("n"))
    curve = cells.select("*", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(t).alias("threshold")) for k, t in enumerate(steps)))).alias("s")).select("gap_label", F.when(F.col("level") < F.col("s.k"), 0).otherwise(F.col("guess")).alias("prediction"), "n", F.col("s.threshold").alias("threshold"))
    sums = [F.sum(F.when((F.col("gap_label") == t) & (F.col("prediction") == p), F.col("n")).otherwise(0)).alias(f"c{t}{p}") for t in range(3) for p in range(3)]
    return curve.groupBy("threshold").agg(*sums)


@query("agg07_class_weights", f"WITH {ROWS_SQL} SELECT gap_label, round(least(3.0, sqrt(sum(count(*)) OVER () / (3.0 * greatest(count(*), 1)))), 6) AS weight FROM b GROUP BY gap_label")
def agg07(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = rows(spark, sf_dir).groupBy("gap_label").agg(F.count("*").alias("n"))
    total = c.agg(F.sum("n").alias("total"))
    return c.crossJoin(total).select("gap_label", F.round(F.least(F.lit(3.0), F.sqrt(F.col("total") / (3.0 * F.greatest("n", F.lit(1))))), 6).alias("weight"))


@query("agg08_class_counts", f"WITH {ROWS_SQL} SELECT file_id, count(*) FILTER (gap_label = 0) AS gap0, count(*) FILTER (gap_label = 1) AS gap1, count(*) FILTER (gap_label = 2) AS gap2, count(*) AS boundaries FROM b GROUP BY file_id")
def agg08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir).groupBy("file_id").agg(*(F.count_if(F.col("gap_label") == k).alias(f"gap{k}") for k in range(3)), F.count("*").alias("boundaries"))


@query("agg11_groups", f"WITH {SCORED_SQL} SELECT CASE WHEN boundary_id < 10 THEN 'head' ELSE 'body' END AS scope, language_id AS name, count(*) AS total, count(*) FILTER (gap_label = prediction) AS passed FROM s GROUP BY ALL")
def agg11(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = F.when(F.col("boundary_id") < 10, "head").otherwise("body")
    return scored(spark, sf_dir).groupBy(scope.alias("scope"), F.col("language_id").alias("name")).agg(F.count("*").alias("total"), F.count_if(F.col("gap_label") == F.col("prediction")).alias("passed"))


@query("agg13_distinct_paths", "SELECT repository, count(DISTINCT path) AS paths FROM source_files GROUP BY repository")
def agg13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "source_files").select("repository", "path").distinct().groupBy("repository").agg(F.count("path").alias("paths"))


@query("agg14_unique_contents", "SELECT count(DISTINCT md5(content)) AS contents FROM source_files")
def agg14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "source_files").agg(F.countDistinct(F.md5("content")).alias("contents"))


@query("agg15_split_counts", "SELECT count(DISTINCT file_id) AS files, count(DISTINCT file_id) FILTER (split IN ('validation', 'test', 'style_validation', 'unseen_language')) AS held_out FROM source_files")
def agg15(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "source_files")
    held = F.col("split").isin("validation", "test", "style_validation", "unseen_language")
    per = f.groupBy("file_id").agg(F.bool_or(held).alias("held"))
    return per.agg(F.count("*").alias("files"), F.count_if("held").alias("held_out"))


@query("agg16_nearest_rank", f"WITH {ROWS_SQL}, o AS (SELECT language_id, list_sort(list(round(confidence, 9))) AS v FROM b WHERE confidence IS NOT NULL GROUP BY language_id) SELECT language_id, v[len(v) // 2 + 1] AS p50, v[len(v) * 95 // 100 + 1] AS p95 FROM o")
def agg16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest ranks n/2 and 95n/100 of the sorted values, by counts of ranges: no language is sorted in one task."""
    from ..operators.ranking import nearest_ranks

    b = rows(spark, sf_dir).where("confidence IS NOT NULL").select("language_id", F.round("confidence", 9).alias("v"))
    return nearest_ranks(b, "language_id", "v", {"p50": 50, "p95": 95})


@query("agg17_largest_error", f"WITH {LOGITS_SQL} SELECT round(max(abs(p0 + p1 + p2 - 1)), 6) AS largest, count(*) FILTER ({_ARG_SQL} = gap_label) AS matches, count(*) AS n FROM r")
def agg17(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = logits(spark, sf_dir).withColumn("p", metrics.softmax(F.col("logits")))
    off = F.abs(F.aggregate("p", F.lit(0.0), lambda a, x: a + x) - 1)
    return z.agg(F.round(F.max(off), 6).alias("largest"), F.count_if(metrics.argmax(F.col("logits")) == F.col("gap_label")).alias("matches"), F.count("*").alias("n"))


@query("agg18_weighted_loss", f"WITH {LOGITS_SQL} SELECT round(avg((gap_label + 1) * -ln(CASE gap_label WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END)), 6) AS loss FROM r")
def agg18(spark: SparkSession, sf_dir: str) -> DataFrame:
    loss = metrics.cross_entropy(F.col("logits"), F.col("gap_label")) * (F.col("gap_label") + 1)
    return logits(spark, sf_dir).agg(F.round(F.avg(loss), 6).alias("loss"))


@query("agg19_digests", "SELECT DISTINCT file_id, sha256(content) AS sha, sha256(content) = sha256 AS as_recorded FROM source_files WHERE content IS NOT NULL")
def agg19(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "source_files").where("content IS NOT NULL")
    return f.select("file_id", F.sha2("content", 256).alias("sha"), (F.sha2("content", 256) == F.col("sha256")).alias("as_recorded")).distinct()


@query("agg20_all_flags", f"WITH {SCORED_SQL} SELECT language_id, bool_and(gap_label = prediction) AS all_met, bool_or(gap_label = prediction) AS any_met FROM s GROUP BY language_id")
def agg20(spark: SparkSession, sf_dir: str) -> DataFrame:
    same = F.col("gap_label") == F.col("prediction")
    return scored(spark, sf_dir).groupBy("language_id").agg(F.bool_and(same).alias("all_met"), F.bool_or(same).alias("any_met"))


@query("agg22_representatives", "SELECT md5(content) AS digest, min(file_id) AS representative FROM source_files WHERE content IS NOT NULL GROUP BY ALL")
def agg22(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "source_files").where("content IS NOT NULL").groupBy(F.md5("content").alias("digest")).agg(F.min("file_id").alias("representative"))


# --- windows, sorts, sets


@query("win07_chunks", f"WITH {ROWS_SQL}, c AS (SELECT file_id, (row_number() OVER (PARTITION BY file_id ORDER BY boundary_id) - 1) // 8 AS chunk FROM b) SELECT file_id, chunk, count(*) AS n FROM c GROUP BY ALL HAVING count(*) >= 4")
def win07(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("file_id").orderBy("boundary_id")
    c = rows(spark, sf_dir).select("file_id", F.floor((F.row_number().over(w) - 1) / 8).alias("chunk"))
    return c.groupBy("file_id", "chunk").agg(F.count("*").alias("n")).where("n >= 4")


_CASES = f"WITH {ROWS_SQL}, c AS (SELECT file_id, any_value(language_id) AS language_id, (boundary_id // 8) AS chunk FROM b GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY language_id, file_id ORDER BY chunk) AS r FROM (SELECT file_id, boundary_id // 8 AS chunk, min(language_id) AS language_id FROM b GROUP BY ALL)), t AS (SELECT *, row_number() OVER (PARTITION BY language_id ORDER BY file_id, chunk) AS q FROM k WHERE r <= 3)"


@query("win08_case_limits", _CASES + " SELECT language_id, file_id, chunk FROM t WHERE q <= 30")
def win08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most three chunks of a file and thirty of a language: a report of cases, limited by design."""
    k = rows(spark, sf_dir).groupBy("file_id", F.floor(F.col("boundary_id") / 8).alias("chunk")).agg(F.min("language_id").alias("language_id"))
    k = k.withColumn("r", F.row_number().over(Window.partitionBy("language_id", "file_id").orderBy("chunk"))).where("r <= 3")
    return k.withColumn("q", F.row_number().over(Window.partitionBy("language_id").orderBy("file_id", "chunk"))).where("q <= 30").select("language_id", "file_id", "chunk")


@query("srt07_group_limit", _CASES + " SELECT language_id, least(count(*), 30) AS cases, count(*) >= 30 AS complete FROM t GROUP BY language_id")
def srt07(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = rows(spark, sf_dir).groupBy("file_id", F.floor(F.col("boundary_id") / 8).alias("chunk")).agg(F.min("language_id").alias("language_id"))
    per = k.groupBy("language_id", "file_id").agg(F.least(F.count("*"), F.lit(3)).alias("n")).groupBy("language_id").agg(F.sum("n").alias("n"))
    return per.select("language_id", F.least("n", F.lit(30)).alias("cases"), (F.col("n") >= 30).alias("complete"))


_MOVES = "e AS (SELECT event_id, user_id, ts, event_type, CASE WHEN event_type IN ('signup', 'click', 'view') THEN 'entry' ELSE 'move' END AS op FROM events WHERE user_id IS NOT NULL), m AS (SELECT *, count(*) FILTER (op = 'entry') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS entry FROM e)"


@query("win10_last_names", f"WITH {_MOVES} SELECT user_id, entry, arg_max(event_type, (ts, event_id)) AS name FROM m WHERE entry > 0 GROUP BY user_id, entry")
def win10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name that each entry of a log has at last, where rows of another kind rename the entry before them: a running
    count of entries, then the newest row of each. src18 does so within one patch."""
    e = table(spark, sf_dir, "events").where("user_id IS NOT NULL").withColumn("entry_row", F.col("event_type").isin("signup", "click", "view").cast("int"))
    m = e.withColumn("entry", F.sum("entry_row").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return m.where("entry > 0").groupBy("user_id", "entry").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("name"))


@query("srt01_path_order", "SELECT path, row_number() OVER (ORDER BY path) AS rank FROM (SELECT DISTINCT path FROM source_files)")
def srt01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte order over the whole table by a range sort; ranks come from partition sizes, not from one task."""
    from ..operators.ranking import global_rank

    return global_rank(table(spark, sf_dir, "source_files").select("path").distinct(), "path", "rank")


_CANDIDATES = f"WITH {LOGITS_SQL}, t AS (SELECT unnest([0.0, 0.4, 0.45, 0.5, 0.55, 0.6]) AS threshold), a AS (SELECT threshold, language_id, gap_label, CASE WHEN {_TOP_SQL} < threshold THEN 0 ELSE {_ARG_SQL} END AS prediction FROM r, t), m AS (SELECT threshold, language_id, coalesce(count(*) FILTER (gap_label > 0 AND gap_label = prediction) / nullif(count(*) FILTER (prediction > 0), 0), 0) AS blank_precision, coalesce(count(*) FILTER (gap_label > 0 AND gap_label = prediction) / nullif(count(*) FILTER (gap_label > 0), 0), 0) AS blank_recall FROM a GROUP BY ALL)"


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = F.array(*(F.lit(t) for t in (0.0, 0.4, 0.45, 0.5, 0.55, 0.6)))
    z = logits(spark, sf_dir).select("language_id", "gap_label", F.array_max(metrics.softmax(F.col("logits"))).alias("top"), metrics.argmax(F.col("logits")).alias("guess"))
    # rows fold into one count per label, guess and number of thresholds passed before thresholds are spread out
    z = z.groupBy("language_id", "gap_label", "guess", F.size(F.filter(steps, lambda t: t <= F.col("top"))).alias("passed")).agg(F.count("*").alias("n"))
    a = z.select("*", F.posexplode(steps).alias("k", "threshold")).withColumn("prediction", F.when(F.col("passed") > F.col("k"), F.col("guess")).otherwise(0))
    hit = F.sum(F.when((F.col("gap_label") > 0) & (F.col("gap_label") == F.col("prediction")), F.col("n")).otherwise(0))
    m = a.groupBy("threshold", "language_id").agg(ratio(hit, F.sum(F.when(F.col("prediction") > 0, F.col("n")).otherwise(0))).alias("blank_precision"), ratio(hit, F.sum(F.when(F.col("gap_label") > 0, F.col("n")).otherwise(0))).alias("blank_recall"))
    return m


@query("srt04_best_candidate", _CANDIDATES + " SELECT language_id, CAST(threshold AS DOUBLE) AS threshold, round(blank_precision, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY language_id ORDER BY round(blank_precision, 9) DESC, threshold) AS rn FROM m) WHERE rn = 1")
def srt04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of the best candidates."""
    w = Window.partitionBy("language_id").orderBy(F.desc(F.round("blank_precision", 9)), "threshold")
    return candidates(spark, sf_dir).withColumn("rn", F.row_number().over(w)).where("rn = 1").select("language_id", "threshold", F.round("blank_precision", 6).alias("score"))


@query("srt05_lowest_threshold", _CANDIDATES + " SELECT language_id, CAST(min(threshold) AS DOUBLE) AS threshold FROM m WHERE blank_recall >= 0.05 GROUP BY language_id")
def srt05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).where("blank_recall >= 0.05").groupBy("language_id").agg(F.min("threshold").alias("threshold"))


@query("trn09_selection_gate", _CANDIDATES + " SELECT language_id, CAST(threshold AS DOUBLE) AS threshold, blank_precision >= 0.95 AND blank_recall >= 0.60 AS eligible FROM m")
def trn09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).select("language_id", "threshold", ((F.col("blank_precision") >= 0.95) & (F.col("blank_recall") >= 0.60)).alias("eligible"))


@query("srt06_seeded_shuffle")
def srt06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded order of all files; the same on every run."""
    ids = table(spark, sf_dir, "source_files").select("file_id").distinct()
    return ids.withColumn("key", F.xxhash64(F.lit(11), "file_id")).orderBy("key", "file_id").select("file_id")


@query("srt08_sorted_timings", f"WITH {ROWS_SQL} SELECT file_id, list_sort(list(round(confidence, 6))) AS sorted FROM b WHERE confidence IS NOT NULL GROUP BY file_id")
def srt08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per file, whose boundaries are bounded by its length."""
    return rows(spark, sf_dir).where("confidence IS NOT NULL").groupBy("file_id").agg(F.array_sort(F.collect_list(F.round("confidence", 6))).alias("sorted"))


@query("srt09_prefixes", "SELECT DISTINCT file_id, strlen(content) AS bytes, least(strlen(content), 2048) AS head_bytes FROM source_files WHERE content IS NOT NULL")
def srt09(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "source_files").where("content IS NOT NULL")
    return f.select("file_id", F.octet_length("content").cast("long").alias("bytes"), F.octet_length(F.substring(F.encode("content", "UTF-8"), 1, 2048)).cast("long").alias("head_bytes")).distinct()


@query("set01_bag_concat", "SELECT kind, count(*) AS n FROM (SELECT 'file' AS kind FROM source_files UNION ALL SELECT 'golden' FROM golden_pairs UNION ALL SELECT 'document' FROM documents) GROUP BY kind")
def set01(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [table(spark, sf_dir, t).select(F.lit(k).alias("kind")) for k, t in (("file", "source_files"), ("golden", "golden_pairs"), ("document", "documents"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("kind").agg(F.count("*").alias("n"))


@query("set02_split_union", "SELECT file_id, split FROM source_files WHERE split = 'test' UNION ALL SELECT file_id, split FROM source_files WHERE split = 'unseen_language'")
def set02(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "source_files").select("file_id", "split")
    return f.where("split = 'test'").unionByName(f.where("split = 'unseen_language'"))


@query("set03_distinct_union", "SELECT path FROM source_files WHERE prefix(path, 'src/') UNION SELECT path FROM source_files WHERE suffix(path, '.ts')")
def set03(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "source_files").select("path")
    return p.where(F.col("path").startswith("src/")).union(p.where(F.col("path").endswith(".ts"))).distinct()


@query("set04_new_samples", "SELECT path FROM source_files EXCEPT SELECT path FROM source_files WHERE layout_corrected")
def set04(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "source_files")
    return f.select("path").distinct().join(f.where("layout_corrected").select("path"), "path", "left_anti")


@query("set06_repeated_sources", "SELECT md5(content) AS digest, count(DISTINCT file_id) AS files FROM source_files WHERE content IS NOT NULL GROUP BY ALL HAVING count(DISTINCT file_id) > 1")
def set06(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "source_files").where("content IS NOT NULL").select(F.md5("content").alias("digest"), "file_id").distinct()
    return f.groupBy("digest").agg(F.count("*").alias("files")).where("files > 1")


_THREE = "CASE WHEN repository IS NULL THEN 'replay' WHEN CAST(('0x' || substr(sha256(repository || path), 1, 8)) AS BIGINT) % 10 = 0 THEN 'validation' ELSE 'train' END"


@query("set07_three_way", f"SELECT part, count(*) AS n FROM (SELECT DISTINCT file_id, {_THREE} AS part FROM source_files) GROUP BY part")
def set07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trn08(spark, sf_dir).groupBy("part").agg(F.count("*").alias("n"))


@query("trn08_reviewed_split", f"SELECT DISTINCT file_id, {_THREE} AS part FROM source_files")
def trn08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight hex digits of a digest, modulo ten."""
    digest = F.conv(F.substring(F.sha2(F.concat("repository", "path"), 256), 1, 8), 16, 10).cast("long")
    part = F.when(F.col("repository").isNull(), "replay").when(digest % 10 == 0, "validation").otherwise("train")
    return table(spark, sf_dir, "source_files").select("file_id", part.alias("part")).distinct()


# --- scalars


@query("scl01_ascii_lower", "SELECT doc_id, md5(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS digest FROM documents WHERE text IS NOT NULL")
def scl01(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.lexing import ascii_lower

    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.md5(ascii_lower(F.col("text"))).alias("digest"))


@query("scl02_trims", "SELECT doc_id, strlen(trim(text, chr(32) || chr(9) || chr(13))) AS a, strlen(rtrim(text, chr(32) || chr(9))) AS b FROM documents WHERE text IS NOT NULL")
def scl02(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return d.select("doc_id", F.octet_length(F.btrim("text", F.lit(" \t\r"))).cast("long").alias("a"), F.octet_length(F.rtrim("text", F.lit(" \t"))).cast("long").alias("b"))


@query("scl03_substring_tests", "SELECT prefix(path, 'src/') AS starts, suffix(path, '.ts') AS ends, contains(path, 'io') AS holds, count(*) AS n FROM source_files GROUP BY ALL")
def scl03(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return table(spark, sf_dir, "source_files").groupBy(p.startswith("src/").alias("starts"), p.endswith(".ts").alias("ends"), p.contains("io").alias("holds")).agg(F.count("*").alias("n"))


@query("scl04_numeric", "SELECT doc_id, round(log2(1 + n_chars), 6) AS a, round(sqrt(n_chars), 6) AS b, least(greatest(n_chars, 10), 1000) AS c, round(exp(-n_chars / 1000.0), 6) AS d, round(ln(1 + n_chars), 6) AS e FROM documents WHERE n_chars IS NOT NULL")
def scl04(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    return table(spark, sf_dir, "documents").where("n_chars IS NOT NULL").select("doc_id", F.round(F.log2(1 + n), 6).alias("a"), F.round(F.sqrt(n), 6).alias("b"), F.least(F.greatest(n, F.lit(10)), F.lit(1000)).alias("c"), F.round(F.exp(-n / 1000.0), 6).alias("d"), F.round(F.ln(1 + n), 6).alias("e"))


@query("scl05_sha256", "SELECT doc_id, sha256(text) AS sha FROM documents WHERE text IS NOT NULL")
def scl05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("sha"))


@query("scl07_path_parts", "SELECT DISTINCT file_id, path, regexp_extract(path, '\\.[^./]*$') AS ext, regexp_extract(path, '([^/]*)\\.[^./]*$', 1) AS stem, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, regexp_extract(path, '[^/]*$') AS base FROM source_files")
def scl07(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "source_files")
    return p.select("file_id", "path", F.regexp_extract("path", r"\.[^./]*$", 0).alias("ext"), F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1).alias("stem"), F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("dir"), F.regexp_extract("path", "[^/]*$", 0).alias("base")).distinct()


@query("scl08_json", "SELECT source_id, json_extract_string(to_json({'r': repository, 'b': branch}), '$.r') AS repository, branch IS NOT NULL AS has_branch FROM corpus_sources")
def scl08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Serialise, parse and merge: the parsed record laid over a default."""
    j = table(spark, sf_dir, "corpus_sources").select("source_id", F.to_json(F.struct(F.col("repository").alias("r"), F.col("branch").alias("b"))).alias("j"))
    merged = F.map_concat(F.create_map(F.lit("x"), F.lit("")), F.from_json("j", "map<string,string>"))
    return j.select("source_id", F.try_element_at(merged, F.lit("r")).alias("repository"), F.try_element_at(merged, F.lit("b")).isNotNull().alias("has_branch"))


@query("scl09_arrays", "SELECT file_id, class_counts[1:2] AS head, list_position(class_counts, list_max(class_counts)) AS top, len(list_concat(class_counts, [0, 0])) AS padded FROM source_files WHERE class_counts IS NOT NULL")
def scl09(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("class_counts")
    f = table(spark, sf_dir, "source_files").where("class_counts IS NOT NULL")
    return f.select("file_id", F.slice(c, 1, 2).alias("head"), F.array_position(c, F.array_max(c)).cast("int").alias("top"), F.size(F.concat(c, F.array_repeat(F.lit(0).cast("long"), 2))).cast("long").alias("padded"))


@query("scl10_split_join", "SELECT doc_id, len(string_split(text, chr(10))) AS parts, md5(array_to_string(string_split(text, chr(10)), '|')) AS digest FROM documents WHERE text IS NOT NULL")
def scl10(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.split("text", "\n", -1)
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.size(parts).cast("long").alias("parts"), F.md5(F.array_join(parts, "|")).alias("digest"))


@query("scl11_hex_modulo", "SELECT DISTINCT path, CAST(('0x' || substr(sha256(path), 1, 8)) AS BIGINT) % 10 AS bucket FROM source_files")
def scl11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "source_files").select("path", (F.conv(F.substring(F.sha2("path", 256), 1, 8), 16, 10).cast("long") % 10).alias("bucket")).distinct()


@query("scl15_language_index", f"SELECT lang, CAST(list_position({list(LANGUAGES)}, lang) - 1 AS INT) AS language_id, count(*) AS n FROM source_files WHERE lang IS NOT NULL GROUP BY ALL")
def scl15(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = (F.array_position(F.array(*map(F.lit, LANGUAGES)), F.col("lang")) - 1).cast("int")
    return table(spark, sf_dir, "source_files").where("lang IS NOT NULL").groupBy("lang", at.alias("language_id")).agg(F.count("*").alias("n"))


# --- training and evaluation


@query("evl01_golden_regression", f"""WITH g AS (SELECT split, ext, input_text, output_text, string_split(input_text, chr(10)) AS ip, string_split(output_text, chr(10)) AS op FROM golden_pairs WHERE output_text IS NOT NULL),
h AS (SELECT *, list_transform({_GAPS.format(p='ip')}, lambda x: trim(x[2], chr(32) || chr(9) || chr(13))) AS iv, list_transform({_GAPS.format(p='op')}, lambda x: trim(x[2], chr(32) || chr(9) || chr(13))) AS ov FROM g)
SELECT split, ext, count(*) AS cases, count(*) FILTER (input_text = output_text) AS exact, count(*) FILTER (iv = ov) AS preserved, CAST(sum(len(ov)) AS BIGINT) AS lines FROM h GROUP BY ALL""")
def evl01(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "golden_pairs").where("output_text IS NOT NULL")
    for c, t in (("iv", "input_text"), ("ov", "output_text")):
        g = g.withColumn(c, F.expr(f"filter(transform(split({t}, '\\n', -1), x -> trim(BOTH ' \\t\\r' FROM x)), x -> x <> '')"))
    return g.groupBy("split", "ext").agg(F.count("*").alias("cases"), F.count_if(F.col("input_text") == F.col("output_text")).alias("exact"), F.count_if(F.col("iv") == F.col("ov")).alias("preserved"), F.sum(F.size("ov")).alias("lines"))


@query("evl10_parity", f"WITH {LOGITS_SQL} SELECT count(*) AS n, bool_and({_ARG_SQL} = {_ARG_SQL.replace('z', 'p')}) AS all_labels_equal, max(abs(p0 + p1 + p2 - 1)) <= 1e-4 AS within_tolerance FROM r")
def evl10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ways to the probabilities agree: expressions and NumPy in Arrow batches."""
    from ..operators.model import softmax_batches

    z = logits(spark, sf_dir)
    both = z.select(metrics.softmax(F.col("logits")).alias("a"), softmax_batches(F.col("logits")).alias("b"))
    off = F.array_max(F.transform(F.arrays_zip("a", "b"), lambda x: F.abs(x["a"] - x["b"])))
    return both.agg(F.count("*").alias("n"), F.bool_and(metrics.argmax(F.col("a")) == metrics.argmax(F.col("b"))).alias("all_labels_equal"), (F.max(off) <= 1e-4).alias("within_tolerance"))
