"""Evaluation: layouts by the rule against expected texts, leakage, early stopping, groups of cases, held-out languages."""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import containment, evaluation, features, formatting, guards, metrics, model
from ..operators.trees import safe
from ..session import table
from .registry import query
from .structure_queries import _vectors
from .table_queries import _ARG_SQL, _CELLS, _TOP_SQL, LANGUAGES, LOGITS_SQL, ROWS_SQL, logits, rows
from .text_queries import BOUNDS, DOCS, RULE_SQL, bounds, docs, rule, rule_of

# --- the rule's layout of golden inputs, in SQL: rendered once, and again from what came out


def _format_sql(name: str, source: str, text: str) -> str:
    """CTEs up to `name`(doc_id, text): `source`'s column laid out by the rule."""
    own = BOUNDS.replace(DOCS, f"docs AS (SELECT doc_id, {text} AS text FROM {source})")
    for part in ("docs", "cut", "lines", "nonblank", "pairs", "bounds"):
        own = own.replace(f"{part} AS (", f"{name}_{part} AS (").replace(f"FROM {part} ", f"FROM {name}_{part} ").replace(f"FROM {part})", f"FROM {name}_{part})")
    return f"""{own}, {name}_labels AS (SELECT doc_id, boundary_id, {RULE_SQL} AS label FROM {name}_bounds),
{name}_body AS (SELECT n.doc_id, string_agg(rtrim(n.raw, chr(13)) || CASE WHEN l.label IS NULL THEN '' ELSE repeat(CASE WHEN suffix(n.raw, chr(13)) THEN chr(13) || chr(10) ELSE chr(10) END, CAST(1 + l.label AS BIGINT)) END, '' ORDER BY n.nb_pos) AS body
  FROM {name}_nonblank n LEFT JOIN {name}_labels l ON l.doc_id = n.doc_id AND l.boundary_id = n.nb_pos GROUP BY n.doc_id),
{name} AS (SELECT d.doc_id, CASE WHEN b.body IS NULL THEN d.text ELSE regexp_extract(d.text, '^((?:[ \\t\\r]*\\n)*)', 1) || b.body || regexp_extract(d.text, '(\\r?\\n[ \\t\\r\\n]*)$', 1) END AS text FROM {name}_docs d LEFT JOIN {name}_body b USING (doc_id))"""


_SPOTS = "list_transform(list_filter(list_zip(range(len(string_split({t}, chr(10)))), string_split({t}, chr(10))), lambda x: trim(x[2], chr(32) || chr(9) || chr(13)) <> ''), lambda x: {v})"
_VALUE = "trim(x[2], chr(32) || chr(9) || chr(13))"
_CASES = f"""g AS (SELECT case_id AS doc_id, split, ext, input_text, output_text FROM golden_pairs WHERE output_text IS NOT NULL AND input_text IS NOT NULL), {_format_sql('once', 'g', 'input_text')}, {_format_sql('twice', 'once', 'text')},
m AS (SELECT g.*, once.text AS actual, twice.text AS repeated, {_SPOTS.format(t='g.output_text', v='x[1]')} AS e, {_SPOTS.format(t='once.text', v='x[1]')} AS a, {_SPOTS.format(t='g.input_text', v='x[1]')} AS s,
  {_SPOTS.format(t='once.text', v=_VALUE)} = {_SPOTS.format(t='g.input_text', v=_VALUE)} AS preserved FROM g JOIN once USING (doc_id) JOIN twice USING (doc_id)),
q AS (SELECT *, list_filter(range(1, greatest(len(e), 1)), lambda k: k < len(a) AND e[k + 1] - e[k] = a[k + 1] - a[k]) AS hits FROM m)"""


def _rule(left: Column, right: Column) -> Column:
    return rule_of(left["value"], right["value"], left["indent"], right["indent"])


def _laid_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "golden_pairs").where("output_text IS NOT NULL AND input_text IS NOT NULL")
    return evaluation.formatted(evaluation.formatted(g, "input_text", "actual", _rule), "actual", "repeated", _rule)


def _sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.regression_sums(evaluation.regression(_laid_out(spark, sf_dir), "actual", "repeated", "input_text", "output_text", "split"), "split")


_SUMS_SQL = "count(*) AS cases, count(*) FILTER (actual = output_text) AS exact_output, count(*) FILTER (preserved) AS nonblank_preserved, count(*) FILTER (repeated = actual) AS idempotent, CAST(sum(greatest(len(e) - 1, 0)) AS BIGINT) AS gaps_total, CAST(sum(len(hits)) AS BIGINT) AS gaps_correct"


@query("agg12_split_sums", f"WITH {_CASES} SELECT split, {_SUMS_SQL} FROM q GROUP BY split")
def agg12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per split: cases, and those laid out exactly, with their lines kept, and unchanged by a second pass; gaps and right ones."""
    return _sums(spark, sf_dir)


@query("trn10_regression_gate", f"WITH {_CASES}, t AS (SELECT split, {_SUMS_SQL} FROM q GROUP BY split) SELECT split, cases, exact_output = cases AND nonblank_preserved = cases AND idempotent = cases AS passed FROM t")
def trn10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each split qualifies the rule: all cases exact, preserved and idempotent, for the engine of the report."""
    return evaluation.regression_gate(_sums(spark, sf_dir), "rule", "rule", 0.0, 0.0).select("split", "cases", "passed")


_ASSERTED = f"WITH {_CASES}, x AS (SELECT *, unnest(range(1, len(e))) AS k FROM q), r AS (SELECT doc_id, ext, s[k] + 1 AS after_line, e[k + 1] - e[k] - 1 AS expected, a[k + 1] - a[k] - 1 AS actual FROM x WHERE k <= len(s))"
_STYLE = "count(*) AS total, count(*) FILTER (expected = actual) AS passed, count(*) FILTER (expected > 0) AS required_gaps, count(*) FILTER (expected > 0 AND expected = actual) AS correct_gaps, count(*) FILTER (expected = 0) AS required_continuity, count(*) FILTER (expected = 0 AND actual = 0) AS correct_continuity"


def _assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.assertions(_laid_out(spark, sf_dir), "actual", "input_text", "output_text", "case_id", "ext")


@query("evl05_style_assertions", _ASSERTED + " SELECT doc_id AS case_id, ext, after_line, expected, actual, coalesce(expected = actual, false) AS passed FROM r")
def evl05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every boundary of every expected text: the gap it must have, the one that the rule gives, and whether it holds."""
    return _assertions(spark, sf_dir)


@query("agg10_style_counts", _ASSERTED + f" SELECT ext, ext IN {evaluation.UNSEEN} AS unseen, {_STYLE} FROM r GROUP BY ALL")
def agg10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per language: assertions, those met, required gaps and continuity, each with those that are right."""
    a = _assertions(spark, sf_dir).withColumn("unseen", F.col("ext").isin(*evaluation.UNSEEN))
    return evaluation.style_counts(a, "ext", "unseen")


_FOUR = f"WITH {LOGITS_SQL}, {BOUNDS}, k AS (SELECT doc_id AS file_id, boundary_id, {RULE_SQL} AS by_rule FROM bounds), u AS (SELECT gap_label, unnest(['raw', 'thresholded', 'rule', 'unchanged']) AS method, unnest([{_ARG_SQL}, CASE WHEN {_TOP_SQL} < 0.5 THEN 0 ELSE {_ARG_SQL} END, by_rule, 0]) AS prediction FROM r JOIN k USING (file_id, boundary_id))"


@query("evl03_methods", _FOUR + f" SELECT method, {_CELLS} FROM u GROUP BY method")
def evl03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four ways to decide on one set of boundaries: scores, scores above a threshold, the rule, no gap."""
    by_rule = bounds(spark, sf_dir).select(F.col("doc_id").alias("file_id"), "boundary_id", rule().alias("by_rule"))
    z = logits(spark, sf_dir).join(by_rule, ["file_id", "boundary_id"])
    guess = metrics.argmax(F.col("logits"))
    sure = F.array_max(metrics.softmax(F.col("logits"))) >= 0.5
    ways = {"raw": guess, "thresholded": F.when(sure, guess).otherwise(0), "rule": F.col("by_rule"), "unchanged": F.lit(0)}
    each = F.array(*(F.struct(F.lit(n).alias("method"), c.cast("int").alias("prediction")) for n, c in ways.items()))
    return metrics.confusion(z.select("gap_label", F.inline(each)), "gap_label", "prediction", "method")


# --- early stopping

_SCORES = f"WITH RECURSIVE {ROWS_SQL}, e AS (SELECT language_id AS run, CAST(floor(epoch_ms(labeled_at) / 86400000) AS BIGINT) AS epoch, CAST(sum(CAST(round(confidence * 1000000) AS BIGINT)) // count(*) AS BIGINT) AS score FROM b WHERE confidence IS NOT NULL AND labeled_at IS NOT NULL GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY epoch) AS k FROM e)"


@query("win09_early_stop", _SCORES + """, f AS (SELECT run, k, epoch AS best_epoch, score AS best_score, 0 AS waited, epoch AS stopped_at FROM n WHERE k = 1
UNION ALL SELECT n.run, n.k, CASE WHEN n.score > f.best_score + 100 THEN n.epoch ELSE f.best_epoch END, CASE WHEN n.score > f.best_score + 100 THEN n.score ELSE f.best_score END, CASE WHEN n.score > f.best_score + 100 THEN 0 ELSE f.waited + 1 END, n.epoch FROM f JOIN n ON n.run = f.run AND n.k = f.k + 1 WHERE f.waited < 5)
SELECT run, arg_max(best_epoch, k) AS best_epoch, CAST(arg_max(best_score, k) AS DOUBLE) AS best_score, arg_max(stopped_at, k) AS stopped_at FROM f GROUP BY run""")
def win09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each run stops: five days in a row without a gain of more than 0.0001, in millionths; one epoch a day."""
    day = F.floor(F.unix_millis(F.col("labeled_at").cast("timestamp")) / 86_400_000)
    b = rows(spark, sf_dir).where("confidence IS NOT NULL AND labeled_at IS NOT NULL")
    score = F.floor(F.sum(F.round(F.col("confidence") * 1_000_000).cast("long")) / F.count("*"))
    e = b.groupBy(F.col("language_id").alias("run"), day.alias("epoch")).agg(score.alias("score"))
    return evaluation.early_stop(e, "run", "epoch", "score", gain=100, patience=5)


# --- leakage

_SIDES = "c AS (SELECT case_id, regexp_replace(input_text, '[ \\t\\r\\n\\x0B\\f]', '', 'g') AS p FROM golden_pairs WHERE input_text IS NOT NULL), f AS (SELECT DISTINCT file_id, split, regexp_replace(content, '[ \\t\\r\\n\\x0B\\f]', '', 'g') AS t FROM source_files WHERE content IS NOT NULL)"


def _sides(spark: SparkSession, sf_dir: str, *splits: str) -> tuple[DataFrame, DataFrame]:
    files = table(spark, sf_dir, "source_files").where(F.col("split").isin(*splits)).select("file_id", "content")
    return files, table(spark, sf_dir, "golden_pairs").select("case_id", "input_text")


@query("jon08_containment", f"WITH {_SIDES} SELECT DISTINCT c.case_id, f.file_id FROM c JOIN f ON contains(f.t, c.p) WHERE c.p <> '' AND f.split IN ('train', 'style_train')")
def jon08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Golden inputs that a training file holds, white space aside."""
    return containment.containments(*_sides(spark, sf_dir, "train", "style_train")).select("case_id", F.col("row_id").alias("file_id"))


@query("evl09_sample_checks", f"""WITH {_SIDES}, d AS (SELECT case_id, count(*) OVER (PARTITION BY p) > 1 AS duplicate FROM c), t AS (SELECT DISTINCT case_id FROM c JOIN f ON contains(f.t, c.p) WHERE c.p <> '' AND f.split IN ('train', 'style_train')),
v AS (SELECT DISTINCT case_id FROM c JOIN f ON contains(f.t, c.p) OR contains(c.p, f.t) WHERE c.p <> '' AND f.t <> '' AND f.split IN ('validation', 'style_validation'))
SELECT d.case_id, d.duplicate, t.case_id IS NOT NULL AS in_training, v.case_id IS NOT NULL AS in_development FROM d LEFT JOIN t USING (case_id) LEFT JOIN v USING (case_id)""")
def evl09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per golden input: whether another has the same text, whether a training file holds it, and whether a development
    file holds it or lies within it, white space aside."""
    g = table(spark, sf_dir, "golden_pairs").where("input_text IS NOT NULL").select("case_id", containment.compact("input_text").alias("p"))
    several = g.groupBy("p").agg(F.count("*").alias("n"))
    held = containment.containments(*_sides(spark, sf_dir, "train", "style_train")).select("case_id", F.lit(True).alias("t")).distinct()
    dev = _sides(spark, sf_dir, "validation", "style_validation")
    near = containment.containments(*dev).union(containment.containments(*dev, inside=True)).select("case_id", F.lit(True).alias("v")).distinct()
    out = g.join(several, "p").join(held, "case_id", "left").join(near, "case_id", "left")
    no = F.lit(False)
    return out.select("case_id", (F.col("n") > 1).alias("duplicate"), F.coalesce("t", no).alias("in_training"), F.coalesce("v", no).alias("in_development"))


# --- groups of cases

# Groups of cases after the twelve languages; channels of the vectors tell the first four.
GROUPS = ("comment-boundaries", "nested-blocks", "long-expressions", "top-level-sections", "protected-regions", "crlf", "idempotence", "perturbed-layout")
CHUNK, LEAST_ROWS, PER_FILE, PER_GROUP = 8, 4, 3, 30


def case_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, chunk, language_id, rows and the groups that it can stand for: up to eight boundaries of a file in a row."""
    v = _vectors(spark, sf_dir, 1, 8, 9, 12, 13, 17, 25, 26).where("blank_lines <= 2")
    at = lambda n: F.element_at("input", n + 1)
    marks = (at(17) == 1, (at(1) > 0) & ((at(12) == 1) | (at(13) == 1)), (at(8) > 0.7) | (at(9) > 0.7), (at(25) == 1) & (at(26) == 1))
    w = Window.partitionBy("doc_id").orderBy("boundary_id")
    c = v.select("doc_id", F.floor((F.row_number().over(w) - 1) / CHUNK).cast("int").alias("chunk"), *(m.alias(f"m{n}") for n, m in enumerate(marks)))
    c = c.groupBy("doc_id", "chunk").agg(F.count("*").alias("rows"), *(F.bool_or(f"m{n}").alias(f"m{n}") for n in range(4))).where(F.col("rows") >= LEAST_ROWS)
    lang = docs(spark, sf_dir).select("doc_id", (F.array_position(F.array(*map(F.lit, LANGUAGES)), F.col("lang")) - 1).cast("int").alias("language_id"))
    rest = F.array(*(F.when(F.col(f"m{n}"), F.lit(12 + n)) for n in range(4)), *(F.lit(n) for n in range(16, 20)))
    groups = F.array_compact(F.concat(F.array(F.when(F.col("language_id") >= 0, F.col("language_id"))), rest))
    return c.join(lang, "doc_id").select("doc_id", "chunk", "language_id", "rows", groups.alias("groups"))


def pick_cases(found: list[tuple[int, int, int]], per_file: int = PER_FILE, per_group: int = PER_GROUP) -> list[tuple[int, int, int]]:
    """(group, doc_id, chunk): groups in order, each chunk once; first up to per_file of a file, then any, up to per_group."""
    used: set[tuple[int, int]] = set()
    out = []
    for group in range(len(LANGUAGES) + len(GROUPS)):
        own = sorted((d, c) for g, d, c in found if g == group)
        taken: dict[int, int] = {}
        count = 0
        for limit in (per_file, len(own) + 1):
            for d, c in own:
                if count < per_group and (d, c) not in used and taken.get(d, 0) < limit:
                    used.add((d, c))
                    taken[d] = taken.get(d, 0) + 1
                    count += 1
                    out.append((group, d, c))
    return out


@query("evl02_case_groups")
def evl02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cases of twenty groups, up to thirty each, in file order: which chunk stands for which group.

    A group can lose at most all cases of the others to them, so the first of each group, few of each file, are enough
    for the choice, which is made on the driver; their number is fixed.
    """
    most = PER_GROUP * (len(LANGUAGES) + len(GROUPS))
    c = case_chunks(spark, sf_dir).select("doc_id", "chunk", F.explode("groups").alias("group"))
    in_file = F.row_number().over(Window.partitionBy("group", "doc_id").orderBy("chunk"))
    few = c.withColumn("k", in_file).where(F.col("k") <= PER_FILE * (len(LANGUAGES) + len(GROUPS)) + PER_GROUP)
    first = few.withColumn("r", F.row_number().over(Window.partitionBy("group").orderBy("doc_id", "chunk"))).where(F.col("r") <= most * PER_GROUP)
    picked = pick_cases([(r.group, r.doc_id, r.chunk) for r in first.collect()])
    names = (*LANGUAGES[:6], *(f"unseen-{n}" for n in LANGUAGES[6:]), *GROUPS)
    return spark.createDataFrame([(names[g], d, c) for g, d, c in picked], "case_group string, doc_id long, chunk int")


# --- held-out languages


@query("evl06_transfer")
def evl06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leave one language out: a classifier trained on a bounded sample of the others, and its confusion on all
    boundaries of the language it has not seen. The scanner's labels give the sample, whose files alone get vectors for
    training; one pass scores all languages, each by its own classifier, and hands on counts."""
    number = (F.array_position(F.array(*map(F.lit, LANGUAGES)), F.col("lang")) - 1).cast("int")
    d = docs(spark, sf_dir).select("doc_id", "text", number.alias("held_out")).where("held_out >= 0")
    fitted = leave_one_out(*transfer_sample(d))
    return metrics.counted(model.choice(fitted, d, "held_out"), "gap_label", "prediction", "n", "held_out")


#: Files of a language that are scanned first for its sample: the ones with the smallest possible hashes of boundaries.
LIKELY = 1000


def transfer_sample(documents: DataFrame, per_label: int = 60, likely: int = LIKELY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors, labels and languages of up to per_label boundaries of each language and label, by hash and in that order.

    documents has doc_id, text and held_out, the number of its language. The order is part of the training. A file's
    boundaries are fewer than its lines, so the smallest hash that any of them can have is known without the scanner.
    Scanned are all files with two blank lines in a row, and those whose smallest hash is below a language's limit;
    where that leaves less than per_label boundaries of a label below the limit, all files of the language.
    """
    spark, d = documents.sparkSession, documents.where("doc_id IS NOT NULL AND text IS NOT NULL")
    ids = F.sequence(F.lit(0), F.length("text") - F.length(F.replace("text", F.lit("\n"))))
    least = F.array_min(F.transform(ids, lambda k: F.xxhash64("doc_id", k.cast("int"))))
    ranked = d.select("held_out", least.alias("least")).withColumn("rn", F.row_number().over(Window.partitionBy("held_out").orderBy("least")))
    limits = {r.held_out: r.least for r in ranked.where(F.col("rn") == likely + 1).collect()}
    below = lambda h: F.coalesce(h < F.get(F.lit([limits.get(k) for k in range(len(LANGUAGES))]).cast("array<long>"), F.col("held_out")), F.lit(True))
    hashed = F.xxhash64("doc_id", "boundary_id")
    order = Window.partitionBy("held_out", "blank_lines").orderBy("hash", "doc_id", "boundary_id")

    def first(files: DataFrame, which: Column) -> list:
        near = features.boundary_labels(files, "held_out").withColumn("hash", hashed).where("blank_lines <= 2").where(which)
        return near.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= per_label).collect()

    picked = first(d.where(F.col("text").rlike("\\n[ \\t\\r]*+\\n[ \\t\\r]*+\\n") | below(least)), (F.col("blank_lines") == 2) | below(F.col("hash")))
    full = Counter((r.held_out, r.blank_lines) for r in picked)
    short = [k for k in limits if min(full[k, 0], full[k, 1]) < per_label]
    if short:
        picked = [r for r in picked if r.held_out not in short] + first(d.where(F.col("held_out").isin(short)), F.lit(True))
    if not picked:
        return np.zeros((0, features.WIDTH)), np.zeros(0, dtype=int), np.zeros(0, dtype=int)
    files = spark.createDataFrame([(k,) for k in sorted({r.doc_id for r in picked})], "doc_id long")
    places: dict[int, list[int]] = {}
    for r in picked:
        places.setdefault(r.doc_id, []).append(r.boundary_id)
    v = features.picked_vectors(d.join(F.broadcast(files), "doc_id", "left_semi"), places)
    found = {(r.doc_id, r.boundary_id): r.input for r in v.collect()}
    picked.sort(key=lambda r: (r.held_out, r.blank_lines, r.rn))
    return np.array([found[r.doc_id, r.boundary_id] for r in picked], dtype=np.float64), np.array([r.blank_lines for r in picked], dtype=int), np.array([r.held_out for r in picked], dtype=int)


def leave_one_out(x: np.ndarray, y: np.ndarray, g: np.ndarray) -> dict[int, dict[str, np.ndarray]]:
    """For each language a classifier trained on the others; none where there are no others."""
    return {int(k): model.train(x[g != k], y[g != k], g[g != k], epochs=3)[0] for k in np.unique(g) if (g != k).any()}


# --- structure by delimiters


@query("flt12_safe_structure")
def flt12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by what their structure does under other gaps: ok, open, unsafe, changed."""
    return docs(spark, sf_dir).groupBy(guards.per_text("text", "string", guards.on_bytes(safe)).alias("structure")).agg(F.count("*").alias("files"))


@query("cor11_statement_pairs")
def cor11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring statements of every file, by nonblank line."""
    return guards.statement_pairs(docs(spark, sf_dir))


@query("cor12_test_regions")
def cor12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte ranges of declarations of tests."""
    return guards.regions_of_tests(docs(spark, sf_dir).withColumn("ext", F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))))


@query("cor13_fingerprints")
def cor13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The structural fingerprint of every file that has one."""
    from ..operators.trees import fingerprint

    return docs(spark, sf_dir).select("doc_id", guards.per_text("text", "string", guards.on_bytes(fingerprint)).alias("fingerprint")).where("fingerprint IS NOT NULL")


# --- sessions


@query("str05_incremental_format")
def str05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Golden inputs formatted by sessions that hand out vectors in batches and take labels back, by the rule."""
    g = table(spark, sf_dir, "golden_pairs").where("input_text IS NOT NULL").select(F.col("case_id").alias("doc_id"), F.col("input_text").alias("text"))
    return formatting.format_in_sessions(g, batch=16)


@query("flt03_confidence_range", "SELECT count(*) AS n, count(*) FILTER (confidence >= 0 AND confidence <= 1) AS valid, count(*) FILTER (confidence < 0 OR confidence > 1 OR isnan(confidence)) AS invalid FROM boundary_rows WHERE confidence IS NOT NULL")
def flt03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidences that a session would take: finite and from 0 to 1."""
    b = table(spark, sf_dir, "boundary_rows").where("confidence IS NOT NULL")
    ok = formatting.valid_confidence(F.col("confidence"))
    return b.agg(F.count("*").alias("n"), F.count_if(ok).alias("valid"), F.count_if(~ok).alias("invalid"))


@query("snk11_feedback", "SELECT file_id, '{\"hookSpecificOutput\":{\"hookEventName\":\"PostToolUse\",\"additionalContext\":\"' || 'Formatted ' || path || '\"}}' AS line FROM (SELECT DISTINCT file_id, path FROM source_files WHERE layout_corrected)")
def snk11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line of JSON for each file whose layout was corrected."""
    f = table(spark, sf_dir, "source_files").where("layout_corrected").select("file_id", "path").distinct()
    told = F.struct(F.lit("PostToolUse").alias("hookEventName"), F.concat(F.lit("Formatted "), "path").alias("additionalContext"))
    return f.select("file_id", F.to_json(F.struct(told.alias("hookSpecificOutput"))).alias("line"))


@query("str04_fifo", "WITH r AS (SELECT event_id, user_id, row_number() OVER w AS place, coalesce(value > 0, false) AS ok FROM events WHERE user_id IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT event_id, place, ok, count(*) FILTER (ok) OVER (PARTITION BY user_id ORDER BY place) AS done FROM r")
def str04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of each user in order: place in the queue, whether it succeeds, and how many have succeeded so far; one
    that fails leaves those behind it as they are."""
    from ..streaming import events as streams

    e = table(spark, sf_dir, "events").where("user_id IS NOT NULL")
    return streams.fifo(e, "user_id", ["ts", "event_id"], F.coalesce(F.col("value") > 0, F.lit(False))).select("event_id", "place", "ok", "done")


# --- annotations of siblings: the next line of the same indentation, at most eight nonblank lines on, and whether it
# should stand apart: where either of the two ends in an opening brace

_AHEAD = 8
_NOTES = f"""{BOUNDS}, notes AS (SELECT a.doc_id, a.line_no AS left_line, min(b.line_no) AS right_line FROM nonblank a JOIN nonblank b ON b.doc_id = a.doc_id AND b.nb_pos BETWEEN a.nb_pos + 1 AND a.nb_pos + {_AHEAD} AND b.indent = a.indent GROUP BY ALL),
judged AS (SELECT b.blank_lines, b.doc_id, b.boundary_id, n.left_line IS NOT NULL AS noted, n.right_line = b.rl AS sibling, CASE WHEN suffix(b.lv, '{{') OR suffix(b.rv, '{{') THEN 1 ELSE 0 END AS standard FROM bounds b LEFT JOIN notes n ON n.doc_id = b.doc_id AND n.left_line = b.ll)"""


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundaries with the annotation of their left line: whether there is one, and whether it names their right line."""
    from ..operators import layout

    nb = layout.with_nonblank(docs(spark, sf_dir)).select("doc_id", F.transform("nb", lambda x: F.struct(x["line_no"].alias("line_no"), x["indent"].alias("indent"))).alias("s"))
    ahead = "transform(s, (x, i) -> named_struct('left_line', x.line_no, 'right_line', get(filter(slice(s, i + 2, 8), y -> y.indent = x.indent), 0).line_no))"
    # one row a line; a lambda over the small array of line numbers and indents
    notes = nb.select("doc_id", F.explode(F.expr(ahead)).alias("n")).select("doc_id", "n.*").where("right_line IS NOT NULL")
    b = bounds(spark, sf_dir)
    apart = F.col("lv").endswith("{") | F.col("rv").endswith("{")
    j = b.join(notes, (b["doc_id"] == notes["doc_id"]) & (b["ll"] == notes["left_line"]), "left")
    return j.select(b["doc_id"], "boundary_id", "blank_lines", F.col("left_line").isNotNull().alias("noted"), (F.col("right_line") == F.col("rl")).alias("sibling"), apart.cast("int").alias("standard"))


@query("jon02_sibling_annotations", f"WITH {_NOTES} SELECT doc_id, count(*) AS n, count(*) FILTER (noted) AS annotated, count(*) FILTER (sibling) AS siblings FROM judged GROUP BY doc_id")
def jon02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per file: boundaries, those whose left line has an annotation, and those whose right line is the one it names."""
    return _judged(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if("noted").alias("annotated"), F.count_if("sibling").alias("siblings"))


@query("agg09_standard_counters", f"WITH {_NOTES} SELECT count(*) AS rows, count(*) FILTER (coalesce(sibling, false)) AS siblings, count(*) FILTER (NOT coalesce(sibling, false)) AS unclassified, count(*) FILTER (sibling AND standard <> least(blank_lines, 1)) AS changed, count(*) FILTER (sibling AND standard = 0) AS label0, count(*) FILTER (sibling AND standard = 1) AS label1 FROM judged WHERE blank_lines <= 2")
def agg09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that can be trained on, those that an annotation classifies, those whose label it changes, and its labels."""
    j = _judged(spark, sf_dir).where("blank_lines <= 2")
    s = F.coalesce("sibling", F.lit(False))
    return j.agg(
        F.count("*").alias("rows"), F.count_if(s).alias("siblings"), F.count_if(~s).alias("unclassified"), F.count_if(s & (F.col("standard") != F.least("blank_lines", F.lit(1)))).alias("changed"),
        F.count_if(s & (F.col("standard") == 0)).alias("label0"), F.count_if(s & (F.col("standard") == 1)).alias("label1"),
    )


@query("trn05_feedback_labels", f"WITH {BOUNDS}, t AS (SELECT blank_lines, {RULE_SQL} AS teacher FROM bounds JOIN (SELECT doc_id AS d, layout_corrected FROM docs) ON d = doc_id WHERE layout_corrected AND blank_lines <= 2) SELECT CASE WHEN blank_lines > 0 AND teacher > 0 THEN teacher WHEN blank_lines > 0 THEN 1 ELSE 0 END AS label, count(*) AS n FROM t GROUP BY ALL")
def trn05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of files whose layout was corrected: where a gap is, the teacher's count if it has one, else 1."""
    from ..operators import layout

    b = layout.boundaries(docs(spark, sf_dir).where("layout_corrected")).where("blank_lines <= 2")
    teacher = rule_of(F.col("l.value"), F.col("r.value"), F.col("l.indent"), F.col("r.indent"))
    t = b.select("blank_lines", teacher.alias("teacher"))
    label = F.when((F.col("blank_lines") > 0) & (F.col("teacher") > 0), F.col("teacher")).when(F.col("blank_lines") > 0, 1).otherwise(0)
    return t.groupBy(label.alias("label")).agg(F.count("*").alias("n"))


@query("evl04_seen_unseen", f"WITH {BOUNDS}, s AS (SELECT list_position({list(LANGUAGES)}, lang) > 6 AS unseen, least(blank_lines, 2) AS gap_label, {RULE_SQL} AS prediction FROM bounds JOIN (SELECT doc_id AS d, lang FROM docs) ON d = doc_id WHERE list_position({list(LANGUAGES)}, lang) > 0) SELECT unseen, {_CELLS} FROM s GROUP BY ALL")
def evl04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion of the rule over languages that training knows and those that it leaves out."""
    from ..operators import layout

    d = docs(spark, sf_dir).withColumn("at", F.array_position(F.array(*map(F.lit, LANGUAGES)), F.col("lang"))).where("at > 0")
    b = layout.boundaries(d, "at")
    guess = rule_of(F.col("l.value"), F.col("r.value"), F.col("l.indent"), F.col("r.indent"))
    s = b.select((F.col("at") > 6).alias("unseen"), F.least("blank_lines", F.lit(2)).alias("gap_label"), guess.alias("prediction"))
    return metrics.confusion(s, "gap_label", "prediction", "unseen")


@query("flt13_path_predicates", "SELECT DISTINCT file_id, path FROM source_files WHERE (prefix(path, 'src/') OR prefix(path, 'lib/') OR path IN ('src', 'lib')) AND (suffix(path, '.py') OR suffix(path, '.ts'))")
def flt13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files under given folders with given extensions."""
    from ..functions import under, with_extension

    f = table(spark, sf_dir, "source_files").select("file_id", "path").distinct()
    return f.where(under(F.col("path"), "src", "lib") & with_extension(F.col("path"), ".py", ".ts"))
