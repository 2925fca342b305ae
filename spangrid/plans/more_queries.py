"""Steps of larger operators as queries of their own, and a few sources and scalars."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import markdown_escape
from ..operators import features, guards, layout, metrics, model, roles, scanner, units
from ..session import table
from ..sources.files import read_paths, read_text
from .registry import ORACLES, query
from .structure_queries import _sample, _vectors
from .table_queries import LOGITS_SQL, logits
from .text_queries import BOUNDS, DOCS, LINES, NONBLANK, RULE_SQL, bounds, docs, fea16, rule


@query("win04_weighted_context", f"SELECT doc_id, boundary_id, side, bucket, round(sum(1.0 / distance), 6) AS weight FROM ({ORACLES['fea16_context_buckets']}) GROUP BY ALL")
def win04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels 96 to 127: buckets of context words, nearer lines counting more."""
    return fea16(spark, sf_dir).groupBy("doc_id", "boundary_id", "side", "bucket").agg(F.round(F.sum(1.0 / F.col("distance")), 6).alias("weight"))


@query("win06_comment_runs")
def win06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every comment line, the first later line that is none; the last line where all are comments."""
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    lines = features.scanned_lines(docs(spark, sf_dir)).where("NOT blank")
    nxt = F.first(F.when(~F.col("comment"), F.col("line_no")), ignorenulls=True).over(w)
    return lines.select("doc_id", "line_no", "comment", F.coalesce(nxt, F.max("line_no").over(w)).alias("next_line")).where("comment").drop("comment")


_BACK = ", ".join(f"lag(indent, {k}) OVER w AS d{k}" for k in range(1, 17))
_NEAR = " ".join(f"WHEN d{k} <= indent THEN {k}" for k in range(1, 17))
_LEVEL = " ".join(f"WHEN d{k} <= indent THEN d{k}" for k in range(1, 17))


@query("jon11_nearest_same_indent", f"WITH {NONBLANK}, c AS (SELECT doc_id, nb_pos, indent, {_BACK} FROM nonblank WINDOW w AS (PARTITION BY doc_id ORDER BY nb_pos)), n AS (SELECT doc_id, nb_pos, indent, nb_pos - CASE {_NEAR} END AS near, CASE {_LEVEL} END AS level FROM c) SELECT doc_id, nb_pos, CAST(near AS INT) AS near FROM n WHERE level = indent")
def jon11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of the sixteen lines before with the same indent, unless a shallower one is nearer: an as-of lookup
    inside a document's own array."""
    nb = layout.with_nonblank(docs(spark, sf_dir)).where("size(nb) > 1").select("doc_id", F.transform("nb", lambda x: x["indent"]).alias("d"))
    near = F.expr("transform(sequence(1, size(d) - 1), i -> named_struct('nb_pos', i, 'near', array_max(filter(sequence(greatest(i - 16, 0), i - 1), k -> d[k] <= d[i]))))")
    return nb.select("doc_id", "d", F.explode(near).alias("x")).where("x.near IS NOT NULL AND d[x.near] = d[x.nb_pos]").select("doc_id", "x.*")


_MARK = "#[cfg(test)]"


@query("jon12_offsets_to_lines", f"WITH {LINES}, s AS (SELECT doc_id, line_no, CAST(sum(strlen(raw) + 1) OVER (PARTITION BY doc_id ORDER BY line_no) AS BIGINT) AS after_, strlen(raw) + 1 AS size FROM lines), o AS (SELECT doc_id, unnest(range(0, strlen(text), 1000)) AS byte_offset, CASE WHEN contains(text, '{_MARK}') THEN strlen(string_split(text, '{_MARK}')[1]) END AS region FROM docs) SELECT o.doc_id, o.byte_offset, s.line_no, coalesce(o.byte_offset >= o.region, false) AS excluded FROM o JOIN s ON s.doc_id = o.doc_id AND o.byte_offset >= s.after_ - s.size AND o.byte_offset < s.after_")
def jon12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every thousandth byte, its line, and whether it lies in the region that a mark of tests opens up to the end: each
    line names the offsets it holds, so the range join needs no join."""
    starts = F.expr("aggregate(ps, named_struct('at', CAST(0 AS BIGINT), 'out', CAST(array() AS array<struct<line_no: int, a: bigint, z: bigint>>)), (s, x) -> named_struct('at', s.at + octet_length(x) + 1, 'out', concat(s.out, array(named_struct('line_no', size(s.out), 'a', s.at, 'z', s.at + octet_length(x))))), s -> s.out)")
    region = F.when(F.col("text").contains(_MARK), F.octet_length(F.substring_index("text", _MARK, 1)))
    lines = docs(spark, sf_dir).select("doc_id", F.octet_length("text").alias("bytes"), region.alias("region"), layout.pieces().alias("ps")).select("doc_id", "bytes", "region", F.explode(starts).alias("l"))
    first, last = F.ceil(F.col("l.a") / 1000), F.floor(F.col("l.z") / 1000)
    held = lines.where(first <= last).select("doc_id", "bytes", "region", F.col("l.line_no").alias("line_no"), F.explode(F.sequence(first, last)).alias("k"))
    at = F.col("k") * 1000
    return held.where(at < F.col("bytes")).select("doc_id", at.alias("byte_offset"), "line_no", F.coalesce(at >= F.col("region"), F.lit(False)).alias("excluded"))


@query("srt03_argmax", f"WITH {LOGITS_SQL} SELECT file_id, boundary_id, CAST(CASE WHEN z0 >= z1 AND z0 >= z2 THEN 0 WHEN z1 >= z2 THEN 1 ELSE 2 END AS INT) AS top FROM r")
def srt03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logits(spark, sf_dir).select("file_id", "boundary_id", metrics.argmax(F.col("logits")).alias("top"))


@query("rol03_after_at_sign", f"WITH {NONBLANK}, {roles.ROLE_SQL} SELECT head AS name, role, count(*) AS n FROM roles WHERE prefix(value, '@') GROUP BY ALL")
def rol03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of lines with a leading at sign, which is skipped once: the token behind it decides, white space too."""
    v = layout.nonblank(docs(spark, sf_dir)).where(F.col("value").startswith("@"))
    name = F.regexp_extract("value", r"^@([0-9A-Za-z_\x{80}-\x{10FFFF}]+|(?s:.)|)", 1)
    return v.groupBy(name.alias("name"), roles.role(F.col("value")).alias("role")).agg(F.count("*").alias("n"))


@query("rol04_equals_scan", f"WITH {NONBLANK}, {roles.ROLE_SQL} SELECT role, count(*) AS n FROM roles WHERE contains(value, '=') GROUP BY role")
def rol04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of lines with an equals sign."""
    lines = layout.nonblank(docs(spark, sf_dir)).where(F.col("value").contains("="))
    return lines.select(roles.role(F.col("value")).alias("role")).groupBy("role").agg(F.count("*").alias("n"))


_BODY = r"^(class|struct|impl|fn|function|def|namespace|interface)([^A-Za-z0-9_]|$)"
_BODY_SQL = f"(regexp_extract(value, '^@?([A-Za-z0-9_]+)', 1) IN {roles.CONTROL} OR contains(value, '=>') OR regexp_matches(value, '{_BODY}') OR (NOT contains(value, '=') AND contains(value, '(')))"


@query("unt02_body_braces", f"WITH {NONBLANK} SELECT {_BODY_SQL} AS body, count(*) AS n FROM nonblank WHERE suffix(value, '{{') GROUP BY ALL")
def unt02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an opening brace begins a body of code or a value."""
    v = F.col("value")
    body = F.regexp_extract(v, "^@?([A-Za-z0-9_]+)", 1).isin(*roles.CONTROL) | v.contains("=>") | v.rlike(_BODY) | (~v.contains("=") & v.contains("("))
    return layout.nonblank(docs(spark, sf_dir)).where(v.endswith("{")).groupBy(body.alias("body")).agg(F.count("*").alias("n"))


@query("unt06_line_predicates", f"WITH {NONBLANK} SELECT substr(value, 1, 1) IN ('}}', ')', ']') OR value IN ('end', 'end;') AS closing, right(value, 1) IN ('=', ',', '+', '|', '&') OR suffix(value, '=>') AS trailing, regexp_matches(value, '^end([^A-Za-z0-9_]|$)') AS is_end, count(*) AS n FROM nonblank GROUP BY ALL")
def unt06(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    closing = F.substring(v, 1, 1).isin("}", ")", "]") | v.isin("end", "end;")
    trailing = F.substring(v, -1, 1).isin("=", ",", "+", "|", "&") | v.endswith("=>")
    return layout.nonblank(docs(spark, sf_dir)).groupBy(closing.alias("closing"), trailing.alias("trailing"), v.rlike("^end([^A-Za-z0-9_]|$)").alias("is_end")).agg(F.count("*").alias("n"))


def _per_file(spark: SparkSession, sf_dir: str, schema: str, rows) -> DataFrame:
    """rows(nonblank lines of a document) gives tuples after the document's id."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for key, text in zip(pdf["doc_id"], pdf["text"]):
                lines = [x for x in scanner.scan(scanner.as_bytes(text))[0] if not x.blank]
                out += [(key, *r) for r in rows(lines)]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return docs(spark, sf_dir).select("doc_id", "text").mapInPandas(run, schema)


@query("unt04_unit_starts")
def unt04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that begin no unit."""
    return _per_file(spark, sf_dir, "doc_id long, nb_pos int", _no_start)


def _no_start(lines: list[scanner.Line]) -> list[tuple[int]]:
    starting = units.units(lines)[0]
    return [(k,) for k in range(len(lines)) if k not in starting]


@query("unt05_units_by_end")
def unt05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unit that counts where several end on one line: the one that began first."""
    return _per_file(spark, sf_dir, "doc_id long, last int, first int, role string", lambda lines: [(u.last, u.first, u.role) for u in units.units(lines)[1].values()])


@query("unt07_interiors")
def unt07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines inside an open delimiter that is no body of code."""
    return _per_file(spark, sf_dir, "doc_id long, nb_pos int", lambda lines: [(k,) for k, inside in enumerate(units.interiors(lines)) if inside])


# Node types of public grammars and the kind of statement they are.
KINDS = {
    "binding": ("lexical_declaration", "variable_declaration", "local_variable_declaration", "let_declaration", "const_declaration", "variable_declarator", "public_field_definition", "field_declaration"),
    "assignment": ("assignment", "augmented_assignment", "assignment_expression", "augmented_assignment_expression", "compound_assignment_expr", "assignment_statement", "update_expression"),
    "call": ("call_expression", "call", "method_invocation", "macro_invocation", "builtin_function"),
    "conditional": ("if_statement", "if_expression", "switch_statement", "switch_expression", "match_expression"),
    "loop": ("for_statement", "for_expression", "while_statement", "while_expression", "loop_expression", "enhanced_for_statement", "do_statement"),
    "result": ("return_statement", "return_expression", "yield_statement", "yield_expression", "tuple_expression"),
    "transfer": ("break_statement", "break_expression", "continue_statement", "continue_expression", "throw_statement", "raise_statement", "try_statement", "defer_statement"),
    "import": ("import_statement", "import_declaration", "import_from_statement", "use_declaration", "package_declaration"),
}
_NODES = [n for names in KINDS.values() for n in names] + ["class_declaration", "method_definition", "function_item", "comment"]
_KIND_CASES = " ".join(f"WHEN t IN {names} THEN '{kind}'" for kind, names in KINDS.items())


@query("cor10_statement_kinds", f"SELECT DISTINCT t AS node_type, CASE {_KIND_CASES} WHEN suffix(t, 'declaration') OR suffix(t, 'definition') OR suffix(t, 'item') THEN 'declaration' ELSE 'other' END AS kind FROM (SELECT unnest({_NODES}) AS t)")
def cor10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind of a statement by its node type; the types are given, as no parser of trees is at hand."""
    t = F.col("node_type")
    kind = F.when(t.endswith("declaration") | t.endswith("definition") | t.endswith("item"), "declaration").otherwise("other")
    for name, names in KINDS.items():
        kind = F.when(t.isin(*names), name).otherwise(kind)
    return spark.createDataFrame([(n,) for n in _NODES], "node_type string").distinct().select("node_type", kind.alias("kind"))


@query("scl14_markdown_escape", "SELECT DISTINCT path, regexp_replace(path, '([\\\\`*_\\[\\]<>|])', '\\\\\\1', 'g') AS escaped FROM source_files")
def scl14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "source_files").select("path").distinct().select("path", markdown_escape(F.col("path")).alias("escaped"))


@query("scl13_version_bump", "SELECT source_id, (n // 100) || '.' || (n // 10 % 10) || '.' || (n % 10) AS next_version FROM (SELECT source_id, source_id % 1000 + 1 AS n FROM corpus_sources)")
def scl13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version after one of three digits, each carrying at ten."""
    n = F.col("source_id") % 1000 + 1
    return table(spark, sf_dir, "corpus_sources").select("source_id", F.concat_ws(".", F.floor(n / 100).cast("string"), (F.floor(n / 10) % 10).cast("string"), (n % 10).cast("string")).alias("next_version"))


@query("src01_one_file")
def src01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file by its path, up to 4 MiB."""
    from ..sources.files import walk

    first = next(iter(walk(sf_dir, True)))
    return read_paths(spark, [first]).select("name", "n_bytes", F.col("content").isNotNull().alias("held"))


@query("src02_standard_input")
def src02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document from bytes, formatted by the rule."""
    from ..operators.formatting import format_documents

    return format_documents(read_text(spark, b"a();\nif (b) {\n  c();\n}\nd();\n"))


_SHOWN = "list_filter(list_transform(string_split({t}, chr(10)), lambda x: trim(x, chr(32) || chr(9) || chr(13))), lambda x: x <> '')"
_GAPPED = "array_to_string(string_split({t}, chr(10)), chr(10) || repeat(chr(10), {k}))"


@query("evl08_guards", f"WITH {DOCS}, s AS (SELECT text, {_SHOWN.format(t='text')} AS v FROM docs) SELECT count(*) AS files, count(*) FILTER ({' OR '.join(_SHOWN.format(t=_GAPPED.format(t='text', k=k)) + ' <> v' for k in range(3))}) AS changed FROM s")
def evl08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose nonblank lines differ after every gap was set to 0, 1 and 2; none may."""
    d = docs(spark, sf_dir).select(guards.per_text("text", "boolean", guards.lines_differ).alias("differs"))
    return d.agg(F.count("*").alias("files"), F.count_if("differs").alias("changed"))


@query("udf01_pluggable_scorer")
def udf01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any vectorised function of the feature column can decide; here one with the rule's labels."""
    from pyspark.sql.functions import pandas_udf

    decide = pandas_udf(_decide, "int")
    return _vectors(spark, sf_dir).groupBy(decide("input").alias("label")).agg(F.count("*").alias("n"))


def _decide(values: pd.Series) -> pd.Series:
    import numpy as np

    from ..operators.formatting import rule_labels

    return pd.Series(rule_labels(np.stack(values.to_numpy())) if len(values) else [], dtype="int32")


@query("udf05_rows_from_text", f"WITH {NONBLANK} SELECT doc_id, count(*) AS rows FROM nonblank GROUP BY doc_id")
def udf05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows made from text: a generator over the line array."""
    return layout.nonblank(docs(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("rows"))


@query("udf06_metric_state", f"WITH {BOUNDS}, p AS (SELECT least(blank_lines, 2) AS t, {RULE_SQL} AS p FROM bounds) SELECT count(*) AS n, count(*) FILTER (t = p) AS hits, count(*) FILTER (t > 0 AND t = p) AS blank_hits, count(*) FILTER (p > 0) AS predicted, count(*) FILTER (t > 0) AS wanted FROM p")
def udf06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics as a state of each file that merges with others: counters in a struct, added up field by field."""
    b = bounds(spark, sf_dir).select("doc_id", F.least("blank_lines", F.lit(2)).alias("truth"), rule().alias("prediction"))
    return metrics.merged(b.groupBy("doc_id").agg(metrics.state("truth", "prediction").alias("state")), "state")


@query("trn04_distillation")
def trn04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training against another model's probabilities, and how often the two then agree on the sample."""
    import numpy as np

    x, y, g = _sample(spark, sf_dir)
    if not len(x):
        return spark.createDataFrame([], "epoch int, agreement double")
    teacher, _ = model.train(x, y, g, epochs=3)
    soft = model.probabilities(model.forward(teacher, x))
    student, out = model.initial(9), []
    for epoch in range(5):
        for _ in range(40):
            _, grads = model.gradients(student, x, soft)
            student = {k: v - 0.5 * grads[k] for k, v in student.items()}
        same = np.mean(model.forward(student, x).argmax(1) == soft.argmax(1))
        out.append((epoch, round(float(same), 4)))
    return spark.createDataFrame(out, "epoch int, agreement double")


# --- steps of the classifier and its files, each against what defines it


@query("mod06_initial_weights")
def mod06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per layer of new weights: whether all lie within the Xavier bound, fill it, and biases are zero."""
    import numpy as np

    rows = []
    for seed in (1, 2, 3):
        m = model.initial(seed)
        for name in ("1", "2"):
            w, bound = m[f"w{name}"], np.sqrt(6 / sum(m[f"w{name}"].shape))
            rows.append((seed, name, bool((abs(w) <= bound).all()), bool(abs(w).max() > 0.9 * bound), bool((m[f"b{name}"] == 0).all())))
    return spark.createDataFrame(rows, "seed int, layer string, within boolean, filled boolean, zero_bias boolean")


@query("mod07_batched_scores")
def mod07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of all boundaries by scores in batches of 256 with a padded last one, and how many differ from unbatched ones."""
    weights = model.initial(5)
    v = _vectors(spark, sf_dir).select(model.scorer(weights)("input").alias("plain"), model.padded_scorer(weights, 256)("input").alias("padded"))
    off = F.array_max(F.transform(F.arrays_zip("plain", "padded"), lambda x: F.abs(x["plain"] - x["padded"])))
    return v.select(metrics.argmax(F.col("padded")).alias("label"), (off > 1e-9).alias("off")).groupBy("label").agg(F.count("*").alias("n"), F.count_if("off").alias("differ"))


@query("trn02_adamw_step")
def trn02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first step of the optimiser moves every weight with a gradient by the learning rate against its sign."""
    import numpy as np

    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(64, model.INPUTS)), rng.integers(0, 3, 64)
    before = model.initial(4)
    step, moments = model.adamw(before, model.gradients(before, x, np.eye(3)[y])[1], None, rate=3e-3)
    moved = {k: before[k] - step[k] for k in step}
    rows = [(k, float(np.abs(v).max()), bool((np.abs(np.abs(v[moments["v"][k] > 1e-12]) - 3e-3) < 1e-5).all())) for k, v in moved.items()]
    return spark.createDataFrame([(k, round(a, 6), ok) for k, a, ok in rows], "weights string, largest double, by_rate boolean")


@query("trn03_token_dropout")
def trn03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dropout on the channels of words: the share blanked, whether the rest is scaled up, and other channels untouched."""
    import numpy as np

    x = np.ones((2000, model.INPUTS))
    out = model.dropped(x, slice(32, 128), 0.1, np.random.default_rng(6))
    inside, rest = out[:, 32:128], np.delete(out, range(32, 128), axis=1)
    return spark.createDataFrame([(round(float((inside == 0).mean()), 2), bool(np.allclose(inside[inside != 0], 1 / 0.9)), bool((rest == 1).all()))], "blanked double, scaled boolean, rest_kept boolean")


@query("trn07_gradient_check")
def trn07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gradients against differences of the loss, on a bounded sample of boundaries."""
    import numpy as np

    x, y, _ = _sample(spark, sf_dir, 8)
    if not len(x):
        return spark.createDataFrame([], "weights string, within boolean")
    m, soft = model.initial(2), np.eye(3)[y]
    grads, rng, rows = model.gradients(m, x, soft)[1], np.random.default_rng(1), []
    for k in m:
        worst = 0.0
        for _ in range(20):
            at = tuple(int(rng.integers(n)) for n in m[k].shape)
            up, down = ({**m, k: m[k].copy()} for _ in range(2))
            up[k][at] += 1e-5
            down[k][at] -= 1e-5
            slope = (model.gradients(up, x, soft)[0] - model.gradients(down, x, soft)[0]) / 2e-5
            worst = max(worst, abs(slope - grads[k][at]))
        rows.append((k, bool(worst <= 0.002)))
    return spark.createDataFrame(rows, "weights string, within boolean")


@query("src19_weights_reader")
def src19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the reader of weights takes and refuses: a whole file, one cut short, a changed byte, another version."""
    import hashlib

    from ..sources.weights import decode, encode

    whole = encode(model.initial(3))
    other = whole[:20] + b"\x07\0\0\0" + whole[24:-32]
    rows = []
    for name, data in (("whole", whole), ("cut", whole[:-1]), ("changed", whole[:100] + bytes([whole[100] ^ 1]) + whole[101:]), ("version", other + hashlib.sha256(other).digest()), ("empty", b"")):
        try:
            rows.append((name, sorted(decode(data)) == ["b1", "b2", "w1", "w2"]))
        except ValueError:
            rows.append((name, False))
    return spark.createDataFrame(rows, "file string, taken boolean")


@query("snk07_gguf_tensors")
def snk07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tensors of an exported GGUF file as its header tells them, and whether their bytes are the weights."""
    from ..sources.exports import gguf, read_gguf

    m = model.initial(3)
    rows = [(name, "x".join(map(str, a.shape)), bool((a == m[name].astype("<f4")).all())) for name, a in read_gguf(gguf(m)).items()]
    return spark.createDataFrame(rows, "tensor string, shape string, equal boolean")


@query("snk08_onnx_parity")
def snk08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of an exported ONNX model, run by a runtime on a bounded sample, against NumPy's; no row without a runtime."""
    import numpy as np

    from ..sources.exports import onnx

    x, _, _ = _sample(spark, sf_dir, 30)
    try:
        import onnxruntime
    except ImportError:
        return spark.createDataFrame([], "label int, n long, agree long")
    m = model.initial(3)
    run = onnxruntime.InferenceSession(onnx(m), providers=["CPUExecutionProvider"]).run
    theirs = run(None, {"input": x.astype(np.float32)})[0] if len(x) else np.zeros((0, 3))
    ours = model.forward(m, x) if len(x) else theirs
    label, same = ours.argmax(1), np.abs(ours - theirs).max(axis=1, initial=0) <= 1e-4
    return spark.createDataFrame([(int(k), int((label == k).sum()), int((same & (label == k)).sum())) for k in np.unique(label)], "label int, n long, agree long")


@query("udf04_command_line")
def udf04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exit codes of the command line over the golden inputs, in a folder of the driver: check, write, check, a missing
    file (snk01 and snk02 are its outputs)."""
    import contextlib
    import io
    import os
    import tempfile

    from ..cli import main

    g = table(spark, sf_dir, "golden_pairs").where("input_text IS NOT NULL AND instr(replace(input_text, '\r\n', ''), '\r') = 0").select("case_id", "ext", "input_text")
    rows = []
    with tempfile.TemporaryDirectory() as folder, contextlib.redirect_stdout(io.StringIO()), contextlib.redirect_stderr(io.StringIO()):
        for r in g.toLocalIterator():
            with open(os.path.join(folder, f"{r.case_id}.{r.ext}"), "wb") as f:
                f.write(r.input_text.encode())
        for step, args in (("check", ["--check"]), ("write", ["--write"]), ("check again", ["--check"])):
            rows.append((step, main(["-p", folder, *args])))
        os.symlink(os.path.join(folder, "nothing"), os.path.join(folder, "gone.py"))
        rows.append(("missing", main(["-p", folder, "--check"])))
    return spark.createDataFrame(rows, "step string, exit_code int")
