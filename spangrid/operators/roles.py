"""Surface role of a line: what its first tokens and its operators show, without a parser."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexing import TOKEN

ROLES = ("other", "binding", "assignment", "call", "control", "exit", "opening", "closing")
# The words that decide a role on their own.
EXIT = ("return", "throw", "break", "continue", "yield")
CONTROL = ("if", "else", "elif", "unless", "guard", "for", "foreach", "while", "switch", "match", "try", "catch", "finally", "do", "lock")
BINDING = ("const", "let", "var", "val", "final", "def", "fn", "function", "class", "struct", "interface", "enum", "type")
NEUTRAL = ("import", "using", "package", "namespace")


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once, as a lambda's variable; Spark computes a repeated expression anew."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


_WORDS = r"^[0-9A-Za-z_\x{80}-\x{10FFFF}]+$"
_RUN = r"[0-9A-Za-z_\x{80}-\x{10FFFF}]"
#: Generic arguments inside one another that are taken out one level a time; a line with more is folded token by token.
LEVELS = 6


def shape(text: Column) -> Column:
    """One character a token, without white space: w a word, n a number, _ generic arguments."""
    out = F.regexp_replace(text, rf"[0-9]*[A-Za-z_\x{{80}}-\x{{10FFFF}}]{_RUN}*", "w")
    out = F.regexp_replace(F.regexp_replace(out, "[0-9]+", "n"), r"[ \t\x0B\f\r\n]+", "")
    for _ in range(LEVELS):
        out = F.regexp_replace(out, "<[^<>]*>", "_")
    return out


def _step(s: Column, x: Column) -> Column:
    t = x["t"]
    is_word = x["w"]
    depth = s["depth"] + F.when(t == "<", 1).otherwise(0) - F.when((t == ">") & (s["depth"] > 0), 1).otherwise(0)
    flat = depth == 0
    member = F.when(flat & (t == "."), True).when(flat & is_word & (s["previous"] != "."), False).otherwise(s["member"])
    at_equals = (
        F.when(x["n"].isin("=", ">") | s["previous"].isin("=", "!", "<", ">"), "other")
        .when((s["previous"] == ":") | ((s["words"] >= 2) & ~s["member"] & ~s["subscript"]), "binding")
        .otherwise("assignment")
    )
    decided = F.when(s["role"] != "", s["role"]).when(t == "=", at_equals).when(flat & (t == "("), "call").otherwise("")
    return F.struct(
        decided.alias("role"),
        (s["words"] + F.when(flat & is_word, 1).otherwise(0)).alias("words"),
        depth.alias("depth"),
        member.alias("member"),
        (s["subscript"] | (flat & (t == "["))).alias("subscript"),
        t.alias("previous"),
    )


def _scan(value: Column, first: Column, rest: Column) -> Column:
    """What the operators after the first token decide: a fold with a small state."""
    pairs = F.zip_with(rest, F.slice(rest, 2, F.greatest(F.size(rest) - 1, F.lit(0))), lambda t, n: F.struct(t.alias("t"), F.coalesce(n, F.lit("")).alias("n"), (t.rlike(_WORDS) & ~t.rlike("^[0-9]+$")).alias("w")))
    items = F.filter(pairs, lambda x: ~x["t"].rlike(r"^[ \t\x0B\f]+$"))
    start = F.struct(F.lit("").alias("role"), F.lit(1).alias("words"), F.lit(0).alias("depth"), F.lit(False).alias("member"), F.lit(False).alias("subscript"), first.alias("previous"))

    def tail(s: Column) -> Column:
        bare = (s["words"] >= 2) & ~s["member"] & ~s["subscript"] & value.endswith(";")
        return F.when(s["role"] != "", s["role"]).when(bare, "binding").when(s["member"], "call").otherwise("other")

    return F.aggregate(items, start, _step, tail)


def _by_shape(value: Column, first: Column, rest: Column) -> Column:
    """What the operators after the first token decide, by the shape of what stands before the first equals sign."""
    equals = F.instr(rest, "=")
    left = F.when(equals > 0, F.substring(rest, F.lit(1), equals - 1)).otherwise(rest)

    def decide(seen: Column) -> Column:
        # open generic arguments hide the rest
        flat = F.regexp_replace(seen, "<.*$", "")
        declares = flat.contains("w") & ~flat.rlike(r"\.w?[^w]*$") & ~flat.contains("[")
        before, after = F.regexp_extract(left, r"([^ \t\x0B\f])[ \t\x0B\f]*$", 1), F.substring(rest, equals + 1, F.lit(1))
        at_equals = F.when(before.isin("!", "<", ">") | after.isin("=", ">"), "other").when(declares | (before == ":"), "binding").otherwise("assignment")
        at_end = F.when(declares & value.endswith(";"), "binding").when(flat.rlike(r"\.w?[^w]*$"), "call").otherwise("other")
        by_shape = F.when(flat.contains("("), "call").when(equals > 0, at_equals).otherwise(at_end)
        return F.when(seen.rlike("<[^<>]*>"), _folded(value, first, rest)).otherwise(by_shape)

    return _let(shape(left), decide)


def _folded(value: Column, first: Column, rest: Column) -> Column:
    return _scan(value, first, F.regexp_extract_all(rest, F.lit(TOKEN), F.lit(0)))


def role(value: Column) -> Column:
    """One of ROLES for a trimmed line."""
    line = F.regexp_replace(value, "^@", "")
    first = F.regexp_extract(line, rf"^({_RUN}+|(?s:.)|)", 1)

    def by_first(first: Column) -> Column:
        return (
            F.when((first == ""), "other")
            .when(first.isin("}", ")", "]") | value.isin("end", "end;"), "closing")
            .when(first == "{", "opening")
            .when(~first.rlike(_WORDS) | first.rlike("^[0-9]+$"), "other")
            .when(first.isin(*EXIT), "exit")
            .when(first.isin(*CONTROL), "control")
            .when(first.isin(*BINDING), "binding")
            .when(first.isin(*NEUTRAL), "other")
            .otherwise(_let(F.substring(line, F.length(first) + 1, F.length(line)), lambda rest: _by_shape(value, first, rest)))
        )

    return _let(first, by_first)


def _role_sql() -> str:
    """The same over a column `value`, in SQL: twelve levels of generic arguments."""
    shaped = "regexp_replace(regexp_replace(regexp_replace(lhs, '[0-9]*[A-Za-z_\\x{80}-\\x{10FFFF}][0-9A-Za-z_\\x{80}-\\x{10FFFF}]*', 'w', 'g'), '[0-9]+', 'n', 'g'), '[ \\t\\x0B\\f\\r\\n]+', '', 'g')"
    for _ in range(12):
        shaped = f"regexp_replace({shaped}, '<[^<>]*>', '_', 'g')"
    return f"""heads AS (SELECT *, regexp_extract(regexp_replace(value, '^@', ''), '^([0-9A-Za-z_\\x{{80}}-\\x{{10FFFF}}]+|.|)', 1) AS head, regexp_replace(value, '^@', '') AS line FROM nonblank),
rests AS (SELECT *, substr(line, length(head) + 1) AS rest, strpos(substr(line, length(head) + 1), '=') AS eq FROM heads),
sides AS (SELECT *, CASE WHEN eq > 0 THEN substr(rest, 1, eq - 1) ELSE rest END AS lhs FROM rests),
shapes AS (SELECT *, regexp_replace({shaped}, '<.*$', '') AS flat, regexp_extract(lhs, '([^ \\t\\x0B\\f])[ \\t\\x0B\\f]*$', 1) AS before, substr(rest, eq + 1, 1) AS after FROM sides),
facts AS (SELECT *, regexp_matches(flat, '\\.w?[^w]*$') AS member, contains(flat, 'w') AND NOT regexp_matches(flat, '\\.w?[^w]*$') AND NOT contains(flat, '[') AS declares FROM shapes),
roles AS (SELECT *, CASE WHEN head = '' THEN 'other' WHEN head IN ('}}', ')', ']') OR value IN ('end', 'end;') THEN 'closing' WHEN head = '{{' THEN 'opening'
 WHEN NOT regexp_full_match(head, '[0-9A-Za-z_\\x{{80}}-\\x{{10FFFF}}]+') OR regexp_full_match(head, '[0-9]+') THEN 'other'
 WHEN head IN {EXIT} THEN 'exit' WHEN head IN {CONTROL} THEN 'control' WHEN head IN {BINDING} THEN 'binding' WHEN head IN {NEUTRAL} THEN 'other'
 WHEN contains(flat, '(') THEN 'call' WHEN eq > 0 THEN CASE WHEN before IN ('!', '<', '>') OR after IN ('=', '>') THEN 'other' WHEN declares OR before = ':' THEN 'binding' ELSE 'assignment' END
 WHEN declares AND suffix(value, ';') THEN 'binding' WHEN member THEN 'call' ELSE 'other' END AS role FROM facts)"""


ROLE_SQL = _role_sql().replace("\\\\", "\\")
