"""Texts whose nesting no regular expression bounds, rewritten in Catalyst to texts that one can cut.

The expressions of ``lexis`` match literals, comments, generic clauses and groups to a fixed depth and leave a mark where that isn't enough
(``is_suspect``). Such a text is read again by an automaton with a stack: its delimiters are found by one flat expression, and ``aggregate`` folds
them with a state of mode, group depth and a stack of what is open. The inside of comments and literals becomes blanks, and so do groups
deeper than two, but for what stands in braces; a literal leaves ``0``. Generic clauses are blanked after that, many levels at a time. Newlines keep
their number and kind, so counts of lines are those of the original.

What is whole and holds nothing to decide, comments to a depth of 64 and literals without interpolation, is emptied by one expression before the
fold, which then has their ends only; the rest of the text from the first place where that isn't certain is left to the fold.

Nothing recurses: an interpolation or brace is a frame of fixed width on a string. The fold runs in blocks of delimiters, so pieces of
output are joined once for each block, and a text of any length costs time in proportion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typeaudit.operators import lexis

_NEWLINES = r"\n\r\x0B\f\x85\u2028\u2029"
#: Groups up to this depth stay.
_KEPT_DEPTH = 2
#: Delimiters folded before their output is put aside.
_BLOCK = 256

# A delimiter with the plain run before it: run, opener of a regular expression, any other delimiter.
_DELIMITER = (
    r'//|/\*|\*/|\\#*+\(|\\"""#++|\\"#*+|\\[\\/]|#*+"""#*+|#*+"#*+'
    rf"|{lexis._EXTENDED_REGEX}|/#++|[\s\S]|\z"
)
_TOKEN = rf'([^"/*\\#\n\r(){{}}\[\]]*+)(?:({lexis.REGEX_OPENER})|({_DELIMITER}))'

# Stand-ins for LF and CR inside of what was emptied, where no newline ends anything, and for these code points where a text has them.
_HELD, _TAKEN = "\ufdd0\ufdd1", "\ufdd2\ufdd3"
_KEPT = rf"{_NEWLINES}\ufdd0\ufdd1"
_COMMENT_DEPTH = 64


def _whole_comment(depth: int) -> str:
    """A closed comment without marks that the delimiters above read in another way."""
    inner = "" if depth == 0 else f"|{_whole_comment(depth - 1)}"
    return rf"/\*(?:[^*/\\#]++|\*(?!/)|/++(?!\*)|\\(?![\\/])|#(?!#*+/){inner})*+\*/"


_ESCAPE = r'\\(?![#("\\/])'
_WHOLE = (
    rf'\G(?:[^"/*\\#]++|\*/|\*(?!/)|//[^\n\r]*+|{_whole_comment(_COMMENT_DEPTH)}'
    rf'|(#*+)"""(?:[^"\\]++|"{{1,2}}+(?!")|{_ESCAPE})*+"""\1#*+|(#*+)"(?!"")(?:[^"\\\n\r]++|{_ESCAPE})*+"\2#*+(?!")'
    r'|#(?!#*+["/]))'
)

# A generic clause of up to so many levels, what lies between, and the innermost kind.
_LEVELS = 30
_CLAUSE = rf"(?<=[\w`])<{lexis._generic(_LEVELS)}>"
_PIECE = rf"{_CLAUSE}|[^<]++|<"
_INNERMOST = rf"(?<=[\w`])<{lexis._generic(0)}>"


def is_suspect(elements: Column) -> Column:
    """Does any element of a text begin with what the expressions left unmatched?"""
    return F.exists(elements, lambda e: e.rlike(lexis.SUSPECT))


def _blank(text: Column) -> Column:
    return F.regexp_replace(text, f"[^{_NEWLINES}]", " ")


def _emptied(piece: Column) -> Column:
    """A match of ``_WHOLE`` with nothing but newlines inside, if it is a comment or literal."""
    held = F.translate(F.regexp_replace(piece, f"[^{_NEWLINES}]++", ""), "\n\r", _HELD)
    lead, trail = F.regexp_extract(piece, "^#*", 0), F.regexp_extract(piece, "#*$", 0)
    literal = lambda quotes: F.concat(lead, F.lit(f"{quotes} "), held, F.lit(quotes), trail)
    return (
        F.when(piece.startswith("//"), F.concat(F.lit("// "), held))
        .when(piece.startswith("/*"), F.concat(F.lit("/* "), held, F.lit("*/")))
        .when(piece.rlike('^#*"""'), literal('"""'))
        .when(piece.rlike('^#*"'), literal('"'))
        .otherwise(piece)
    )


# --- the automaton -----------------------------------------------------------------------
#
# Modes: c code, s literal of one line, m of several, l line comment, b block comment, r regular expression, x extended one.
# A frame is a kind ({ brace, else the mode of the literal around an interpolation), its marks and the group depth around it.

_START = "struct('c' AS mode, 0 AS marks, 0 AS depth, 0 AS level, 0 AS inner, '' AS stack)"
_FRAME = 13


def _action(state: str, token: str) -> str:
    """What a delimiter does, by name."""
    d, mode, marks = f"{token}.d", f"{state}.mode", f"{state}.marks"
    behind = f"length(regexp_extract({d}, '#*$', 0))"
    hashes = f"length({d}) - length(replace({d}, '#', ''))"
    top = f"substring({state}.stack, -{_FRAME}, 1)"
    in_code = f"""CASE WHEN {token}.r <> '' THEN 'regex' WHEN {d} = '//' THEN 'line' WHEN {d} = '/*' THEN 'block'
        WHEN {d} RLIKE '^#*"' THEN 'literal' WHEN {d} RLIKE '^#+/$' THEN 'extended'
        WHEN {d} IN ('(', '[') OR {d} RLIKE '^.#*[(]$' THEN 'open'
        WHEN {d} = ')' AND {state}.depth = 0 AND {top} IN ('s', 'm') THEN 'back'
        WHEN {d} IN (')', ']') THEN 'close' WHEN {d} = '{{' THEN 'brace' WHEN {d} = '}}' THEN 'unbrace' ELSE '' END"""
    quoted = f"""CASE WHEN {d} RLIKE '[(]$' AND startswith({d}, '\\\\') THEN if({hashes} = {marks}, 'into', '')
        WHEN startswith({d}, '\\\\') AND ({marks} = 0 OR NOT contains({d}, '"')) THEN ''
        WHEN {mode} = 's' THEN if(({d} IN ('\\n', '\\r')) OR (contains({d}, '"') AND {behind} >= {marks}), 'end', '')
        ELSE if(contains({d}, '\"\"\"') AND {behind} >= {marks}, 'end', '') END"""
    return f"""CASE {mode} WHEN 'c' THEN {in_code} WHEN 'l' THEN if({d} IN ('\\n', '\\r'), 'end', '')
        WHEN 'b' THEN CASE {d} WHEN '/*' THEN 'more' WHEN '*/' THEN if({state}.level = 1, 'end', 'less') ELSE '' END
        WHEN 'r' THEN if(({d} IN ('\\n', '\\r')) OR {token}.r <> '' OR (contains({d}, '/') AND NOT startswith({d}, '\\\\')), 'end', '')
        WHEN 'x' THEN if({d} RLIKE '^/#+$' AND {behind} >= {marks}, 'end', '') ELSE {quoted} END"""


def _step() -> str:
    """The fold's function: state and token to state, with the token's output appended."""
    s, t = "bound.s", "bound.t"
    depth, stack = f"{s}.depth", f"{s}.stack"
    saved = f"CAST(substring({stack}, -9, 9) AS INT)"
    top = f"substring({stack}, -{_FRAME}, 1)"
    popped = f"substring({stack}, 1, length({stack}) - {_FRAME})"
    in_frame = f"lpad(CAST({depth} AS STRING), 9, '0')"
    is_brace = f"({top} = '{{')"
    shown = f"({s}.mode = 'c' AND {s}.inner = 0)"
    blank = "regexp_replace({0}, '[^" + _KEPT.replace("\\", "\\\\") + "]', ' ')"
    opened = f"length(regexp_extract({t}.d, '^#*', 0))"
    run = f"if({shown} AND {depth} <= {_KEPT_DEPTH}, {t}.run, {blank.format(f'{t}.run')})"
    mark = f"""CASE WHEN {t}.d IN ('\\n', '\\r') THEN {t}.d WHEN NOT {shown} THEN '  '
        WHEN a IN ('brace', 'unbrace') THEN {t}.d WHEN a IN ('line', 'block') OR startswith({t}.d, '\\\\') THEN ' '
        WHEN {depth} > {_KEPT_DEPTH} OR (a = 'open' AND {depth} = {_KEPT_DEPTH}) THEN ' '
        WHEN a IN ('literal', 'regex', 'extended') THEN ' 0 ' ELSE {t}.d END"""
    fields = {
        "mode": f"""CASE a WHEN 'literal' THEN if(contains({t}.d, '\"\"\"'), 'm', 's') WHEN 'line' THEN 'l' WHEN 'block' THEN 'b'
            WHEN 'regex' THEN 'r' WHEN 'extended' THEN 'x' WHEN 'end' THEN 'c' WHEN 'into' THEN 'c' WHEN 'back' THEN {top}
            ELSE {s}.mode END""",
        "marks": f"""CASE a WHEN 'literal' THEN {opened} WHEN 'extended' THEN length({t}.d) - 1
            WHEN 'back' THEN CAST(substring({stack}, -{_FRAME - 1}, 3) AS INT) ELSE {s}.marks END""",
        "depth": f"""CASE a WHEN 'open' THEN {depth} + 1 WHEN 'close' THEN greatest({depth} - 1, 0) WHEN 'into' THEN 0 WHEN 'brace' THEN 0
            WHEN 'back' THEN {saved} WHEN 'unbrace' THEN if({is_brace}, {saved}, {depth}) ELSE {depth} END""",
        "level": f"CASE a WHEN 'block' THEN 1 WHEN 'more' THEN {s}.level + 1 WHEN 'less' THEN {s}.level - 1 ELSE {s}.level END",
        "inner": f"CASE a WHEN 'into' THEN {s}.inner + 1 WHEN 'back' THEN {s}.inner - 1 ELSE {s}.inner END",
        "stack": f"""CASE a WHEN 'into' THEN concat({stack}, {s}.mode, lpad(CAST(least({s}.marks, 999) AS STRING), 3, '0'), {in_frame})
            WHEN 'brace' THEN concat({stack}, '{{000', {in_frame}) WHEN 'back' THEN {popped}
            WHEN 'unbrace' THEN if({is_brace}, {popped}, {stack}) ELSE {stack} END""",
    }
    state = "named_struct(" + ", ".join(f"'{name}', {value}" for name, value in fields.items()) + ")"
    result = f"named_struct('s', {state}, 'out', concat(acc.out, {run}, {mark}))"
    bound = f"transform(array(named_struct('s', acc.s, 't', token)), bound -> transform(array({_action(s, t)}), a -> {result})[0])[0]"
    return f"(acc, token) -> {bound}"


_FOLD = f"""aggregate(
    sequence(0, CAST((size(delimiters) - 1) / {_BLOCK} AS INT)),
    named_struct('s', {_START}, 'parts', CAST(array() AS ARRAY<STRING>)),
    (outer, i) -> transform(
        array(aggregate(slice(delimiters, i * {_BLOCK} + 1, {_BLOCK}), named_struct('s', outer.s, 'out', ''), {_step()})),
        block -> named_struct('s', block.s, 'parts', concat(outer.parts, array(block.out))))[0],
    done -> array_join(done.parts, ''))"""


def _without_generics(code: Column) -> Column:
    """Blanks for generic clauses, ``_LEVELS`` levels at a time until none is left."""

    def once(text: Column) -> Column:
        pieces = F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0))
        blanked = F.transform(pieces, lambda p: F.when(p.startswith("<") & (F.length(p) > 1), _blank(p)).otherwise(p))
        return F.when(text.rlike(_INNERMOST), F.array_join(blanked, "")).otherwise(text)

    opened = F.length(code) - F.length(F.replace(code, F.lit("<"), F.lit("")))
    return F.aggregate(F.sequence(F.lit(0), F.floor(opened / (_LEVELS + 1))), code, lambda text, _: once(text))


def rewritten(sources: DataFrame, text: str = "text", when: Column | None = None) -> DataFrame:
    """``sources`` with a regular ``code`` for each text for which ``when`` holds, null for the others.

    ``code`` has blanks for comments and deep groups, ``0`` for literals and no generic clauses.
    """
    chosen = F.col(text) if when is None else F.when(when, F.col(text))
    taken = F.col(text).rlike(f"[{_HELD}]")
    found = sources.withColumn("chosen", F.when(taken, F.translate(chosen, _HELD, _TAKEN)).otherwise(chosen))
    found = found.withColumn("whole", F.regexp_extract_all("chosen", F.lit(_WHOLE), F.lit(0)))
    found = found.withColumn("begun", F.length(F.array_join("whole", "")))
    rest = F.expr("substring(chosen, begun + 1)")
    emptied = F.concat(F.array_join(F.transform("whole", _emptied), ""), rest)
    found = found.withColumn("chosen", emptied).drop("whole", "begun")
    run, opener, delimiter = (F.regexp_extract_all("chosen", F.lit(_TOKEN), F.lit(k)) for k in (1, 2, 3))
    found = found.withColumn("delimiters", F.arrays_zip(run.alias("run"), opener.alias("r"), delimiter.alias("d")))
    found = found.withColumn("code", F.expr(_FOLD)).drop("delimiters", "chosen")
    found = found.withColumn("code", F.translate("code", _HELD, "\n\r"))
    found = found.withColumn("code", F.when(taken, F.translate("code", _TAKEN, _HELD)).otherwise(F.col("code")))
    return found.withColumn("code", _without_generics(F.col("code")))
