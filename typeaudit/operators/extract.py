"""Source text to ``types`` and ``members``.

A file is cut where it was read; only its elements (kind, keyword, name, counters, no text) are hashed by
(project, path), so the extraction has a single exchange, whose partitions the planner sizes. Windows order by
position and keep only running frames, so each costs one pass over its (spillable) sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typeaudit import schema
from typeaudit.functions import text as tx
from typeaudit.operators import lexis, nesting
from typeaudit.operators.classify import category

_TYPE_WORDS = ("class", "struct")
_PROPERTY_WORDS = ("var", "let")
_FILE = schema.FILE_KEY
_BLOCK = [*_FILE, "block"]
#: Block of the row that stands for the file itself.
NO_BLOCK = -1


def _quoted(words) -> str:
    return ", ".join(f"'{word}'" for word in words)


_COMMENT_FIRST = r"^(?:/[/*]|[^\x00-\x7F]|[\x0B\f])"


def _breaks(column: str):
    """Newline scalars in ``column``; the kind of newlines is looked up once per file."""
    return F.when(F.col("only_lf"), tx.lf_count(F.col(column))).otherwise(tx.newline_count(F.col(column)))


def _cut(sources: DataFrame, partitions: int | None, expression: str, head_lines: int | None) -> DataFrame:
    """The elements of readable files; dealt out anew only where ``partitions`` is given, for sources
    that lie in too few partitions to begin with.

    A text that nests beyond the expression is rewritten and cut again. With ``head_lines`` what is to be known of the
    file itself rides along as ``carried``, and an unreadable file has an element as well.
    """
    if head_lines is None:
        files = sources.where(F.col("text").isNotNull()).select(*_FILE, "text")
    else:
        head = tx.head_lines(F.col("text"), head_lines) if head_lines else F.lit(None).cast("string")
        carried = F.struct("file_name", "read_error", head.alias("snippet")).alias("carried")
        files = sources.select(*_FILE, F.coalesce("text", F.lit("")).alias("text"), carried)
    extra = [] if head_lines is None else ["carried"]
    if partitions:
        files = files.repartition(partitions, *_FILE)
    # What a row needs of its text is taken before there are rows of elements.
    files = files.withColumn("only_lf", ~F.col("text").rlike(tx.RARE_NEWLINES))
    files = files.withColumn("elements", F.regexp_extract_all("text", F.lit(expression), F.lit(0)))
    files = files.withColumn("suspect", nesting.is_suspect(F.col("elements")))
    again = nesting.rewritten(files, "text", F.col("suspect"))
    elements = F.coalesce(F.regexp_extract_all("code", F.lit(expression), F.lit(0)), F.col("elements"))
    cut = again.select(*_FILE, *extra, "only_lf", elements.alias("elements"))
    # Every text has an element; the outer form keeps the planner from testing that by cutting twice.
    return cut.select(*_FILE, *extra, "only_lf", F.posexplode_outer("elements").alias("pos", "element"))


def tokens(
    sources: DataFrame, partitions: int | None = None, outline: bool = False, head_lines: int | None = None
) -> DataFrame:
    """Structural elements of every readable file, with running line and nesting counters.

    With ``outline`` the bodies of functions, and other braced groups that can hold no member of a
    type, stay within the element before them: a method is then one row. With ``head_lines`` the last
    element of every file, unreadable ones included, has the file's own columns as ``carried``.

    ``line_from`` and ``line_to`` are newline counts before the first and after the last
    character of the element proper, ``line_before`` the one at the end of the previous element.
    """
    cut = _cut(sources, partitions, lexis.OUTLINE if outline else lexis.ELEMENT, head_lines)
    extra = [] if head_lines is None else ["carried"]
    # Blanks are trimmed natively; only a comment or a rare blank in front needs the expression.
    trimmed = F.ltrim("element", F.lit(" \n\t\r"))
    headed = cut.withColumn(
        "head",
        F.when(trimmed.rlike(_COMMENT_FIRST), F.regexp_replace("element", lexis.LEADING, "")).otherwise(trimmed),
    ).withColumn("first", F.expr("substring(head, 1, 1)"))
    # Every keyword, modifier and attribute starts with one of these.
    parts = F.when(
        F.expr("first BETWEEN 'a' AND 'z' OR first = '@'"),
        F.regexp_replace("head", lexis.DECLARATION_PARTS, lexis.DECLARATION_REWRITE),
    )
    # Keyword, name and '='; a head that was not rewritten has no parts.
    parted = headed.withColumn("parts", F.split(parts, lexis.SEPARATOR, 3)).withColumn(
        "is_decl", F.expr(f"coalesce(size(parts) = 3 AND parts[0] IN ({_quoted(lexis.KEYWORDS)}), false)")
    )
    named = parted.select(
        *_FILE,
        "pos",
        _breaks("element").alias("breaks"),
        _breaks("head").alias("breaks_inside"),
        F.expr("""CASE WHEN is_decl THEN 'decl' WHEN first IN ('{', '}', ',') THEN first
            WHEN first IN ('(', '[') THEN '(' WHEN first IN (')', ']') THEN ')'
            WHEN first = '#' THEN regexp_extract(head, '^#[a-zA-Z]+', 0) WHEN first = '' THEN 'end' ELSE '' END AS kind"""),
        F.expr("CASE WHEN is_decl THEN parts[0] END AS keyword"),
        F.expr("CASE WHEN is_decl THEN nullif(parts[1], '') END AS name"),
        # Only members without a name of their own go by their first token.
        F.expr("""CASE WHEN is_decl AND parts[0] IN ('func', 'var', 'let', 'init', 'subscript') THEN NULL
            WHEN first = '@' THEN '@'
            WHEN is_decl OR first = '#' THEN regexp_extract(head, '^#?[a-zA-Z_]+', 0) END AS first_token"""),
        F.when(F.expr("first = '{' AND length(head) > 1"), F.col("head").rlike(lexis.ACCESSOR_BRACE))
        .otherwise(False)
        .alias("opens_accessor"),
        # An initial value: '=' after the declared name, or anywhere in a plain element.
        F.expr("contains(CASE WHEN is_decl THEN parts[2] ELSE head END, '=') AS has_value"),
        *[F.when(F.col("first") == "", F.col(name)).alias(name) for name in extra],
    )
    so_far = "OVER (PARTITION BY project, path ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    counted = named.selectExpr(
        "*",
        f"sum(breaks) {so_far} AS line_to",
        *[
            f"sum(CASE kind WHEN '{up}' THEN 1 WHEN '{down}' THEN -1 ELSE 0 END) {so_far} AS {nesting}"
            for nesting, up, down in (("braces", "{", "}"), ("parens", "(", ")"), ("conditionals", "#if", "#endif"))
        ],
    )
    return counted.selectExpr(
        *_FILE, "pos", "kind", "keyword", "name", "first_token", "opens_accessor", "has_value", "line_to",
        "braces", "parens", "conditionals", "line_to - breaks_inside AS line_from", "line_to - breaks AS line_before", *extra,
    )


def _blocks(token_rows: DataFrame) -> DataFrame:
    """Rows that lie directly in the body of a class or struct, keyed by the body's ``block``.

    ``role``: ``open`` and ``close`` of the body, ``member`` start, ``comma``, ``accessor``, and ``end`` for the end of a file
    inside the body. Where the tokens carry their file's columns, each file has a row ``file`` in a block of its own, ``NO_BLOCK``.
    """
    extra = [name for name in token_rows.columns if name == "carried"]
    files = ", array_repeat('file', if(before <=> 'end', 0, 1))" if extra else ""
    structural = "kind IN ('decl', '{', '}', ',', 'end', '#if', '#warning', '#error', '#sourceLocation')"
    by_pos = "PARTITION BY project, path ORDER BY pos"
    marked = token_rows.where(f"{structural} OR has_value").selectExpr(
        "*",
        # A brace opens a type body if the last declaration or brace before it declares a type.
        f"""last(CASE WHEN kind IN ('decl', '{{', '}}')
              THEN struct(keyword, name, line_from AS line, pos AS decl_pos) END, true)
            OVER ({by_pos} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS owner""",
        f"lag(CASE WHEN has_value THEN '=' WHEN kind = 'decl' THEN keyword ELSE kind END) OVER ({by_pos}) AS before",
        # A brace may close before any opens.
        f"least(0, min(braces) OVER ({by_pos} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS lowest",
    )
    # A brace right after a declared name (or its type) or a binding comma is an accessor block;
    # after an initial value it is one only if an accessor keyword follows. The brace itself
    # belongs to the block it opens; as an accessor it belongs to the block around it. The end of the
    # file ends every block that is open, the outermost first.
    roles = marked.where(structural).selectExpr(
        "*",
        f"""posexplode(CASE
             WHEN kind = '{{' AND (opens_accessor OR before IN ('var', 'let', ',')) THEN array('open', 'accessor')
             WHEN kind = '{{' THEN array('open') WHEN kind = '}}' THEN array('close')
             WHEN kind = 'end' THEN concat(array_repeat('end', if(before = 'end', 0, CAST(braces - lowest AS INT))){files})
             WHEN kind = ',' THEN array('comma') ELSE array('member') END) AS (nth, role)""",
    )
    leveled = roles.selectExpr(
        *_FILE, "pos", "role", "owner", "keyword", "name", "first_token", "line_before", "parens", *extra,
        "if(role = 'end', line_before, line_from) AS line_from",
        "CASE role WHEN 'file' THEN NULL WHEN 'end' THEN lowest + nth + 1 WHEN 'close' THEN braces + 1 WHEN 'accessor' THEN braces - 1 ELSE braces END AS level",
        # The directive that opens a conditional group stands outside of it.
        "conditionals - CASE kind WHEN '#if' THEN 1 ELSE 0 END AS conditionals",
    )
    inside = leveled.selectExpr(
        "*",
        f"""last(CASE WHEN role = 'open' THEN struct(
                pos AS block, coalesce(owner.keyword IN ({_quoted(_TYPE_WORDS)}), false) AS is_type, parens, conditionals) END, true)
            OVER (PARTITION BY project, path, level ORDER BY pos
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS around""",
    )
    direct = "parens = around.parens AND conditionals = around.conditionals"
    held = f"around.is_type AND (role IN ('open', 'close', 'end') OR ({direct}))"
    return inside.where(f"role = 'file' OR ({held})" if extra else held).selectExpr(
        *_FILE, "pos", f"if(role = 'file', {NO_BLOCK}, around.block) AS block", "role", "owner", "keyword", "name", "first_token",
        "line_from", "line_before", *[f"if(role = 'file', {name}, NULL) AS {name}" for name in extra],
    )


def _member_rows(block_rows: DataFrame) -> DataFrame:
    """The opening brace, the members and the closing brace of each body, in order.

    What lies between two of them is the difference of running counts, so all windows share one
    sort and nothing is grouped.
    """
    by_pos = "PARTITION BY project, path, block ORDER BY pos"
    so_far = f"OVER ({by_pos} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    extra = [name for name in block_rows.columns if name == "carried"]
    counted = block_rows.selectExpr(
        *_BLOCK, "pos", "role", "owner", "keyword", "name", "first_token", "line_from", "line_before", *extra,
        f"sum(CASE role WHEN 'member' THEN 1 ELSE 0 END) {so_far} AS member_ord",
        f"sum(CASE role WHEN 'comma' THEN 1 ELSE 0 END) {so_far} AS commas",
        f"sum(CASE role WHEN 'accessor' THEN 1 ELSE 0 END) {so_far} AS accessors",
    )
    reaching = counted.where("role IN ('open', 'member', 'close', 'end', 'file')").selectExpr(
        "*",
        f"lead(line_before) OVER ({by_pos}) - line_from + 1 AS reach",
        f"lead(commas) OVER ({by_pos}) - commas AS own_commas",
        f"lead(accessors) OVER ({by_pos}) - accessors AS own_accessors",
    )
    measured = reaching.selectExpr("*", "CASE WHEN role = 'member' THEN reach END AS lines").selectExpr(
        "*", f"coalesce(sum(lines) OVER ({by_pos} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier"
    )
    is_property = f"keyword IN ({_quoted(_PROPERTY_WORDS)})"
    return measured.selectExpr(
        *_BLOCK, "member_ord", "owner", "role", "line_from", "keyword", *extra,
        """CASE WHEN keyword IN ('func', 'var', 'let') THEN name
             WHEN keyword IN ('init', 'subscript') THEN keyword ELSE first_token END AS member_name""",
        "CAST(earlier + 1 AS INT) AS start_line",
        "CAST(greatest(earlier + 1, earlier + lines) AS INT) AS end_line",
        f"CASE WHEN role = 'member' AND {is_property} THEN 1 + own_commas ELSE 0 END AS bindings",
        f"CASE WHEN role = 'member' AND {is_property} THEN own_accessors ELSE 0 END AS accessors",
    )


def _type_rows(member_rows: DataFrame, close: bool = True) -> DataFrame:
    """One grouped aggregate per type body; a body without members still has its two braces.

    Unless ``close``, a body that the file ends has no line count.
    """
    ends = "('close', 'end')" if close else "('close')"
    extra = [name for name in member_rows.columns if name == "carried"]
    grouped = member_rows.groupBy(*_BLOCK).agg(
        F.expr("max(CASE WHEN role = 'open' THEN owner END) AS owner"),
        F.expr(f"max(CASE WHEN role IN {ends} THEN line_from END) AS close_line"),
        F.expr("CAST(count_if(role = 'member' AND keyword = 'func') AS INT) AS method_count"),
        F.expr("CAST(sum(bindings) AS INT) AS property_count"),
        F.expr("CAST(count_if(role = 'member' AND keyword = 'init') AS INT) AS initializer_count"),
        F.expr("CAST(count_if(role = 'member' AND keyword = 'subscript') AS INT) AS subscript_count"),
        F.expr("CAST(sum(accessors) AS INT) AS accessor_count"),
        F.expr("""sort_array(collect_list(CASE WHEN role = 'member'
                    THEN struct(member_ord, member_name AS name, start_line, end_line) END)) AS members"""),
        *[F.max(name).alias(name) for name in extra],
    )
    # Pre-order of the declarations: an outer type starts before the types inside it.
    ordered = grouped.selectExpr(
        "*", "owner.name AS name", "row_number() OVER (PARTITION BY project, path ORDER BY owner.decl_pos NULLS LAST) - 1 AS type_ord"
    )
    return ordered.select(
        *_FILE,
        tx.base_name(F.col("path")).alias("file_name"),
        "type_ord",
        category(F.col("name")).alias("class_type"),
        "name",
        "method_count",
        "property_count",
        F.expr("CAST(close_line - owner.line + 1 AS INT) AS line_count"),
        "initializer_count",
        "subscript_count",
        "accessor_count",
        F.expr("transform(members, m -> struct(m.name AS name, m.start_line AS start_line, m.end_line AS end_line)) AS members"),
        *[F.when(F.col("block") == NO_BLOCK, F.col(name)).alias(name) for name in extra],
    )


def extract_all(sources: DataFrame, partitions: int | None = None, close: bool = True) -> DataFrame:
    """Every class and struct with a body. Unless ``close``, ``line_count`` is null where the body never closes."""
    return _type_rows(_member_rows(_blocks(tokens(sources, partitions, outline=True))), close)


def extract_types(sources: DataFrame, partitions: int | None = None) -> DataFrame:
    """The ``types`` table: one row per class or struct, in declaration order.

    A body that never closes ends with the file's last token.
    """
    return extract_all(sources, partitions)


def extract_with_files(sources: DataFrame, head_lines: int, partitions: int | None = None) -> DataFrame:
    """Types and files from one pass over the texts: the columns of ``types``, ``kind`` (``type`` or ``file``), ``read_error``
    and ``snippet``.

    Every file has one row, also one without types and one that could not be read (its ``snippet`` is null). ``snippet`` is
    its first ``head_lines`` lines, null where that is 0; these lines are all of a text that moves.
    """
    rows = _type_rows(_member_rows(_blocks(tokens(sources, partitions, outline=True, head_lines=head_lines))))
    is_file = F.col("carried").isNotNull()
    rows = rows.withColumn("file_name", F.when(is_file, F.col("carried.file_name")).otherwise(F.col("file_name")))
    return rows.select(
        F.when(is_file, "file").otherwise("type").alias("kind"), *schema.TYPES.fieldNames(), "carried.read_error", "carried.snippet"
    )


def incomplete_types(sources: DataFrame) -> DataFrame:
    """The types whose closing brace is missing."""
    return (
        extract_all(sources, close=False)
        .where(F.col("line_count").isNull())
        .select(*schema.TYPE_KEY, "name", F.lit("parse_incomplete").alias("problem"))
    )


def members(types: DataFrame) -> DataFrame:
    """Exploded member map."""
    return types.select(
        *schema.TYPE_KEY, F.col("name").alias("type_name"), F.posexplode("members").alias("member_ord", "member")
    ).select(*schema.TYPE_KEY, "type_name", "member_ord", "member.name", "member.start_line", "member.end_line")
