"""Sections of an advice text, and the readable advice report.

A header line carries its section forward to the next header. That running state needs no
window: header lines are replaced by a break that no cleaned line can contain, and the text is
cut at the breaks. Everything happens inside the row, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from typeaudit.functions import severity as sev
from typeaudit.functions import text as tx

# Header texts by section, in order of precedence.
SECTIONS = {"root_cause": "root cause", "refactor_steps": "refactor steps", "quick_win": "quick win"}
TITLES = {"root_cause": "Root Cause", "refactor_steps": "Refactor Steps", "quick_win": "Quick Win"}

# Line caps of the unstructured form.
COMPACT_LINES = 8
VERBOSE_LINES = 20
MORE_HINT = "- ... set AI_VERBOSE=true for full AI text"
# Heading of a file's suggestions, and the rule between them.
ADVICE_HEADING = "🤖 AI Suggestions for "
ADVICE_RULE = "-" * 40

# Cleaned lines are not empty and neither start nor end with LF, so an empty line is free as a mark.
_BREAK = "\n\n"


def _marked(line: Column) -> Column:
    low = F.lower(line)
    marked = None
    for name, header in SECTIONS.items():
        marked = (F if marked is None else marked).when(low.contains(header), F.lit(f"\n{name}"))
    return marked.otherwise(line)


def _pieces(text: Column) -> Column:
    """``[section name, line, ...]`` joined by LF, one string per header; text before the first is dropped."""
    joined = F.array_join(F.transform(tx.clean_lines(text), _marked), "\n")
    # The first piece holds what comes before any header.
    cut = F.split(F.concat(F.lit("\n"), joined), _BREAK, -1)
    return F.slice(cut, 2, F.greatest(F.size(cut) - 1, F.lit(0)))


def _section_lines(pieces: Column, section: str) -> Column:
    """Lines of one section in order, bullets removed."""
    own = F.filter(pieces, lambda piece: F.substring_index(piece, "\n", 1) == section)
    bodies = F.transform(own, lambda piece: F.split(piece, tx.LINE_BREAK, -1))
    rest = F.flatten(F.transform(bodies, lambda lines: F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))))
    return F.transform(rest, tx.strip_bullets)


def with_sections(advice: DataFrame, text: str = "suggested_refactor") -> DataFrame:
    """Three array columns; the text is cut once for all of them."""
    cut = advice.withColumn("_pieces", _pieces(F.col(text)))
    return cut.withColumns({name: _section_lines(F.col("_pieces"), name) for name in SECTIONS}).drop("_pieces")


def advice_lines(advice: DataFrame, key: str = "request_id", text: str = "suggested_refactor") -> DataFrame:
    """Long form ``(key, section, line_ord, line)``."""
    sectioned = with_sections(advice, text)
    rows = F.array(*[F.struct(F.lit(name).alias("section"), F.col(name).alias("lines")) for name in SECTIONS])
    return (
        sectioned.select(key, F.explode(rows).alias("part"))
        .select(key, "part.section", F.posexplode("part.lines").alias("line_ord", "line"))
    )


def compact_lines(text: Column, maximum: int) -> Column:
    return F.slice(tx.clean_lines(text), 1, maximum)


def _bullets(lines: Column) -> Column:
    return F.transform(lines, lambda line: F.concat(F.lit("- "), line))


def report(verbose: bool = False, more: str = MORE_HINT) -> Column:
    """The report text of one ``with_sections`` row; ``more`` is the line under a shortened one."""
    nothing = F.array().cast("array<string>")
    head = F.array(
        F.concat(sev.emoji(F.col("severity")), F.lit(" "), sev.label(F.col("severity")), F.lit(" ["), F.col("rule"), F.lit("]")),
        F.concat(F.lit("Type       : "), F.col("type_name")),
        F.concat(F.lit("Model      : "), F.col("model_source")),
        F.concat(F.lit("Diagnosis  : "), tx.clean_markdown(F.col("diagnosis"))),
        F.lit(""),
    )
    blocks = [
        F.when(F.size(name) > 0, F.concat(F.array(F.lit(title)), _bullets(F.col(name)), F.array(F.lit("")))).otherwise(nothing)
        for name, title in TITLES.items()
    ]
    unstructured = F.lit(True)
    for name in SECTIONS:
        unstructured = unstructured & (F.size(name) == 0)
    text = F.col("suggested_refactor")
    short = compact_lines(text, VERBOSE_LINES if verbose else COMPACT_LINES)
    hint = nothing if verbose else F.when(F.size(short) >= COMPACT_LINES, F.array(F.lit(more))).otherwise(nothing)
    loose = F.when(
        unstructured, F.concat(F.array(F.lit("Suggestion")), _bullets(short), hint, F.array(F.lit("")))
    ).otherwise(nothing)
    raw = F.array(F.lit("Raw AI Output"), tx.clean_markdown(text), F.lit("")) if verbose else nothing
    return F.array_join(F.concat(head, *blocks, loose, raw), "\n")


def advice_report(advice: DataFrame, verbose: bool = False, more: str = MORE_HINT) -> DataFrame:
    return with_sections(advice).select("request_id", report(verbose, more).alias("report"))


def file_advice(advice: DataFrame, requests: DataFrame, verbose: bool = False, more: str = MORE_HINT) -> DataFrame:
    """Per file with suggestions ``project, path, position, line``: a heading, and each suggestion between rules.

    ``requests(request_id, project, path, type_ord, rule_ord)`` tells the file and the order of the suggestions.
    """
    texts = advice_report(advice, verbose, more).join(
        requests.select("request_id", "project", "path", "type_ord", "rule_ord"), "request_id"
    )
    in_file = W.partitionBy("project", "path").orderBy("type_ord", "rule_ord")
    placed = texts.withColumn("number", F.row_number().over(in_file))
    rule = F.lit(ADVICE_RULE)
    heading = F.concat(F.lit(ADVICE_HEADING), tx.base_name(F.col("path")))
    lines = F.when(F.col("number") == 1, F.array(heading, rule, F.col("report"), rule)).otherwise(F.array(F.col("report"), rule))
    first = F.when(F.col("number") == 1, F.lit(0)).otherwise(F.col("number") * 2)
    return placed.select("project", "path", first.alias("first"), F.posexplode(lines).alias("at", "line")).select(
        "project", "path", (F.col("first") + F.col("at")).alias("position"), "line"
    )
