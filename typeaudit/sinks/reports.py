"""Report renderings and their writers. Every rendering is a table of lines."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from typeaudit import schema
from typeaudit.functions import severity as sev
from typeaudit.operators import summary

DEFAULT_TAG = "typeaudit"
#: Bound of a leaderboard, whose rows are broadcast.
MOST_FILES = 10_000
# The rules, titles and phrases of the renderings below equal those existing consumers expect.
RULE_LINE = "-" * 40
DOUBLE_LINE = "=" * 40


@dataclass(frozen=True)
class Tables:
    """What a reporter may read."""

    sources: DataFrame
    found: DataFrame
    issues: DataFrame


# A reporter maps the tables to a DataFrame with a `line` column.
Reporter = Callable[[Tables], DataFrame]


# --- JSON -------------------------------------------------------------------------------


def report_json(reports: DataFrame) -> DataFrame:
    """One JSON object per issue, keys sorted, absent line left out."""
    return reports.select(F.to_json(F.struct(*sorted(reports.columns))).alias("line"))


def write_json(reports: DataFrame, path: str) -> None:
    reports.select(*sorted(reports.columns)).write.mode("errorifexists").json(path)


def write_json_by_project(records: DataFrame, path: str) -> None:
    """Records that keep ``project, path, type_ord, rule_ord``: a folder per project, a file's issues in their order."""
    order = ["project", "path", "type_ord", "rule_ord"]
    record = sorted(name for name in records.columns if name not in order)
    placed = records.repartitionByRange("project", "path").sortWithinPartitions(*order)
    placed.select(*record, "path", "project").write.mode("errorifexists").partitionBy("project").json(path)


# --- compiler-style diagnostics ---------------------------------------------------------


def diagnostic_lines(issues: DataFrame, root: Column | str, tag: str = DEFAULT_TAG) -> DataFrame:
    """``<root>/<file>:<line>: <level>: [tag] <message>`` per issue."""
    root = F.lit(root) if isinstance(root, str) else root
    return issues.select(
        *schema.TYPE_KEY,
        "rule_ord",
        F.concat(
            root, F.lit("/"), F.col("file_name"), F.lit(":"), F.coalesce("line", F.lit(1)).cast("string"), F.lit(": "),
            sev.diagnostic_level(F.col("severity")), F.lit(f": [{tag}] "), F.col("message"),
        ).alias("line"),
    )


def diagnostic_summary(totals: DataFrame, tag: str = DEFAULT_TAG) -> DataFrame:
    return totals.select(
        F.format_string(
            f"note: [{tag}] Analysis complete. Found %d issues in %d files.", "total_issues", "total_files"
        ).alias("line")
    )


# --- text -------------------------------------------------------------------------------


def issue_line(with_line_number: bool = False) -> Column:
    number = F.when(F.col("line").isNotNull(), F.concat(F.lit("[Line "), F.col("line").cast("string"), F.lit("] ")))
    prefix = F.coalesce(number, F.lit("")) if with_line_number else F.lit("")
    return F.concat(F.lit("   "), sev.emoji(F.col("severity")), F.lit(" "), prefix, F.col("message"))


def member_lines(members: Column, indent: str) -> Column:
    return F.transform(
        members,
        lambda m: F.format_string(f"{indent}- %s (Lines %d-%d)", m["name"], m["start_line"], m["end_line"]),
    )


def _type_lines() -> Column:
    head = F.array(
        F.format_string("📦 Type: %s [%s]", "name", "class_type"),
        F.format_string(
            "   Inits: %d | Accessors: %d | Subscripts: %d", "initializer_count", "accessor_count", "subscript_count"
        ),
        F.format_string("   Methods: %d | Properties: %d | Lines: %d", "method_count", "property_count", "line_count"),
    )
    has_members = F.size("members") > 0
    title = F.when(has_members, F.array(F.lit("   Members Map:"))).otherwise(F.array().cast("array<string>"))
    return F.concat(head, title, F.coalesce(member_lines(F.col("members"), "      "), F.array().cast("array<string>")))


LINE_ORDER = [*schema.FILE_KEY, "section", "type_ord", "line_ord"]


def file_report_lines(tables: Tables) -> DataFrame:
    """The per-file text report as ``(project, path, section, type_ord, line_ord, line)``.

    Sections: 0 file header, 1 types, 2 blank line before the findings, 3 findings. Order by
    ``LINE_ORDER`` to read it.
    """

    def placed(df: DataFrame, section: int, lines: Column, type_ord: Column) -> DataFrame:
        return df.select(
            *schema.FILE_KEY,
            F.lit(section).alias("section"),
            type_ord.cast("int").alias("type_ord"),
            F.posexplode(lines).alias("line_ord", "line"),
        )

    readable = tables.sources.where(F.col("read_error").isNull())
    header = F.array(F.lit(""), F.concat(F.lit("📄 File: "), F.col("file_name")), F.lit(RULE_LINE))
    flagged = tables.issues.select(*schema.FILE_KEY).distinct()
    findings = tables.issues.select(
        *schema.FILE_KEY, F.lit(3).alias("section"), "type_ord", F.col("rule_ord").alias("line_ord"),
        issue_line().alias("line"),
    )
    return (
        placed(readable, 0, header, F.lit(-1))
        .unionByName(placed(tables.found, 1, _type_lines(), F.col("type_ord")))
        .unionByName(placed(flagged, 2, F.array(F.lit("")), F.lit(-1)))
        .unionByName(findings)
    )


SUMMARY_ORDER = ["section", "file_issues desc", *schema.FILE_KEY, "line_ord"]


def summary_report_lines(tables: Tables, size: int = 10, per_file: int = 5) -> DataFrame:
    """Leaderboard and totals as ``(section, file_issues, project, path, line_ord, line)``.

    Sections: 0 title, 1 leaderboard files (by ``file_issues`` descending, then path), 2 totals.
    """
    if not 0 < size <= MOST_FILES:
        raise ValueError(f"the leaderboard holds 1 to {MOST_FILES} files")
    top = summary.leaderboard(tables.issues, size).select(*schema.FILE_KEY, F.col("issue_count").alias("file_issues"))
    # At most `size` rows, fixed by the limit above, so this side is safe to broadcast.
    of_top = tables.issues.join(F.broadcast(top), schema.FILE_KEY)
    by_emission = W.partitionBy(*schema.FILE_KEY).orderBy("type_ord", "rule_ord")
    heads = of_top.withColumn("position", F.row_number().over(by_emission)).where(F.col("position") <= per_file)
    # The first row of a file brings its title, the last one its end.
    nothing = F.array().cast("array<string>")
    more = F.format_string("   ...and %d more issues", F.col("file_issues") - per_file)
    ends = F.when(F.col("file_issues") > per_file, F.array(more, F.lit(""))).otherwise(F.array(F.lit("")))
    is_last = F.col("position") == F.least(F.col("file_issues"), F.lit(per_file))
    file_lines = F.concat(
        F.when(F.col("position") == 1, F.array(F.concat(F.lit("📄 "), F.col("file_name")))).otherwise(nothing),
        F.array(issue_line(True)),
        F.when(is_last, ends).otherwise(nothing),
    )
    files = heads.select("file_issues", *schema.FILE_KEY, "position", F.posexplode(file_lines).alias("ord", "line")).select(
        F.lit(1).alias("section"),
        "file_issues",
        *schema.FILE_KEY,
        # The title, if any, comes first in the row of position 1.
        (F.col("position") + F.col("ord") - F.when(F.col("position") == 1, 1).otherwise(0)).cast("int").alias("line_ord"),
        "line",
    )
    title = F.array(F.lit(""), F.lit(f"🚨 Files With Issues (Top {size})"), F.lit(RULE_LINE))
    blocks = F.array(
        F.struct(F.lit(0).alias("section"), title.alias("lines")),
        F.struct(F.lit(2).alias("section"), total_lines().alias("lines")),
    )
    frame = (
        summary.summary(tables.found, tables.sources)
        .select(F.explode(blocks).alias("block"))
        .select("block.section", F.posexplode("block.lines").alias("line_ord", "line"))
        .selectExpr(
            "section", "CAST(NULL AS BIGINT) AS file_issues", "CAST(NULL AS STRING) AS project",
            "CAST(NULL AS STRING) AS path", "line_ord", "line",
        )
    )
    return frame.unionByName(files)


def total_lines() -> Column:
    """The totals block over a summary row."""
    counts = F.array(
        F.lit(""),
        F.lit(DOUBLE_LINE),
        F.lit("📊 Summary"),
        F.format_string("Files scanned: %d", "total_files"),
        F.format_string("Types analyzed: %d", "total_types"),
        F.format_string("Total issues: %d", "total_issues"),
        F.format_string(
            " | ".join(
                f"{sev.EMOJI[code]} {name}: %d"
                for code, name in ((sev.WARNING, "Warnings"), (sev.INFO, "Info"), (sev.CRITICAL, "Critical"))
            ),
            "warnings", "infos", "criticals",
        ),
    )
    clean = F.when(F.col("total_issues") == 0, F.array(F.lit("✅ No issues found. Clean code!"))).otherwise(
        F.array().cast("array<string>")
    )
    return F.concat(counts, clean, F.array(F.lit(DOUBLE_LINE), F.lit("")))


def write_lines(lines: DataFrame, order: list[str], path: str) -> None:
    """Write a line table as text in reading order.

    Range partitioning uses every ordering column, so a file with very many lines is spread over
    several tasks and the part files still read in order.
    """
    keys = [F.desc(name.split()[0]) if name.endswith(" desc") else F.col(name) for name in order]
    lines.repartitionByRange(*keys).sortWithinPartitions(*keys).select("line").write.mode("errorifexists").text(path)


# --- built-in reporters -----------------------------------------------------------------


def text_reporter(tables: Tables) -> DataFrame:
    return file_report_lines(tables)


def diagnostic_reporter(root: Column | str, tag: str = DEFAULT_TAG) -> Reporter:
    return lambda tables: diagnostic_lines(tables.issues, root, tag)
