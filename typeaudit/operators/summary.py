"""Roll-ups: session summary, issues per file, leaderboard, first findings of a file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from typeaudit import schema
from typeaudit.functions import severity as sev
from typeaudit.operators import engine

COUNTERS = ["total_files", "total_types", "total_issues", "warnings", "infos", "criticals"]


def _counter_rows(found: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per file and one per type, each with its share of the counters; narrow."""
    zero = F.lit(0)
    files = sources.select(
        *schema.FILE_KEY, F.lit(1).alias("total_files"), *[zero.alias(name) for name in COUNTERS[1:]]
    )
    types = found.select(
        *schema.FILE_KEY,
        zero.alias("total_files"),
        F.lit(1).alias("total_types"),
        engine.count_by_severity(found).alias("total_issues"),
        engine.count_by_severity(found, sev.WARNING).alias("warnings"),
        engine.count_by_severity(found, sev.INFO).alias("infos"),
        engine.count_by_severity(found, sev.CRITICAL).alias("criticals"),
    )
    return files.unionByName(types)


def _totals():
    return [F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in COUNTERS]


def summary(found: DataFrame, sources: DataFrame) -> DataFrame:
    """One row; zeros for an empty input. ``found`` is the output of ``engine.evaluate``."""
    return _counter_rows(found, sources).agg(*_totals())


def file_counters(found: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per file, also for files without types."""
    return _counter_rows(found, sources).groupBy(*schema.FILE_KEY).agg(*_totals())


def summary_by_project(found: DataFrame, sources: DataFrame) -> DataFrame:
    return _counter_rows(found, sources).groupBy("project").agg(*_totals())


def summary_rollup(found: DataFrame, sources: DataFrame) -> DataFrame:
    """Counters per file, per project and for the whole corpus (``level`` 0, 1, 2) in one pass.

    Rows are added up per file first, so the rollup expands files and not types.
    """
    return file_counters(found, sources).rollup(*schema.FILE_KEY).agg(
        F.when(F.grouping("project") == 1, 2).when(F.grouping("path") == 1, 1).otherwise(0).alias("level"), *_totals()
    )


def issues_per_file(issues: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Issue count per file; with ``sources`` every analyzed file has a row."""
    counts = issues.groupBy(*schema.FILE_KEY).agg(F.count("*").alias("issue_count"))
    if sources is None:
        return counts
    return (
        sources.select(*schema.FILE_KEY, "file_name")
        .join(counts, schema.FILE_KEY, "left")
        .withColumn("issue_count", F.coalesce("issue_count", F.lit(0)))
    )


def leaderboard(issues: DataFrame, size: int = 10) -> DataFrame:
    """The files with most issues. Ties go by project and path."""
    return (
        issues.groupBy(*schema.FILE_KEY, "file_name")
        .agg(F.count("*").alias("issue_count"))
        .orderBy(F.desc("issue_count"), "project", "path")
        .limit(size)
    )


def file_head(issues: DataFrame, size: int = 5) -> DataFrame:
    """The first ``size`` issues of each file, and how many more the file has.

    The rank filter is applied before the exchange, and the count is a partial aggregate, so a
    file with very many issues sends ``size`` rows and one count per map task.
    """
    by_emission = W.partitionBy(*schema.FILE_KEY).orderBy("type_ord", "rule_ord")
    heads = issues.withColumn("position", F.row_number().over(by_emission)).where(F.col("position") <= size)
    return heads.join(issues_per_file(issues), schema.FILE_KEY).withColumn(
        "more", F.greatest(F.col("issue_count") - size, F.lit(0))
    )


def best_per_type(issues: DataFrame, key: str = "type_ord") -> DataFrame:
    """The most severe actionable issue of each type; the earliest one among equals.

    ``key`` is ``type_ord``, or ``matched_name`` to group as message matching does.
    """
    first = W.partitionBy(*schema.FILE_KEY, key).orderBy(
        F.desc(sev.rank(F.col("severity"))), "type_ord", "rule_ord"
    )
    return (
        issues.where(sev.actionable(F.col("severity")))
        .withColumn("position", F.row_number().over(first))
        .where(F.col("position") == 1)
        .drop("position")
    )
