"""Rule evaluation, suppression of redundant findings, and the ``issues`` table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from typeaudit import schema
from typeaudit.operators import rules as R

# Findings that say nothing new once the type is known to be a God Object.
REDUNDANT_WITH_GOD_OBJECT = (R.LARGE_CLASS, R.DATA_HEAVY)

_PREFIX = "finding_"


def finding_columns(found: DataFrame) -> list[str]:
    names = [name for name in found.columns if name.startswith(_PREFIX)]
    return sorted(names, key=lambda name: int(name[len(_PREFIX):]))


def evaluate(
    types: DataFrame,
    rules: Sequence[R.Rule] = R.DEFAULT_RULES,
    settings: R.Settings | None = None,
    suppress: bool = True,
) -> DataFrame:
    """``types`` plus one nullable finding column per rule, in rule order. One narrow pass."""
    settings = settings or R.Settings()
    columns = {f"{_PREFIX}{i}": rule.finding(settings) for i, rule in enumerate(rules)}
    found = types.withColumns(columns)
    gods = [F.col(f"{_PREFIX}{i}").isNotNull() for i, rule in enumerate(rules) if rule.name == R.GOD_OBJECT]
    if not (suppress and gods):
        return found
    is_god = gods[0]
    for other in gods[1:]:
        is_god = is_god | other
    return found.withColumns(
        {
            f"{_PREFIX}{i}": F.when(~is_god, F.col(f"{_PREFIX}{i}"))
            for i, rule in enumerate(rules)
            if rule.name in REDUNDANT_WITH_GOD_OBJECT
        }
    )


def issues(found: DataFrame) -> DataFrame:
    """One row per finding. An explode of a fixed-size array: no shuffle."""
    slots = F.array(
        *[
            F.struct(F.lit(i).alias("rule_ord"), F.col(name).alias("finding"))
            for i, name in enumerate(finding_columns(found))
        ]
    )
    return (
        found.select(*schema.TYPE_KEY, "file_name", F.col("name").alias("type_name"), F.explode(slots).alias("slot"))
        .where(F.col("slot.finding").isNotNull())
        .select(
            "project", "path", "file_name", "type_ord", "type_name", "slot.rule_ord",
            "slot.finding.rule", "slot.finding.severity", "slot.finding.message", "slot.finding.line",
        )
    )


def analyze_types(
    types: DataFrame, rules: Sequence[R.Rule] = R.DEFAULT_RULES, settings: R.Settings | None = None
) -> DataFrame:
    return issues(evaluate(types, rules, settings))


def suppress_redundant(all_issues: DataFrame) -> DataFrame:
    """Suppression on an issue table whose types are no longer at hand: one window over each type's few issues."""
    is_god = F.max(F.col("rule") == R.GOD_OBJECT).over(Window.partitionBy(*schema.TYPE_KEY))
    redundant = F.col("rule").isin(*REDUNDANT_WITH_GOD_OBJECT)
    return all_issues.withColumn("is_god", is_god).where(~(redundant & F.col("is_god"))).drop("is_god")


def count_by_severity(found: DataFrame, severity: str | None = None) -> Column:
    """Number of findings in the row, of one severity or of all; an int expression."""
    total = F.lit(0)
    for name in finding_columns(found):
        hit = F.col(name).isNotNull() if severity is None else F.col(f"{name}.severity") == severity
        total = total + F.when(hit, 1).otherwise(0)
    return total
