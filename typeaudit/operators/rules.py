"""Threshold rules. A rule is a nullable struct column over one ``types`` row.

All comparisons are strict. The limits sit in the plan as CASE expressions, so evaluating
any number of rules takes one pass over the types, without a join or a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from typeaudit import schema
from typeaudit.functions import severity as sev
from typeaudit.operators import classify as cat

LARGE_CLASS = "LargeClass"
METHOD_DENSITY = "HighMethodDensity"
GOD_OBJECT = "GodObject"
DATA_HEAVY = "DataHeavyClass"

# Limits per category. `None` stands for the configured threshold.
LARGE_METHODS = {cat.VIEW_CONTROLLER: 25, cat.VIEW_MODEL: 20, cat.SERVICE: 15, cat.MODEL: 10, cat.UNKNOWN: None}
LARGE_LINES = {cat.VIEW_CONTROLLER: 400, cat.VIEW_MODEL: 300, cat.SERVICE: 250, cat.MODEL: 150, cat.UNKNOWN: 300}
DENSITY_METHODS = {cat.VIEW_CONTROLLER: 18, cat.VIEW_MODEL: 12, cat.SERVICE: 10, cat.MODEL: 6, cat.UNKNOWN: None}
GOD_METHODS = {cat.VIEW_CONTROLLER: 40, cat.VIEW_MODEL: 30, cat.SERVICE: 25, cat.MODEL: 15, cat.UNKNOWN: 30}
GOD_PROPERTIES = {cat.VIEW_CONTROLLER: 20, cat.VIEW_MODEL: 15, cat.SERVICE: 12, cat.MODEL: 20, cat.UNKNOWN: 15}
GOD_LINES = {cat.VIEW_CONTROLLER: 600, cat.VIEW_MODEL: 450, cat.SERVICE: 350, cat.MODEL: 250, cat.UNKNOWN: 400}

# Defaults of the configurable thresholds, and the density guards.
DEFAULT_THRESHOLDS = {"largeClass": 10, "highMethodDensity": 10, "godObject": None, "dataHeavyClass": 5}
DENSITY_MIN_LINES = 20
DENSITY_MAX_LINES = 350
DENSITY_MAX_AVERAGE = 15.0


class Settings:
    """Where the on/off switch and the threshold of a rule come from.

    Without ``config`` they are literals (which Catalyst folds); with it they are fields of a
    struct column of the ``types`` table, e.g. the merged config of the row's project.
    """

    def __init__(self, config: Column | None = None, **toggles: tuple[bool, int | None]):
        self._config = config
        self._toggles = toggles

    def enabled(self, key: str) -> Column:
        if self._config is not None:
            return F.coalesce(self._config[key]["enabled"], F.lit(False))
        return F.lit(self._toggles.get(key, (True, None))[0])

    def threshold(self, key: str) -> Column:
        default = F.lit(DEFAULT_THRESHOLDS[key]).cast("int")
        if self._config is not None:
            return F.coalesce(self._config[key]["threshold"], default)
        value = self._toggles.get(key, (True, None))[1]
        return default if value is None else F.lit(value).cast("int")


@dataclass(frozen=True)
class Rule:
    """A named rule; ``finding`` builds a nullable struct<rule,severity,message,line>."""

    name: str
    finding: Callable[[Settings], Column]


def finding(name: str, fires: Column, severity: Column | str, message: Column) -> Column:
    """The finding struct where ``fires`` holds, else null."""
    return F.when(
        fires,
        F.struct(
            F.lit(name).alias("rule"),
            (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"),
            message.alias("message"),
            F.lit(None).cast("int").alias("line"),
        ),
    ).cast(schema.FINDING)


def limit(values: dict, configured: Column | None = None) -> Column:
    """The limit of the row's category as a CASE expression."""
    fixed = " ".join(f"WHEN '{name}' THEN {value}" for name, value in values.items() if value is not None)
    chosen = F.expr(f"CASE class_type {fixed} END")
    if None not in values.values():
        return chosen
    open_ended = next(name for name, value in values.items() if value is None)
    return F.when(F.col("class_type") == open_ended, configured).otherwise(chosen)


def _text(column: Column) -> Column:
    return column.cast("string")


def _large_class(settings: Settings) -> Column:
    methods, lines = F.col("method_count"), F.col("line_count")
    max_methods = limit(LARGE_METHODS, settings.threshold("largeClass"))
    max_lines = limit(LARGE_LINES)
    many, long = methods > max_methods, lines > max_lines
    reasons = F.concat_ws(
        ", ",
        F.when(many, F.concat(_text(methods), F.lit(" methods (limit: "), _text(max_methods), F.lit(")"))),
        F.when(long, F.concat(_text(lines), F.lit(" lines (limit: "), _text(max_lines), F.lit(")"))),
    )
    return finding(
        LARGE_CLASS,
        settings.enabled("largeClass") & (many | long),
        F.when((methods > max_methods * 2) | (lines > max_lines * 2), sev.CRITICAL).otherwise(sev.WARNING),
        F.concat(F.lit("Type "), F.col("name"), F.lit(" is too large: "), reasons),
    )


def _method_density(settings: Settings) -> Column:
    methods, lines = F.col("method_count"), F.col("line_count")
    max_methods = limit(DENSITY_METHODS, settings.threshold("highMethodDensity"))
    # Null for a type without methods, so the division is safe under ANSI.
    average = F.try_divide(lines.cast("double"), methods.cast("double"))
    fires = (
        (lines >= DENSITY_MIN_LINES)
        & (lines <= DENSITY_MAX_LINES)
        & (methods > max_methods)
        & (average <= DENSITY_MAX_AVERAGE)
    )
    return finding(
        METHOD_DENSITY,
        settings.enabled("highMethodDensity") & fires,
        F.when(methods > max_methods * 2, sev.CRITICAL).otherwise(sev.WARNING),
        F.concat(
            F.lit("Class "), F.col("name"), F.lit(" has high method density ("), _text(methods),
            F.lit(" methods). Consider splitting into multiple responsibilities."),
        ),
    )


def _god_object(settings: Settings) -> Column:
    signals = [
        (F.col(column) > limit(values), F.concat(_text(F.col(column)), F.lit(f" {unit}")))
        for column, values, unit in (
            ("method_count", GOD_METHODS, "methods"),
            ("property_count", GOD_PROPERTIES, "properties"),
            ("line_count", GOD_LINES, "lines"),
        )
    ]
    hits = sum((signal.cast("int") for signal, _ in signals), F.lit(0))
    reasons = F.concat_ws(", ", *[F.when(signal, reason) for signal, reason in signals])
    return finding(
        GOD_OBJECT,
        settings.enabled("godObject") & (hits >= 2),
        sev.CRITICAL,
        F.concat(
            F.lit("Type "), F.col("name"),
            F.lit(" is a God Object (Major SRP violation). It exceeds multiple limits: "), reasons, F.lit("."),
        ),
    )


def _data_heavy(settings: Settings) -> Column:
    properties = F.col("property_count")
    return finding(
        DATA_HEAVY,
        settings.enabled("dataHeavyClass") & (properties > settings.threshold("dataHeavyClass")),
        sev.INFO,
        F.concat(
            F.lit("Type "), F.col("name"), F.lit(" has too many properties ("), _text(properties), F.lit(").")
        ),
    )


LargeClass = Rule(LARGE_CLASS, _large_class)
HighMethodDensity = Rule(METHOD_DENSITY, _method_density)
GodObject = Rule(GOD_OBJECT, _god_object)
DataHeavyClass = Rule(DATA_HEAVY, _data_heavy)

# Evaluation order.
DEFAULT_RULES = (LargeClass, HighMethodDensity, GodObject, DataHeavyClass)
