"""Severity codes and their ranks, labels and symbols."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INFO, WARNING, CRITICAL = "info", "warning", "critical"

# Fixed values, equal to the ones existing report consumers expect.
EMOJI = {INFO: "ℹ️", WARNING: "⚠️", CRITICAL: "🔴"}
LABEL = {INFO: "Info", WARNING: "Warning", CRITICAL: "Critical"}
DIAGNOSTIC_LEVEL = {INFO: "note", WARNING: "warning", CRITICAL: "error"}
RANK = {INFO: 0, WARNING: 1, CRITICAL: 2}


def _choose(severity: Column, values: dict) -> Column:
    picked = None
    for code, value in values.items():
        picked = (F if picked is None else picked).when(severity == code, F.lit(value))
    return picked


def emoji(severity: Column) -> Column:
    return _choose(severity, EMOJI)


def label(severity: Column) -> Column:
    return _choose(severity, LABEL)


def diagnostic_level(severity: Column) -> Column:
    return _choose(severity, DIAGNOSTIC_LEVEL)


def rank(severity: Column) -> Column:
    return _choose(severity, RANK)


def actionable(severity: Column) -> Column:
    return severity.isin(WARNING, CRITICAL)
