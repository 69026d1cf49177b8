"""Advice that needs no model: fixed texts by rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typeaudit.operators import rules as R

DEFAULT_MODEL = "Qwen2.5-Coder-7B-Instruct"

# Advice per rule; %s is the type.
ADVICE = {
    R.GOD_OBJECT: """\
1) Root Cause: %s is handling too many responsibilities (UI, Data, Logic).
2) Refactor Steps:
   - Extract networking logic into a Service class.
   - Move property-heavy state into a specialized Model or ViewModel.
   - Use a Coordinator for navigation logic.
3) Quick Win: Move Delegate/DataSource implementations to extensions.""",
    R.LARGE_CLASS: """\
1) Root Cause: %s exceeds recommended line/method counts for its type.
2) Refactor Steps:
   - Identify distinct functional blocks and move them to separate files.
   - Use composition instead of inheritance to share logic.
   - Audit methods: if a method doesn't use class state, move it to a Utility.
3) Quick Win: Extract private helper methods into a support structure.""",
    R.DATA_HEAVY: """\
1) Root Cause: High property-to-method ratio suggests this %s is a 'Data Bucket'.
2) Refactor Steps:
   - Convert to a 'Struct' if no identity or reference behavior is needed.
   - Group related properties into nested structs.
   - Move data processing logic into a dedicated Transformer or Manager.
3) Quick Win: Encapsulate related properties into a single 'Configuration' object.""",
}
GENERIC_ADVICE = "Local analysis suggests reviewing the SRP (Single Responsibility Principle) for %s."
DIAGNOSIS = "Analysis of %s violation."
SOURCE = "Local Heuristics (%s Engine)"
FALLBACK_SOURCE = "Local Heuristics (Fallback from %s)"
MODEL_SOURCE = "Local Model (%s)"
STATIC_DIAGNOSIS = "Analysis provided via basic static fallback."
STATIC_SOURCE = "Static Fallback Engine"
STATIC_ADVICE = (
    "Please review the SRP and architectural limits for %s. Detailed AI suggestions are currently unavailable."
)


def _filled(template: str, value: Column) -> Column:
    return F.replace(F.lit(template), F.lit("%s"), value)


def advice_text(rule: Column, type_name: Column) -> Column:
    """Advice for ``rule``; a finding without a type speaks of 'Type'."""
    subject = F.coalesce(type_name, F.lit("Type"))
    chosen = None
    for name, template in ADVICE.items():
        chosen = (F if chosen is None else chosen).when(rule == name, _filled(template, subject))
    return chosen.otherwise(_filled(GENERIC_ADVICE, subject))


def _shared(type_name: Column) -> list[Column]:
    return [F.col("request_id"), F.col("rule"), type_name.alias("type_name"), F.col("severity")]


def local_advice(requests: DataFrame, model: str = DEFAULT_MODEL, after_failure: bool = False) -> DataFrame:
    """``advice`` rows from the fixed texts. ``after_failure`` marks a model that did not answer."""
    source = (FALLBACK_SOURCE if after_failure else SOURCE) % model
    return requests.select(
        *_shared(F.coalesce("type_name", F.lit("Type"))),
        _filled(DIAGNOSIS, F.col("rule")).alias("diagnosis"),
        F.lit(source).alias("model_source"),
        advice_text(F.col("rule"), F.col("type_name")).alias("suggested_refactor"),
    )


def augmented_advice(requests: DataFrame, model_text: Column, model_file: str, model: str = DEFAULT_MODEL) -> DataFrame:
    """Model output followed by the fixed text."""
    return requests.select(
        *_shared(F.coalesce("type_name", F.lit("UnknownType"))),
        F.lit(f"Analysis complete using model at {model_file}.").alias("diagnosis"),
        F.lit(MODEL_SOURCE % model).alias("model_source"),
        F.concat(model_text, F.lit("\n\n"), advice_text(F.col("rule"), F.col("type_name"))).alias("suggested_refactor"),
    )


def static_advice(requests: DataFrame) -> DataFrame:
    """The safety net when every tier failed."""
    return requests.select(
        *_shared(F.coalesce("type_name", F.lit("UnknownType"))),
        F.lit(STATIC_DIAGNOSIS).alias("diagnosis"),
        F.lit(STATIC_SOURCE).alias("model_source"),
        _filled(STATIC_ADVICE, F.col("rule")).alias("suggested_refactor"),
    )
