"""Choice between advice tiers: preferred local, cloud, local fallback, static text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typeaudit.functions import text as tx
from typeaudit.operators import heuristics
from typeaudit.operators.responses import ADVICE_COLUMNS

# An answer this short, in grapheme clusters, or a stub's diagnosis, is not trusted.
MIN_ADVICE_LENGTH = 50
STUB_MARK = "Stub"

_CONTENT = ["diagnosis", "model_source", "suggested_refactor"]


def confident(diagnosis: Column, suggested_refactor: Column) -> Column:
    return tx.has_more_graphemes(suggested_refactor, MIN_ADVICE_LENGTH) & ~diagnosis.contains(STUB_MARK)


def _tier(advice: DataFrame, name: str) -> DataFrame:
    """Successful answers of a tier, one struct per request."""
    usable = advice.where(F.col("error_kind").isNull()) if "error_kind" in advice.columns else advice
    content = [F.col("type_name").alias("type_name"), *[F.col(column) for column in _CONTENT]]
    return usable.select("request_id", F.struct(*content).alias(name))


def _resolve(requests: DataFrame, tiers: dict[str, DataFrame | None], choice: Column) -> DataFrame:
    # The static tier is computed in the row, so it needs no join.
    static = heuristics.static_advice(requests).select("request_id", "rule", "severity", F.struct("type_name", *_CONTENT).alias("static"))
    joined = static
    for name, advice in tiers.items():
        if advice is None:
            joined = joined.withColumn(name, F.lit(None).cast(static.schema["static"].dataType))
        else:
            joined = joined.join(_tier(advice, name), "request_id", "left")
    return joined.withColumn("chosen", choice).select(
        "request_id", "rule", "chosen.type_name", "severity", *[f"chosen.{column}" for column in _CONTENT]
    ).select(*ADVICE_COLUMNS)


def local_first(
    requests: DataFrame, preferred: DataFrame, fallback: DataFrame | None, cloud: DataFrame | None = None
) -> DataFrame:
    """A confident local answer wins; otherwise cloud, then the fallback, then the static text."""
    keep = F.when(confident(F.col("preferred.diagnosis"), F.col("preferred.suggested_refactor")), F.col("preferred"))
    choice = F.coalesce(keep, F.col("cloud"), F.col("fallback"), F.col("static"))
    return _resolve(requests, {"preferred": preferred, "cloud": cloud, "fallback": fallback}, choice)


def cloud_first(requests: DataFrame, cloud: DataFrame | None, fallback: DataFrame | None) -> DataFrame:
    choice = F.coalesce(F.col("cloud"), F.col("fallback"), F.col("static"))
    return _resolve(requests, {"cloud": cloud, "fallback": fallback}, choice)
