"""Exact positions of rows in a total order, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from typeaudit.session import materialize

#: ``monotonically_increasing_id`` counts a partition's rows in the low bits.
_ROW_BITS = 33


def met(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on ``keys`` in which null equals null; columns of ``left``, then those of ``right`` that are no keys."""
    other = right.withColumnsRenamed({key: f"other_{key}" for key in keys})
    found = F.lit(True)
    for key in keys:
        found &= F.col(key).eqNullSafe(F.col(f"other_{key}"))
    return left.join(other, found).drop(*[f"other_{key}" for key in keys])


def ranked(rows: DataFrame, group: str, order: list[str], label: str) -> DataFrame:
    """``rows`` with ``at``, the position from 0 in the rows of its ``group`` by ``order`` (nulls first), and ``total``, their number.

    Rows are sorted in ranges of (group, order) and written; each range counts its rows of a group, and positions add
    the counts of the ranges before. Rows equal in the order stand in any order; a salt deals them over several ranges.
    """
    salted = rows.withColumn("rank_salt", F.xxhash64(F.monotonically_increasing_id()))
    by = [F.col(c).asc_nulls_first() for c in (group, *order, "rank_salt")]
    in_order = salted.repartitionByRange(*by).sortWithinPartitions(*by).drop("rank_salt")
    place = F.monotonically_increasing_id()
    numbered = in_order.withColumn("place", place).withColumn("range", F.shiftright("place", _ROW_BITS))
    kept = materialize(numbered, label)
    counts = kept.groupBy(group, "range").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    of_group = Window.partitionBy(group)
    before = of_group.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # A row for each range that a group reaches into.
    offsets = counts.select(
        group, "range", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(of_group).alias("total")
    )
    at = (F.col("place") - F.col("first") + F.col("before")).alias("at")
    return met(kept, offsets, [group, "range"]).select(*rows.columns, at, "total")
