"""Token counts: an exact histogram of encoded lengths, and what its suffix sums answer.

The only pass over the texts turns each into its length and sums by length inside the task, so what moves is a row for
each task and distinct length. Suffix sums run over distinct lengths: inside ranges of lengths in parallel, and over the
ranges' totals, whose number is the longest length divided by ``RANGE``. No text, source or copy group is a key.

Cases: null and empty texts have length 0 and count; repeated rows count as often as they stand. Columns other than
``text`` are ignored. An empty table gives an empty histogram.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from typeaudit.llm import scan, tokens

RANGE = 1 << 10


def histogram(docs: DataFrame, vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """``length, n_docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[int] = Counter()
        for batch in (part for whole in batches for part in scan.slices(whole, "text")):
            counts.update(tokens.lengths(batch.column("text"), vocabulary).tolist())
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], ["length", "n_docs"]
        )

    found = scan.mapped(docs.select(F.col("text").cast("string").alias("text")), run, "length long, n_docs long")
    return found.groupBy("length").agg(F.sum("n_docs").alias("n_docs"))


def by_limit(lengths: DataFrame) -> DataFrame:
    """For every distinct length as context limit: documents and tokens of it and above, and tokens left if all
    texts are cut there; between two lengths the cut total is linear. ``rank`` is the share of documents up to it.
    """
    each = lengths.withColumn("part", F.floor(F.col("length") / RANGE)).withColumn("n_tokens", F.col("length") * F.col("n_docs"))
    totals = each.groupBy("part").agg(F.sum("n_docs").alias("docs"), F.sum("n_tokens").alias("tokens"))
    above = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = totals.select(
        "part",
        F.coalesce(F.sum("docs").over(above), F.lit(0)).alias("docs_above"),
        F.coalesce(F.sum("tokens").over(above), F.lit(0)).alias("tokens_above"),
        F.sum("docs").over(whole).alias("all_docs"),
        F.sum("tokens").over(whole).alias("all_tokens"),
    )
    inside = Window.partitionBy("part").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        each.join(totals, "part")
        .withColumn("docs_from", F.col("docs_above") + F.sum("n_docs").over(inside))
        .withColumn("tokens_from", F.col("tokens_above") + F.sum("n_tokens").over(inside))
        .select(
            F.col("length").alias("context_limit"),
            "n_docs",
            "n_tokens",
            "docs_from",
            "tokens_from",
            (F.col("all_tokens") - F.col("tokens_from") + F.col("docs_from") * F.col("length")).alias("tokens_cut"),
            ((F.col("all_docs") - F.col("docs_from") + F.col("n_docs")) / F.col("all_docs")).alias("rank"),
        )
    )


def quantiles(limits: DataFrame, shares: list[float]) -> DataFrame:
    """``share, length``: the least length that covers each share of the documents."""
    wanted = [F.min(F.when(F.col("rank") >= share, F.col("context_limit"))).alias(str(i)) for i, share in enumerate(shares)]
    pairs = F.array(*(F.struct(F.lit(share).alias("share"), F.col(str(i)).alias("length")) for i, share in enumerate(shares)))
    return limits.agg(*wanted).select(F.inline(pairs))
