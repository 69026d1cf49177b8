"""Corpus pipeline: quality rules, near-dedup, repeated passages, benchmark decontamination, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from typeaudit.llm import decontaminate, near_dedup, packing, quality_rules, repeats
from typeaudit.session import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the base rule or the rules learned from ``labels`` reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules.judged(docs, labels).where("kept").select("row.*")


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies: the smallest ``doc_id``, or a row without one where the group has none.

    Rows are told apart by ``doc_id`` and text, so each text of a repeated ``doc_id``, and each row without one, is judged
    by itself. Rows equal in both are kept once.
    """
    key = near_dedup.free_name(docs, "near_key")
    keyed = near_dedup.with_row_key(docs, key)
    labels = keyed.select(F.col(key).alias("doc_id"), "text")
    found = materialize(near_dedup.near_duplicates(labels).withColumnRenamed("doc_id", "near_key"), "groups")
    # Hashed keys are larger than ids, but do not follow the ids they stand for.
    hashed = keyed.where(F.col(key) >= near_dedup.HASHED).select(F.col(key).alias("near_key"), "doc_id").distinct()
    if hashed.isEmpty():
        dropped = found.where("not kept").select("near_key").distinct()
    else:
        named = found.select("near_key", "component_id").distinct().join(hashed, "near_key", "left")
        own = F.when(F.col("near_key") < near_dedup.HASHED, F.col("near_key")).otherwise(F.col("doc_id"))
        least = F.min(F.struct(own.isNull().alias("no_id"), own.alias("id"), "near_key")).alias("least")
        heads = named.groupBy("component_id").agg(least).select("least.near_key")
        dropped = named.select("near_key").join(heads, "near_key", "left_anti")
    kept = keyed.join(dropped.withColumnRenamed("near_key", key), key, "left_anti")
    again = found.groupBy("near_key").count().where("count > 1").select(F.col("near_key").alias(key))
    if again.isEmpty():
        return kept.select(docs.columns)
    once = kept.join(again, key, "left_semi").dropDuplicates([key]).select(docs.columns)
    return kept.join(again, key, "left_anti").select(docs.columns).unionByName(once)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated passages out of the texts; drops texts of which no word is left."""
    found = repeats.without_repeats(docs)
    # A cut may split a character; its other bytes go as well.
    text = F.make_valid_utf8(F.col("kept").cast("string"))
    broken = F.lit("\ufffd")
    text = F.when(F.contains("row.text", broken), text).otherwise(F.replace(text, broken, F.lit("")))
    text = F.when(F.col("n_removed") > 0, text).otherwise(F.col("row.text"))
    cut = found.withColumn("left", text).where((F.col("n_removed") == 0) | F.col("left").rlike("[^\\x20\\x09-\\x0D]"))
    new = {"text": F.col("left"), "n_chars": F.when(F.col("n_removed") > 0, F.length("left")).otherwise(F.col("row.n_chars"))}
    kinds = {field.name: field.dataType for field in docs.schema}
    return cut.select(*(new.get(c, F.col(f"row.`{c}`")).cast(kinds[c]).alias(c) for c in docs.columns))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.passages(docs, benchmark).where(F.size("spans") == 0).select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each piece of each document, and its place in a training sequence."""
    pieces = ["n_tokens", "piece", "piece_tokens", "bin", "bin_offset"]
    return packing.pack(docs).select("row.doc_id", "row.lang", "row.source", "row.n_chars", *pieces)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", good),
    ("MinHash near-dedup", distinct),
    ("suffix-array dedup", without_repeats),
    ("benchmark decontamination", decontaminated),
    ("best-fit packing", packed),
]

#: The learned rules and the packing are not expressible in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
