"""Which type an issue belongs to.

``lineage`` keeps the type the issue was computed from. ``substring`` reproduces message
matching: the first type of the file whose name occurs in the message, else the file's first
type. That theta join is rewritten as equality joins: the substrings of a word are candidate
names, and types are looked up by (project, path, name). Each distinct word of a file is cut up
once, so the work grows with the words of the messages and never with issues times types.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typeaudit import schema

UNKNOWN_TYPE = "UnknownType"
UNKNOWN_CLASS = "UnknownClass"


def _with_parts(words: DataFrame) -> DataFrame:
    """A row per substring of ``word`` that is as long as some name of the file, as ``candidate``. Two generators,
    so the rows are produced in compiled code and no word holds all its substrings at once."""
    sized = words.selectExpr("*", "explode(filter(sizes, s -> s <= length(word))) AS size")
    cuts = sized.selectExpr("*", "explode(sequence(1, length(word) - size + 1)) AS start")
    return cuts.withColumn("candidate", F.expr("substring(word, start, size)")).drop("start", "size", "sizes")


def message_words(message: Column) -> Column:
    """Distinct blank-separated words. A name without blanks lies within one."""
    return F.array_distinct(F.filter(F.split(message, r"\s+"), lambda word: word != ""))


def _roomy_words(named: DataFrame, issue_key: Sequence[str]) -> DataFrame:
    """The words of each message that are as long as the file's shortest name; no other word can hold one."""
    texts = F.when(F.col("blanks"), F.array("message")).otherwise(message_words(F.col("message")))
    roomy = F.filter(texts, lambda word: F.length(word) >= F.try_element_at("sizes", F.lit(1)))
    return named.select(*issue_key, "sizes", F.explode(roomy).alias("word"))


def attribute(issues: DataFrame, types: DataFrame, mode: str = "lineage", unknown: str = UNKNOWN_TYPE) -> DataFrame:
    """``issues`` plus ``matched_ord`` and ``matched_name``."""
    if mode == "lineage":
        return issues.withColumns({"matched_ord": F.col("type_ord"), "matched_name": F.col("type_name")})
    if mode != "substring":
        raise ValueError(f"unknown attribution mode: {mode}")
    issue_key = [*schema.TYPE_KEY, "rule_ord"]
    word_key = [*schema.FILE_KEY, "word"]
    first_of_name = types.groupBy(*schema.FILE_KEY, F.col("name").alias("candidate")).agg(
        F.min("type_ord").alias("candidate_ord")
    )
    # Names in backticks may hold blanks; then the message is taken whole.
    names = types.groupBy(*schema.FILE_KEY).agg(
        F.sort_array(F.collect_set(F.length("name"))).alias("sizes"), F.bool_or(F.col("name").rlike(r"\s")).alias("blanks")
    )
    words = _roomy_words(issues.join(names, schema.FILE_KEY), issue_key)
    # Words shared by all messages of a file collapse before the exchange.
    matched_words = (
        _with_parts(words.select(*word_key, "sizes").distinct())
        .join(first_of_name, [*schema.FILE_KEY, "candidate"])
        .groupBy(*word_key)
        .agg(F.min(F.struct("candidate_ord", "candidate")).alias("hit"))
    )
    # Only words with a hit are left, about one per issue.
    matched = words.join(matched_words, word_key).groupBy(*issue_key).agg(F.min("hit").alias("hit"))
    first_of_file = types.groupBy(*schema.FILE_KEY).agg(F.min(F.struct("type_ord", "name")).alias("first"))
    return (
        issues.join(matched, issue_key, "left")
        .join(first_of_file, schema.FILE_KEY, "left")
        .withColumns(
            {
                "matched_ord": F.coalesce("hit.candidate_ord", "first.type_ord"),
                "matched_name": F.coalesce("hit.candidate", "first.name", F.lit(unknown)),
            }
        )
        .drop("hit", "first")
    )


def reports(attributed: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The machine-readable issue record; columns already in the order of the sorted keys.

    ``keys`` names columns to keep after those of the record.
    """
    from typeaudit.functions import severity as sev

    return attributed.select(
        F.col("file_name").alias("file"),
        "line",
        "message",
        "rule",
        sev.emoji(F.col("severity")).alias("severity"),
        F.col("matched_name").alias("typeName"),
        *keys,
    )
