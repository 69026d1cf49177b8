"""Source files: recursive scan, ignored folders, input checks, text decoding."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from typeaudit.functions import text as tx
from typeaudit.sources import listing
from typeaudit.sources.config import DEFAULT_IGNORED, with_config

SOURCE_SUFFIX = ".swift"

# Fixed value: the message existing callers of the input check compare with.
NOT_A_SOURCE_FILE = "❌ Single-file input must be a .swift file"
NOT_UTF8 = "file is not valid UTF-8"

_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?"


def below_root(path: Column, root: str) -> Column:
    """The part of ``path`` below ``root``."""
    prefix = re.sub(_SCHEME, "", root).rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substring(path, len(prefix) + 1, 1 << 30)).otherwise(path)


def is_ignored(path: Column, ignored: Column) -> Column:
    """True if any component of ``path`` is one of the ``ignored`` names."""
    return F.arrays_overlap(tx.components(path), ignored)


def ignored_names(extra: Iterable[str] = ()) -> list[str]:
    return list(dict.fromkeys([*DEFAULT_IGNORED, *extra]))


def default_ignored(extra: Iterable[str] = ()) -> Column:
    return F.array(*[F.lit(name) for name in ignored_names(extra)])


def prune(files: DataFrame, ignored: Column | None = None, path: Column | None = None) -> DataFrame:
    """Drop files below ignored folders. The names may be a literal array or a column."""
    path = F.col("path") if path is None else path
    return files.where(~is_ignored(path, default_ignored() if ignored is None else ignored))


def prune_by_table(files: DataFrame, ignored: DataFrame, path: str = "path") -> DataFrame:
    """Drop files below folders listed in a table ``(project, component)``: an anti join.

    Components are paired with their files first, so the join key is (project, component) and
    only the distinct paths that match travel to the final anti join.
    """
    parts = files.select("project", path, F.explode(F.array_distinct(tx.components(F.col(path)))).alias("component"))
    hits = parts.join(ignored.select("project", "component"), ["project", "component"], "left_semi")
    return files.join(hits.select("project", path).distinct(), ["project", path], "left_anti")


def prune_by_config(sources: DataFrame, configs: DataFrame) -> DataFrame:
    """Drop the files below the ignored folders of their project's config.

    Only keys and paths meet the configs; what they drop is anti-joined, so texts move at most where many files are
    dropped.
    """
    path = "relative_path" if "relative_path" in sources.columns else "path"
    keys = sources.select("project", "path", F.col(path).alias("tested"))
    dropped = with_config(keys, configs).where(is_ignored(F.col("tested"), F.col("config_ignored")))
    return sources.join(dropped.select("project", "path"), ["project", "path"], "left_anti")


def decode(files: DataFrame) -> DataFrame:
    """Binary ``content`` to ``text``; bytes that are not UTF-8 give ``read_error`` and no text. An earlier error stays."""
    valid = F.is_valid_utf8(F.col("content"))
    error = F.when(~valid, F.lit(NOT_UTF8))
    if "read_error" in files.columns:
        error = F.coalesce("read_error", error)
    return files.withColumns({"text": F.when(valid, F.col("content").cast("string")), "read_error": error}).drop("content")


def scan_sources(
    spark: SparkSession,
    root: str | dict[str, str],
    project: Column | None = None,
    ignored: Column | list[str] | None = None,
    absolute: bool = False,
    suffix: str = SOURCE_SUFFIX,
    where: Column | None = None,
    max_bytes: int = listing.MAX_BYTES,
    partitions: int | None = None,
) -> DataFrame:
    """The ``sources`` table of everything below ``root``, with the path below it as ``relative_path``.

    ``root`` may map the names of many projects to their roots; of roots that hold one another, the inner one
    has the file. ``project`` names the project of a row; by default a root is one project. Folders with a name in
    ``ignored`` are not entered (given as a column, it is tested on names before anything is read). Folders are tested below the root
    unless ``absolute`` is set, which also tests the folders above it. Names that begin with a dot are skipped.

    ``where`` is a condition on project, path, relative_path and n_bytes; beginnings of paths and projects are tested while
    listing. A file or folder that cannot be read, or a file of more than ``max_bytes``, is a row with ``read_error``.
    """
    roots = root if isinstance(root, dict) else {root.rstrip("/").rsplit("/", 1)[-1]: root}
    in_column = isinstance(ignored, Column)
    names = [] if in_column else ignored_names() if ignored is None else list(ignored)
    listed = listing.list_sources(spark, roots, names, suffix, absolute)
    if in_column:
        listed = prune(listed, ignored, F.col("path" if absolute else "relative_path"))
    if where is not None:
        listed = listed.where(where)
    files = decode(listing.read_listed(listed, max_bytes, partitions))
    label = F.col("project") if project is None else project
    return files.select(
        label.alias("project"), "path", tx.base_name(F.col("path")).alias("file_name"), "text", "read_error", "relative_path"
    )


def single_source(spark: SparkSession, path: str, max_bytes: int = listing.MAX_BYTES) -> DataFrame:
    """The ``sources`` table of one file. Ignored folders do not apply; the suffix may be in any case."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    stem, dot, suffix = name.rpartition(".")
    if not (stem and dot and suffix.lower() == SOURCE_SUFFIX.removeprefix(".")):
        raise ValueError(NOT_A_SOURCE_FILE)
    inner = listing.opened(path)[1]
    row = spark.createDataFrame([("", inner, inner, None, path, None)], listing.COLUMNS)
    return decode(listing.read_listed(row, max_bytes, 1)).select(
        "project", "path", tx.base_name(F.col("path")).alias("file_name"), "text", "read_error"
    )


def from_table(files: DataFrame, project: str, path: str, text: str) -> DataFrame:
    """``sources`` from a table that already holds the texts (or raw bytes) of many files."""
    raw = files.select(
        F.col(project).cast("string").alias("project"),
        F.col(path).cast("string").alias("path"),
        F.col(text).cast("binary").alias("content"),
    )
    return decode(raw).select(
        "project", "path", tx.base_name(F.col("path")).alias("file_name"), "text", "read_error"
    )


def input_error(path: Column, is_directory: Column) -> Column:
    """Null for a folder or a source file, else the fixed error text. The suffix case is free here."""
    wanted = SOURCE_SUFFIX.removeprefix(".")
    return F.when(~is_directory & (F.lower(tx.extension(path)) != wanted), F.lit(NOT_A_SOURCE_FILE))


def check_inputs(inputs: DataFrame) -> DataFrame:
    return inputs.withColumn("input_error", input_error(F.col("path"), F.col("is_directory")))


def read_errors(sources: DataFrame) -> DataFrame:
    return sources.where(F.col("read_error").isNotNull()).select("project", "path", "read_error")


def any_error(sources: DataFrame) -> DataFrame:
    """One row: could any file not be read or decoded?"""
    return sources.agg(F.coalesce(F.bool_or(F.col("read_error").isNotNull()), F.lit(False)).alias("has_errors"))
