"""End-to-end analysis: sources in, types, issues, roll-ups and requests out."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from typeaudit import schema
from typeaudit.operators import attribution, engine, extract, requests, summary
from typeaudit.operators import rules as R
from typeaudit.session import materialize
from typeaudit.sinks import documents, reports
from typeaudit.sources import config as cfg
from typeaudit.sources import files


def _file_counts() -> list[Column]:
    return [F.count("*").alias("files"), F.count_if(F.col("read_error").isNotNull()).alias("unreadable")]


@dataclass(frozen=True)
class Analysis:
    """Lazy tables of one run."""

    sources: DataFrame
    types: DataFrame
    found: DataFrame
    issues: DataFrame
    #: Counts of files and unreadable ones, taken while the types were extracted.
    seen: Observation | None = None
    #: One row for each file, with its snippet, where the types were kept.
    kept_files: DataFrame | None = None
    #: Lines of these snippets.
    kept_lines: int = 0

    @property
    def files(self) -> DataFrame:
        """``project, path, file_name, read_error`` of all files, without reading a text where the pass that extracted the types kept them."""
        return self.sources if self.kept_files is None else self.kept_files

    def file_counts(self) -> tuple[int, int]:
        """Files, and those that could not be read; from the extraction's own pass if it has run."""
        counts = self.seen.get if self.seen is not None else {}
        if "files" not in counts:
            counts = self.files.agg(*_file_counts()).first()
        return counts["files"], counts["unreadable"]

    @property
    def tables(self) -> reports.Tables:
        return reports.Tables(self.files, self.found, self.issues)

    def reports(self, mode: str = "lineage") -> DataFrame:
        return attribution.reports(attribution.attribute(self.issues, self.types, mode))

    def summary(self) -> DataFrame:
        return summary.summary(self.found, self.files)

    def leaderboard(self, size: int = 10) -> DataFrame:
        return summary.leaderboard(self.issues, size)

    def requests(
        self,
        maximum: int = requests.MAX_SUGGESTIONS,
        snippet_lines: int = requests.SNIPPET_LINES,
        compact: bool = False,
    ) -> DataFrame:
        chosen = requests.select_requests(self.found, maximum)
        if self.kept_files is not None and 0 <= snippet_lines <= self.kept_lines:
            with_text = requests.with_kept_snippet(chosen, self.kept_files, snippet_lines)
        else:
            with_text = requests.with_snippet(chosen, self.sources, snippet_lines)
        return requests.with_prompt(with_text, compact)


def analyze(
    sources: DataFrame,
    configs: DataFrame | None = None,
    rules: Sequence[R.Rule] = R.DEFAULT_RULES,
    settings: R.Settings | None = None,
    keep_types: bool = True,
    partitions: int | None = None,
    snippet_lines: int = requests.SNIPPET_LINES,
) -> Analysis:
    """Analyze a ``sources`` table.

    With ``configs`` each project uses its own switches, thresholds and ignored folders, which are tested
    below the scan's root where ``sources`` has a ``relative_path``.
    ``keep_types`` writes the extracted types, and a row for each file with its first ``snippet_lines`` lines, to the shared
    folder in one pass over the texts, since every report starts from them; unset it when a single report is wanted.
    Prompts with longer snippets read the texts again. ``partitions`` is the number of tasks of the extraction.
    """
    if configs is not None:
        sources = files.prune_by_config(sources, configs)
    if not keep_types:
        return analyze_extracted(sources, extract.extract_types(sources, partitions), configs, rules, settings)
    seen = Observation()
    rows = extract.extract_with_files(sources.observe(seen, *_file_counts()), snippet_lines, partitions)
    kept = materialize(rows, "types", by="kind")
    types = kept.where("kind = 'type'").select(*schema.TYPES.fieldNames())
    kept_files = kept.where("kind = 'file'").select(*schema.FILE_KEY, "file_name", "read_error", "snippet")
    run = analyze_extracted(sources, types, configs, rules, settings)
    return replace(run, seen=seen, kept_files=kept_files, kept_lines=snippet_lines)


def analyze_extracted(
    sources: DataFrame,
    types: DataFrame,
    configs: DataFrame | None = None,
    rules: Sequence[R.Rule] = R.DEFAULT_RULES,
    settings: R.Settings | None = None,
) -> Analysis:
    """The same over types that exist already."""
    rows = types
    if configs is not None:
        rows = cfg.with_config(types, configs).drop("config_ignored")
        settings = R.Settings(config=F.col("config_rules"))
    found = engine.evaluate(rows, rules, settings).drop("config_rules")
    return Analysis(sources, types, found, engine.issues(found))


class StrictReadError(RuntimeError):
    """Raised after a strict JSON run in which some file could not be read."""


def write_json_report(
    analysis: Analysis, path: str, mode: str = "lineage", strict: bool = True, by_project: bool = False, as_array: bool = False
) -> None:
    """Write the issue records; then fail if a file was unreadable, unless ``strict`` is off.

    With ``by_project`` each project has a folder, and records carry their path and stand in order. With ``as_array`` the files of
    the folder, read in the order of names, are one JSON array of all records in order.

    An input without files writes nothing at all.
    """
    total, unreadable = analysis.file_counts()
    if not total:
        return
    if by_project and as_array:
        raise ValueError("a report is written by project or as one array")
    if by_project or as_array:
        order = ["project", "path", "type_ord", "rule_ord"]
        records = attribution.reports(attribution.attribute(analysis.issues, analysis.types, mode), order)
        if as_array:
            documents.write_array(records, path, order)
        else:
            reports.write_json_by_project(records, path)
    else:
        reports.write_json(analysis.reports(mode), path)
    if strict and unreadable:
        raise StrictReadError("some files could not be read; see files.read_errors")
