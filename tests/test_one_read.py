"""One pass over the texts: types, headers, read errors and snippets come from the same extraction."""

import os

import pytest
from pyspark.sql import functions as F

from typeaudit.operators import extract
from typeaudit.plans import analysis, derived
from typeaudit.sinks import reports

SF_DIR = "/root/testdata/sf0.001"
SOURCES = "project string, path string, file_name string, text string, read_error string"
BIG = "class BigModel {\n" + "\n".join(f"    func m{i}() {{ }}" for i in range(30)) + "\n}\n"
ROWS = [
    ("p", "a/Big.swift", "Big.swift", BIG, None),
    ("p", "a/Empty.swift", "Empty.swift", "", None),
    ("p", "a/Blank.swift", "Blank.swift", " \n// only this\n", None),
    ("p", "a/Bad.swift", "Bad.swift", None, "broken"),
    ("p", "a/Open.swift", "Other name", "struct A { struct B { var x = 1\n", None),
    ("q", "a/Big.swift", "Big.swift", "// header\r\n" + BIG + "\nenum E { case a }", None),
    ("q", "a/Stray.swift", "Stray.swift", "} } class C { }\n#if X\n", None),
]


@pytest.fixture(scope="module")
def sources(spark):
    return spark.createDataFrame(ROWS, SOURCES).repartition(3)


def test_same_types_and_a_row_for_each_file(spark, sources):
    found = extract.extract_with_files(sources, 3)
    columns = extract.extract_types(sources).columns
    types = found.where("kind = 'type'").select(columns)
    assert sorted(map(str, types.collect())) == sorted(map(str, extract.extract_types(sources).collect()))
    files = {(r.project, r.path): (r.file_name, r.read_error, r.snippet) for r in found.where("kind = 'file'").collect()}
    # Lines are cut at LF, but not inside CR LF.
    head = {"a/Big.swift": "class BigModel {\n    func m0() { }\n    func m1() { }"}
    assert files == {
        ("p", "a/Big.swift"): ("Big.swift", None, head["a/Big.swift"]), ("p", "a/Empty.swift"): ("Empty.swift", None, ""),
        ("p", "a/Blank.swift"): ("Blank.swift", None, " \n// only this\n"), ("p", "a/Bad.swift"): ("Bad.swift", "broken", None),
        ("p", "a/Open.swift"): ("Other name", None, "struct A { struct B { var x = 1\n"),
        ("q", "a/Big.swift"): ("Big.swift", None, "// header\r\nclass BigModel {\n    func m0() { }\n    func m1() { }"),
        ("q", "a/Stray.swift"): ("Stray.swift", None, "} } class C { }\n#if X\n"),
    }


def lines_of(run):
    return sorted(map(str, reports.file_report_lines(run.tables).collect()))


def test_reports_are_the_same_and_read_no_text(spark, sources, tmp_path):
    path = str(tmp_path / "sources")
    sources.write.parquet(path)
    stored = spark.read.schema(SOURCES).parquet(path)
    once, again = analysis.analyze(stored), analysis.analyze(stored, keep_types=False)
    assert lines_of(once) == lines_of(again)
    assert once.summary().collect() == again.summary().collect()
    asked = [run.requests(snippet_lines=n) for run in (once, again) for n in (120, 2)]
    prompts = [sorted((r.request_id, r.prompt) for r in rows.collect()) for rows in asked]
    assert prompts[0] == prompts[2] and prompts[1] == prompts[3] and prompts[0] and prompts[0] != prompts[1]
    assert once.file_counts() == again.file_counts() == (7, 1)
    for table in (reports.file_report_lines(once.tables), once.summary(), asked[0], asked[1], once.reports()):
        assert not any(f"{path}/" in file for file in table.inputFiles())
    # More lines than were kept need the texts.
    longer = analysis.analyze(stored, snippet_lines=2)
    assert sorted((r.request_id, r.prompt) for r in longer.requests().collect()) == prompts[0]
    assert any(f"{path}/" in file for file in longer.requests().inputFiles())


def test_the_texts_are_scanned_once(spark, sources):
    plans = [
        rows._jdf.queryExecution().executedPlan().toString()
        for rows in (extract.extract_with_files(sources, 120), extract.extract_types(sources))
    ]
    counts = [[plan.count(word) for word in ("Scan ", "Exchange hashpartitioning", "regexp_extract_all", "Window ")] for plan in plans]
    assert counts[0] == counts[1] and counts[0][:2] == [1, 1]


def test_empty_table(spark, sources):
    run = analysis.analyze(sources.where("false"))
    assert run.types.count() == run.files.count() == run.requests().count() == 0 and run.summary().first().total_files == 0


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables are not here")
def test_driver_documents(spark):
    documents = derived.document_sources(spark, SF_DIR)
    run = analysis.analyze(documents)
    assert run.types.exceptAll(extract.extract_types(documents)).count() == 0
    assert run.types.count() == extract.extract_types(documents).count()
    assert run.files.count() == documents.count()


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables are not here")
def test_tasks_grow_with_the_table(spark, monkeypatch):
    """A task of the extraction holds a part of bounded size; the elements do not move after the texts."""
    documents = derived.table(spark, SF_DIR, "documents")
    stored = sum(os.path.getsize(name.removeprefix("file://")) for name in documents.inputFiles())
    monkeypatch.setattr(derived, "TASK_BYTES", stored // 40)
    sources = derived.document_sources(spark, SF_DIR)
    assert sources.rdd.getNumPartitions() == derived.task_count(spark, documents) >= 40
    plan = extract.extract_types(sources)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
