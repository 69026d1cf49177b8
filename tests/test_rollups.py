import json
import os

import pytest
from pyspark.sql import functions as F

from typeaudit.operators import attribution, engine, summary
from typeaudit.plans import analysis
from typeaudit.sinks import reports


@pytest.fixture
def run(spark, make_types, make_sources):
    types = make_types(
        ("model", "User", 11, 2, 30), ("model", "UserDataModel", 12, 6, 40), ("unknown", "Quiet", 1, 1, 5), path="a/F.swift"
    ).unionByName(make_types(("model", "MonsterModel", 30, 25, 400), path="b/F.swift", project="q"))
    sources = spark.createDataFrame(
        [("p", "a/F.swift", "F.swift", "", None), ("q", "b/F.swift", "F.swift", "", None),
         ("q", "b/Empty.swift", "Empty.swift", "", None), ("q", "b/Bad.swift", "Bad.swift", None, "broken")],
        "project string, path string, file_name string, text string, read_error string",
    )
    return analysis.analyze_extracted(sources, types)


def test_summary_adds_up(run):
    total = run.summary().first().asDict()
    assert total == {
        "total_files": 4, "total_types": 4, "total_issues": 6, "warnings": 4, "infos": 1, "criticals": 1,
    }
    per_project = {r.project: r.asDict() for r in summary.summary_by_project(run.found, run.sources).collect()}
    for name in summary.COUNTERS:
        assert sum(row[name] for row in per_project.values()) == total[name]
    levels = summary.summary_rollup(run.found, run.sources).collect()
    assert sorted(r.level for r in levels) == [0, 0, 0, 0, 1, 1, 2]
    assert [r.total_issues for r in levels if r.level == 2] == [6]


def test_empty_input_gives_zeros(run):
    empty = summary.summary(run.found.where("false"), run.sources.where("false")).first()
    assert set(empty.asDict().values()) == {0}
    assert summary.leaderboard(run.issues.where("false")).count() == 0


def test_leaderboard_and_file_counts(run):
    rows = run.leaderboard().collect()
    assert [(r.path, r.issue_count) for r in rows] == [("a/F.swift", 5), ("b/F.swift", 1)]
    counts = {r.path: r.issue_count for r in summary.issues_per_file(run.issues, run.sources).collect()}
    assert counts == {"a/F.swift": 5, "b/F.swift": 1, "b/Empty.swift": 0, "b/Bad.swift": 0}
    plan = run.leaderboard()._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_file_head_counts_the_rest(run):
    rows = summary.file_head(run.issues, 3).where("path = 'a/F.swift'").orderBy("position").collect()
    assert [(r.type_name, r.rule, r.more) for r in rows] == [
        ("User", "LargeClass", 2), ("User", "HighMethodDensity", 2), ("UserDataModel", "LargeClass", 2),
    ]


def test_heavy_file_is_cut_before_the_exchange(run):
    plan = summary.file_head(run.issues, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.rindex("WindowGroupLimit")


def test_substring_attribution_takes_the_first_match(run):
    found = attribution.attribute(run.issues, run.types, "substring").where("path = 'a/F.swift'").collect()
    assert {(r.type_name, r.matched_name) for r in found} == {("User", "User"), ("UserDataModel", "User")}
    lineage = attribution.attribute(run.issues, run.types).collect()
    assert all(r.matched_name == r.type_name for r in lineage)


def test_substring_attribution_against_brute_force(spark):
    names = ["a", "Ty", "many", "Model", "DataModel", "Data", "ser", "UserDataModel", "z9", "pro(per"]
    types = spark.createDataFrame(
        [("p", f"f{file}", i, name) for file in range(3) for i, name in enumerate(names[file:])],
        "project string, path string, type_ord int, name string",
    )
    messages = ["Type UserDataModel has too many pro(perties (6).", "Class z9 is", "nothing", "", "  \n "]
    issues = spark.createDataFrame(
        [("p", f"f{file}", i, "?", i, message) for file in range(4) for i, message in enumerate(messages)],
        "project string, path string, type_ord int, type_name string, rule_ord int, message string",
    )
    for row in attribution.attribute(issues, types, "substring").collect():
        file = int(row.path[1:])
        own = names[file:] if file < 3 else []
        hits = [name for name in own if name in row.message]
        assert row.matched_name == (hits or own or ["UnknownType"])[0], row


def test_json_records(run, tmp_path):
    lines = [json.loads(r.line) for r in reports.report_json(run.reports()).collect()]
    assert len(lines) == 6 and all(list(line) == ["file", "message", "rule", "severity", "typeName"] for line in lines)
    assert {line["file"] for line in lines} == {"F.swift"}
    out = str(tmp_path / "out")
    with pytest.raises(analysis.StrictReadError):
        analysis.write_json_report(run, out)
    spark = run.issues.sparkSession
    assert spark.read.json(out).count() == 6
    joined = str(tmp_path / "joined")
    analysis.write_json_report(run, joined, strict=False, as_array=True)
    parts = sorted(name for name in os.listdir(joined) if name.endswith(".json"))
    found = json.loads("".join(open(f"{joined}/{name}", encoding="utf-8").read() for name in parts))
    assert [r["message"] for r in found] == [r.message for r in run.issues.orderBy("project", "path", "type_ord", "rule_ord").collect()]
    nothing = analysis.analyze_extracted(run.sources.where("false"), run.types.where("false"))
    analysis.write_json_report(nothing, str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()


def test_diagnostics(run):
    lines = sorted(r.line for r in reports.diagnostic_lines(run.issues, "/src", "audit").collect())
    assert "/src/F.swift:1: warning: [audit] Type User is too large: 11 methods (limit: 10)" in lines
    with_line = run.issues.limit(1).withColumn("line", F.lit(7))
    assert ":7: " in reports.diagnostic_lines(with_line, "/src").first().line
    assert reports.diagnostic_summary(run.summary(), "audit").first().line == (
        "note: [audit] Analysis complete. Found 6 issues in 4 files."
    )


def test_text_report(run, tmp_path):
    lines = reports.file_report_lines(run.tables)
    rows = lines.where("path = 'b/F.swift'").orderBy(*reports.LINE_ORDER).collect()
    assert [r.line for r in rows] == [
        "", "📄 File: F.swift", "-" * 40,
        "📦 Type: MonsterModel [model]", "   Inits: 1 | Accessors: 2 | Subscripts: 0",
        "   Methods: 30 | Properties: 25 | Lines: 400", "   Members Map:", "      - m (Lines 1-2)",
        "",
        "   🔴 Type MonsterModel is a God Object (Major SRP violation). "
        "It exceeds multiple limits: 30 methods, 25 properties, 400 lines.",
    ][: len(rows)]
    out = str(tmp_path / "text")
    reports.write_lines(lines, reports.LINE_ORDER, out)
    assert run.issues.sparkSession.read.text(out).count() == lines.count()


def test_summary_report(run):
    lines = reports.summary_report_lines(run.tables, per_file=3)
    text = [r.line for r in lines.orderBy("section", F.desc("file_issues"), "project", "path", "line_ord").collect()]
    assert text[:4] == ["", "🚨 Files With Issues (Top 10)", "-" * 40, "📄 F.swift"]
    assert "   ...and 2 more issues" in text
    assert text[-8:] == [
        "=" * 40, "📊 Summary", "Files scanned: 4", "Types analyzed: 4", "Total issues: 6",
        "⚠️ Warnings: 4 | ℹ️ Info: 1 | 🔴 Critical: 1", "=" * 40, "",
    ]
    clean = reports.Tables(run.sources, run.found.where("false"), run.issues.where("false"))
    assert "✅ No issues found. Clean code!" in [r.line for r in reports.summary_report_lines(clean).collect()]


def test_custom_reporter(run):
    reporter: reports.Reporter = lambda tables: tables.issues.select(F.upper("rule").alias("line"))
    assert {r.line for r in reporter(run.tables).collect()} >= {"GODOBJECT", "LARGECLASS"}


def test_rules_are_one_narrow_pass(run):
    plan = engine.issues(run.found)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
