import pandas as pd
import pytest
from pyspark.sql import functions as F

from typeaudit.operators import cascade, heuristics, provider, requests, responses, sections, summary
from typeaudit.plans import analysis

ISSUES = (
    "project string, path string, file_name string, type_ord int, type_name string, rule_ord int, rule string, "
    "severity string, message string, line int"
)
REQUESTS = "request_id string, rule string, type_name string, severity string"
ADVICE = f"{REQUESTS}, diagnosis string, model_source string, suggested_refactor string"


def issue_rows(spark, *rows):
    full = [
        ("p", "F.swift", "F.swift", type_ord, name, i, rule, severity, f"Class {name}", None)
        for i, (type_ord, name, rule, severity) in enumerate(rows)
    ]
    return spark.createDataFrame(full, ISSUES)


def test_one_request_per_type_highest_severity(spark):
    issues = issue_rows(
        spark, (0, "Demo", "InfoRule", "info"), (0, "Demo", "WarnRule", "warning"), (0, "Demo", "CriticalRule", "critical"),
        (0, "Demo", "LateCritical", "critical"), (1, "Worker", "WorkerWarn", "warning"), (2, "Calm", "Hint", "info"),
    )
    assert {r.rule for r in summary.best_per_type(issues).collect()} == {"CriticalRule", "WorkerWarn"}


def test_cap_per_file_and_snippet(make_types, spark):
    types = make_types(*[("model", f"M{i}Model", 11 if i % 2 else 21, 1, 30) for i in range(8)])
    sources = spark.createDataFrame(
        [("p", "a/F.swift", "F.swift", "l1\nl2\nl3", None)],
        "project string, path string, file_name string, text string, read_error string",
    )
    run = analysis.analyze_extracted(sources, types)
    rows = run.requests(maximum=5, snippet_lines=2).orderBy("request_rank").collect()
    assert [(r.type_ord, r.severity) for r in rows] == [
        (0, "critical"), (2, "critical"), (4, "critical"), (6, "critical"), (1, "warning"),
    ]
    assert rows[0].snippet == "l1\nl2"
    assert requests.select_requests(run.found, None).count() == 8
    with pytest.raises(ValueError):
        requests.select_requests(run.found, -1)


@pytest.fixture
def context(spark):
    return spark.createDataFrame(
        [("1", "LargeClass", "Demo", "warning", "Demo issue", 20, 200, 1, 0, 2, [("foo", 1, 3)], "class Demo { }"),
         ("2", "LargeClass", None, "critical", "Lost", None, None, None, None, None, None, "x")],
        f"{REQUESTS}, message string, method_count int, line_count int, initializer_count int, subscript_count int, "
        "accessor_count int, members array<struct<name:string,start_line:int,end_line:int>>, snippet string",
    )


def test_prompts(context):
    standard, lost = [r.prompt for r in requests.with_prompt(context).orderBy("request_id").collect()]
    assert standard == (
        "You are a senior Swift architect.\nAnalyze this finding and provide concise, actionable refactor guidance.\n\n"
        "Rule: LargeClass\nSeverity: ⚠️\nIssue message: Demo issue\nType: Demo\n\n"
        "Structural Profile:\n- Initializers: 1\n- Computed Properties (Accessors): 2\n- Subscripts: 0\n- Methods: 20\n"
        "- Total Lines: 200\n\nMember Map (Relative line ranges):\n  - foo (Lines 1-3)\n\n"
        "Code Snippet:\nclass Demo { }\n\n"
        "Return:\n1) Root cause (1-2 lines)\n2) Refactor steps (3-5 bullets)\n3) Quick win (1 bullet)"
    )
    assert "Type: UnknownType\n\n\n\nCode Snippet:\nx" in lost
    compact = requests.with_prompt(context, compact=True).orderBy("request_id").first().prompt
    assert compact.startswith("You are a Swift refactoring assistant.\nRule: LargeClass\nSeverity: ⚠️\nMessage: Demo issue\n")
    assert not any(text in compact for text in ("senior", "Root cause", "Refactor steps", "Quick win"))


def advice(spark, request_id, diagnosis, text, kind=None):
    return spark.createDataFrame(
        [(request_id, "LargeClass", "Demo", "warning", diagnosis, "source", text, kind)], f"{ADVICE}, error_kind string"
    )


LONG = "A long and explicit recommendation that has more than fifty characters."


@pytest.mark.parametrize(
    "preferred, cloud, fallback, expected",
    [
        (("ok", LONG, None), ("cloud", LONG, None), ("fallback", LONG, None), "ok"),
        (("weak", "too short", None), ("cloud", LONG, None), ("fallback", LONG, None), "cloud"),
        (("weak", "too short", None), None, ("fallback", LONG, None), "fallback"),
        (("a Stub", LONG, None), None, ("fallback", LONG, None), "fallback"),
        ((None, None, "localUnavailable"), None, ("fallback", LONG, None), "fallback"),
        ((None, None, "timeout"), (None, None, "requestFailed"), ("fallback", "x", None), "fallback"),
        ((None, None, "timeout"), None, (None, None, "timeout"), heuristics.STATIC_DIAGNOSIS),
        ((None, None, "timeout"), None, None, heuristics.STATIC_DIAGNOSIS),
    ],
)
def test_local_first(spark, preferred, cloud, fallback, expected):
    asked = spark.createDataFrame([("1", "LargeClass", "Demo", "warning")], REQUESTS)
    tiers = [tier and advice(spark, "1", *tier) for tier in (preferred, fallback, cloud)]
    assert [r.diagnosis for r in cascade.local_first(asked, *tiers).collect()] == [expected]


def test_cloud_first(spark):
    asked = spark.createDataFrame([("1", "LargeClass", None, "warning")], REQUESTS)
    cloud, failed = advice(spark, "1", "cloud", "x"), advice(spark, "1", None, None, "timeout")
    assert cascade.cloud_first(asked, cloud, None).first().diagnosis == "cloud"
    assert cascade.cloud_first(asked, failed, advice(spark, "1", "fallback", "y")).first().diagnosis == "fallback"
    static = cascade.cloud_first(asked, None, None).first()
    assert (static.type_name, static.model_source) == ("UnknownType", heuristics.STATIC_SOURCE)


def test_heuristics(spark):
    asked = spark.createDataFrame(
        [("1", "GodObject", "Big", "critical"), ("2", "HighMethodDensity", None, "warning")], REQUESTS
    )
    big, dense = heuristics.local_advice(asked, "m").orderBy("request_id").collect()
    assert big.suggested_refactor.startswith("1) Root Cause: Big is handling too many")
    assert big.model_source == "Local Heuristics (m Engine)" and big.diagnosis == "Analysis of GodObject violation."
    assert dense.type_name == "Type"
    assert dense.suggested_refactor.endswith("(Single Responsibility Principle) for Type.")
    retry = heuristics.local_advice(asked, "m", after_failure=True).first()
    assert retry.model_source == "Local Heuristics (Fallback from m)"
    joined = heuristics.augmented_advice(asked, F.lit("model text"), "x.mlmodelc").orderBy("request_id").first()
    assert joined.suggested_refactor.startswith("model text\n\n1) Root Cause: Big")


def section_lists(spark, text):
    row = sections.with_sections(spark.createDataFrame([("1", text)], "request_id string, suggested_refactor string")).first()
    return row.root_cause, row.refactor_steps, row.quick_win


def test_sections(spark):
    god = heuristics.ADVICE["GodObject"] % "Big"
    assert section_lists(spark, god) == (
        [],
        [
            "Extract networking logic into a Service class.",
            "Move property-heavy state into a specialized Model or ViewModel.",
            "Use a Coordinator for navigation logic.",
        ],
        [],
    )
    text = "intro\n**Root Cause**\n- a `b`\n\n  \n* c - d\nQUICK WIN: root cause here\ne\r\nf\n## quick win\n• g\nrefactor steps\n"
    assert section_lists(spark, text) == (["a b", "c d", "e\r\nf"], [], ["g"])
    assert section_lists(spark, "") == ([], [], [])


def test_advice_reports(spark):
    loose = "\n".join(f"line **{i}**" for i in range(10))
    rows = spark.createDataFrame(
        [("1", "GodObject", "Big", "critical", " `d` ", "src", "Root cause\n- x\nQuick win\n- y"),
         ("2", "LargeClass", "T", "warning", "d", "src", loose)],
        ADVICE,
    )
    structured, compact = [r.report for r in sections.advice_report(rows).orderBy("request_id").collect()]
    assert structured == (
        "🔴 Critical [GodObject]\nType       : Big\nModel      : src\nDiagnosis  : d\n\n"
        "Root Cause\n- x\n\nQuick Win\n- y\n"
    )
    assert compact.split("\n")[5:] == [
        "Suggestion", *[f"- line {i}" for i in range(8)], sections.MORE_HINT, "",
    ]
    verbose = sections.advice_report(rows, verbose=True).orderBy("request_id").collect()[1].report.split("\n")
    assert verbose[5:] == [
        "Suggestion", *[f"- line {i}" for i in range(10)], "", "Raw AI Output", *[f"line {i}" for i in range(10)], "",
    ]


def test_responses_and_retries(spark):
    log = spark.createDataFrame(
        [
            ("ok", 1, 200, '{"choices":[{"message":{"content":"hi"}}]}', None),
            ("number", 1, 200, '{"choices":[{"message":{"content":5}}]}', None),
            ("empty", 1, 200, '{"choices":[]}', None),
            ("junk", 1, 200, "<html>", None),
            ("busy", 2, 429, '{"error":{"message":" slow down "}}', None),
            ("busy", 3, 503, "overload", None),
            ("denied", 1, 403, None, None),
            ("offline", 1, None, None, "URL_ERROR -1009: offline"),
            ("odd", 1, None, None, "URL_ERROR -999: cancelled"),
        ],
        "request_id string, attempt int, status int, body string, error string",
    )
    chat = responses.extract_chat(log)
    by_id = {(r.request_id, r.attempt): (r.answer, r.error_kind, r.error_message) for r in chat.collect()}
    assert by_id["ok", 1] == ("hi", None, None)
    assert {by_id[name, 1][1] for name in ("number", "empty")} == {"invalidResponse"}
    assert by_id["junk", 1][1:] == ("requestFailed", responses.CHAT_ERROR + responses.NOT_JSON)
    assert by_id["busy", 2][2] == 'Ollama HTTP 429: {"error":{"message":" slow down "}}'
    assert by_id["denied", 1][2] == "Ollama HTTP 403: <empty>"
    assert by_id["offline", 1][2] == "Ollama Error: URL_ERROR -1009: offline"
    parsed = responses.extract_content(log)
    by_id = {(r.request_id, r.attempt): (r.answer, r.error_kind, r.error_message) for r in parsed.collect()}
    assert {by_id[name, 1][1] for name in ("ok", "number", "empty", "junk")} == {"invalidResponse"}
    assert by_id["busy", 2][2] == "HTTP 429: slow down"
    assert by_id["denied", 1][2] == "HTTP 403: <empty>"
    triage = {(r.request_id, r.attempt): (r.retryable, r.retry, r.backoff_seconds) for r in responses.retry_triage(parsed).collect()}
    assert triage["busy", 2] == (True, True, 2.0)
    assert triage["busy", 3] == (True, False, None)
    assert triage["offline", 1] == (True, True, 1.0)
    assert triage["denied", 1] == triage["odd", 1] == triage["junk", 1] == (False, False, None)
    final = {r.request_id: r.attempt for r in responses.final_attempts(parsed).collect()}
    assert final["busy"] == 3 and len(final) == 8
    content = spark.createDataFrame(
        [("g", 1, 200, '{"candidates":[{"content":{"parts":[{"text":"yes"}]}}]}', None)], log.schema
    )
    assert responses.extract_content(content).first().answer == "yes"


def test_failed_requests_drop_out_of_the_advice(spark):
    asked = spark.createDataFrame(
        [("ok", "R", "T", "warning"), ("bad", "R", None, "critical"), ("lost", "R", None, "critical")], REQUESTS
    )
    log = spark.createDataFrame(
        [("ok", 1, 200, '{"choices":[{"message":{"content":"hi"}}]}', None), ("bad", 1, 500, "no", None)],
        "request_id string, attempt int, status int, body string, error string",
    )
    given = responses.chat_advice(asked, responses.extract_chat(log), "m")
    assert [tuple(r) for r in responses.good_advice(given).collect()] == [
        ("ok", "R", "T", "warning", responses.CHAT_DIAGNOSIS, "Local (Ollama: m)", "hi")
    ]
    failed = responses.failed_advice(given)
    text = responses.error_text(F.col("error_kind"), F.col("error_message"))
    assert {r.request_id: r.t for r in failed.select("request_id", text.alias("t")).collect()} == {
        "bad": "AI request failed: Ollama HTTP 500: no", "lost": "AI request timed out."
    }


def test_provider_plugin(spark, context):
    def echo(batch: pd.DataFrame) -> pd.DataFrame:
        failed = batch["type_name"].isna()
        return pd.DataFrame(
            {
                "request_id": batch["request_id"],
                "diagnosis": "echo",
                "model_source": "test",
                "suggested_refactor": batch["prompt"].str.slice(0, 7),
                "error_kind": failed.map({True: "invalidResponse", False: None}),
            }
        )

    rows = provider.ask(requests.with_prompt(context), echo).orderBy("request_id").collect()
    assert [(r.suggested_refactor, r.error_kind) for r in rows] == [("You are", None), ("You are", "invalidResponse")]
