import pytest
from pyspark.sql import functions as F

from typeaudit.functions import severity as sev
from typeaudit.operators import engine
from typeaudit.operators import rules as R
from typeaudit.operators.classify import category


def findings(types, rules=R.DEFAULT_RULES, settings=None, suppress=True):
    rows = engine.issues(engine.evaluate(types, rules, settings, suppress)).orderBy("type_ord", "rule_ord").collect()
    return [(r.type_name, r.rule, r.severity) for r in rows]


@pytest.mark.parametrize(
    "row, rule, settings, expected",
    [
        (("unknown", "TestClass", 4, 1, 10), R.LargeClass, R.Settings(largeClass=(True, 3)), "warning"),
        (("model", "TestData", 1, 3, 10), R.DataHeavyClass, R.Settings(dataHeavyClass=(True, 2)), "info"),
        (("viewController", "MyVC", 20, 5, 200), R.LargeClass, None, None),
        (("model", "MyModel", 21, 2, 50), R.LargeClass, None, "critical"),
        (("model", "AtLimit", 20, 2, 50), R.LargeClass, None, "warning"),
        (("viewController", "OneSignal", 50, 5, 100), R.GodObject, None, None),
        (("viewController", "TwoSignals", 45, 25, 100), R.GodObject, None, "critical"),
        (("service", "SmallMethods", 20, 2, 40), R.HighMethodDensity, None, "warning"),
        (("viewController", "Huge", 30, 5, 500), R.HighMethodDensity, None, None),
        (("unknown", "Short", 15, 0, 19), R.HighMethodDensity, None, None),
        (("unknown", "Roomy", 11, 0, 166), R.HighMethodDensity, None, None),
        (("unknown", "JustDense", 11, 0, 165), R.HighMethodDensity, None, "warning"),
        (("unknown", "NoMethods", 0, 0, 100), R.HighMethodDensity, R.Settings(highMethodDensity=(True, -1)), None),
        (("model", "Configured", 11, 0, 10), R.LargeClass, R.Settings(largeClass=(True, 99)), "warning"),
    ],
)
def test_single_rules(make_types, row, rule, settings, expected):
    found = findings(make_types(row), [rule], settings)
    assert [severity for _, _, severity in found] == ([expected] if expected else [])


def test_god_object_suppresses_only_structural_findings(make_types):
    types = make_types(("model", "MonsterModel", 30, 25, 400), ("model", "DenseModel", 30, 25, 300))
    assert findings(types) == [
        ("MonsterModel", "GodObject", "critical"),
        ("DenseModel", "HighMethodDensity", "critical"),
        ("DenseModel", "GodObject", "critical"),
    ]
    assert len(findings(types, suppress=False)) == 7


def test_anti_join_form_agrees(make_types):
    types = make_types(
        ("model", "A", 30, 25, 400), ("model", "B", 30, 2, 30), ("unknown", "C", 1, 9, 9), ("service", "D", 26, 13, 300)
    )
    raw = engine.issues(engine.evaluate(types, suppress=False))
    left = {tuple(r) for r in engine.suppress_redundant(raw).collect()}
    right = {tuple(r) for r in engine.analyze_types(types).collect()}
    assert left == right and right


def test_messages(make_types):
    types = make_types(
        ("viewController", "MainAppViewController", 41, 21, 14),
        ("unknown", "Wide", 11, 6, 700),
    )
    messages = [r.message for r in engine.analyze_types(types).orderBy("type_ord", "rule_ord").collect()]
    assert messages == [
        "Type MainAppViewController is a God Object (Major SRP violation). "
        "It exceeds multiple limits: 41 methods, 21 properties.",
        "Type Wide is too large: 11 methods (limit: 10), 700 lines (limit: 300)",
        "Type Wide has too many properties (6).",
    ]


def test_disabled_rules_and_custom_rule(make_types):
    types = make_types(("model", "MonsterModel", 30, 25, 400))
    settings = R.Settings(godObject=(False, None), highMethodDensity=(False, None))
    assert [rule for _, rule, _ in findings(types, settings=settings)] == ["LargeClass", "DataHeavyClass"]
    custom = R.Rule("NoInit", lambda s: R.finding("NoInit", F.col("initializer_count") > 0, sev.INFO, F.col("name")))
    assert ("MonsterModel", "NoInit", "info") in findings(types, [*R.DEFAULT_RULES, custom])


@pytest.mark.parametrize(
    "name, expected",
    [
        ("MyViewControllerModel", "viewController"), ("userVIEWMODEL", "viewModel"), ("DataManager", "service"),
        ("AnalyticsService", "service"), ("UserDataModel", "model"), ("User", "unknown"),
    ],
)
def test_category(spark, name, expected):
    assert spark.range(1).select(category(F.lit(name)).alias("c")).first().c == expected


def test_severity_mappings(spark):
    df = spark.createDataFrame([("info",), ("warning",), ("critical",)], "s string").select(
        sev.rank(F.col("s")), sev.emoji(F.col("s")), sev.label(F.col("s")), sev.diagnostic_level(F.col("s"))
    )
    assert [tuple(r) for r in df.collect()] == [
        (0, "ℹ️", "Info", "note"),
        (1, "⚠️", "Warning", "warning"),
        (2, "\U0001f534", "Critical", "error"),
    ]
