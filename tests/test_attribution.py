"""Message matching: names with blanks, long words, files whose messages name nothing."""

from typeaudit.operators import attribution
from typeaudit.plans import queries

KEYS = "project string, path string, type_ord int"


def test_substring_mode(spark):
    types = spark.createDataFrame(
        [("p", "a", 0, "User"), ("p", "a", 1, "UserModel"), ("p", "a", 2, "`My Type`"), ("p", "b", 0, "Lone")], f"{KEYS}, name string"
    )
    messages = [
        ("p", "a", 1, 0, "Type UserModel is large"),
        ("p", "a", 2, 0, "Type `My Type` is large"),
        ("p", "a", 1, 1, "nothing here"),
        ("p", "b", 0, 0, "x" * 20_000 + "Lone" + "y" * 20_000),
        ("p", "c", 0, 0, "no types at all"),
    ]
    issues = spark.createDataFrame(messages, f"{KEYS}, rule_ord int, message string").selectExpr("*", "'n' AS type_name")
    found = attribution.attribute(issues, types, "substring").collect()
    # The first type of the file whose name occurs anywhere in the message, else the first one.
    assert {(r.path, r.type_ord, r.rule_ord): (r.matched_ord, r.matched_name) for r in found} == {
        ("a", 1, 0): (0, "User"), ("a", 2, 0): (2, "`My Type`"), ("a", 1, 1): (0, "User"),
        ("b", 0, 0): (0, "Lone"), ("c", 0, 0): (None, attribution.UNKNOWN_TYPE),
    }


def test_types_are_derived_once_for_message_matching(spark):
    for name in ("request_selection_by_name", "attribution_substring"):
        read = queries.REGISTRY[name](spark, "/root/testdata/sf0.001").inputFiles()
        assert read and all("/types-" in file for file in read)


def test_words_shorter_than_all_names_are_left_out(spark):
    rows = [(0, "Type User is large", [4, 9], False), (1, "no", [4], False), (2, "a b", [], False), (3, "`a b` x", [5], True)]
    named = spark.createDataFrame(rows, "i int, message string, sizes array<int>, blanks boolean")
    found = attribution._roomy_words(named, ["i"]).collect()
    assert sorted((r.i, r.word) for r in found) == [(0, "Type"), (0, "User"), (0, "large"), (3, "`a b` x")]
