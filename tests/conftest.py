import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from typeaudit.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        **{
            "spark.master": "local[8]",
            "spark.sql.shuffle.partitions": "2",
            "spark.default.parallelism": "2",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


TYPE_COLUMNS = (
    "project string, path string, file_name string, type_ord int, class_type string, name string, method_count int, "
    "property_count int, line_count int, initializer_count int, subscript_count int, accessor_count int, "
    "members array<struct<name:string,start_line:int,end_line:int>>"
)


@pytest.fixture
def make_types(spark):
    """Rows of (category, name, methods, properties, lines), all in one file."""

    def make(*rows, path="a/F.swift", project="p"):
        full = [
            (project, path, path.split("/")[-1], i, category, name, methods, properties, lines, 1, 0, 2, [("m", 1, 2)])
            for i, (category, name, methods, properties, lines) in enumerate(rows)
        ]
        return spark.createDataFrame(full, TYPE_COLUMNS)

    return make


@pytest.fixture
def make_sources(spark):
    def make(**texts):
        rows = [("p", f"{name}.swift", f"{name}.swift", text, None) for name, text in texts.items()]
        return spark.createDataFrame(
            rows, "project string, path string, file_name string, text string, read_error string"
        )

    return make
