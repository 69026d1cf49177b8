"""The array document: order, framing, and what a failure leaves."""

import json
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from typeaudit.sinks import documents

ORDER = ["project", "number"]


def document(path):
    names = sorted(n for n in os.listdir(path) if n.endswith(".json"))
    return json.loads("".join(open(f"{path}/{n}", encoding="utf-8").read() for n in names)), names


def test_one_document_in_order(spark, tmp_path):
    # One project holds nearly all records; the parts cut it.
    rows = spark.range(3000).select(
        F.when(F.col("id") % 10 == 0, "a").otherwise("hot").alias("project"), F.col("id").alias("number"),
        F.concat(F.lit('tricky ",\n[{} é '), F.col("id")).alias("message"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("line"),
    ).repartition(7)
    path = str(tmp_path / "out")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        documents.write_array(rows, path, ORDER)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    found, names = document(path)
    want = sorted(range(3000), key=lambda i: (i % 10 != 0, i))
    assert [r["message"] for r in found] == [f'tricky ",\n[{{}} é {i}' for i in want]
    assert [r.get("line") for r in found] == [None if i % 2 else i for i in want] and list(found[0]) == ["line", "message"]
    manifest = json.load(open(f"{path}/{documents.MANIFEST}"))
    assert manifest["files"] == names and manifest["records"] == 3000 and len(names) > 3
    assert not [n for n in os.listdir(path) if n.startswith("_staged")]
    assert documents.read_array(spark, path, "line long, message string").count() == 3000


def test_no_record_is_an_empty_array(spark, tmp_path):
    rows = spark.createDataFrame([], "project string, number long, message string")
    documents.write_array(rows, str(tmp_path / "out"), ORDER)
    assert document(tmp_path / "out")[0] == []


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    rows = spark.range(1000).select(F.lit("p").alias("project"), F.col("id").alias("number"))
    broken = F.when(F.col("number") == 900, F.raise_error(F.lit("lost"))).otherwise(F.lit("fine"))
    path = tmp_path / "out"
    lines = rows.repartition(5, "number").select(broken.cast("string").alias("line"))
    spark.dataSource.register(documents.JsonArray)
    with pytest.raises(Exception, match="lost"):
        lines.write.format(documents.FORMAT).mode("append").save(str(path))
    assert not path.exists()
    with pytest.raises(ValueError, match="no committed"):
        documents.read_array(spark, str(path), "message string")


def test_a_task_that_outlives_its_job_leaves_nothing(tmp_path, monkeypatch):
    class Context:
        partitionId = taskAttemptId = lambda self: 4

    monkeypatch.setattr(documents.TaskContext, "get", lambda: Context())
    path = tmp_path / "out"
    writer = documents.JsonArray({"path": str(path)}).writer(T.StructType([T.StructField("line", T.StringType())]), False)
    batch = pa.RecordBatch.from_arrays([pa.array(["{}"])], ["line"])

    def given_up_meanwhile():
        yield batch
        writer.abort([])
        yield batch

    writer.write(given_up_meanwhile())
    assert list(tmp_path.iterdir()) == []
    with pytest.raises(FileNotFoundError):
        writer.write(iter([batch]))
    assert list(tmp_path.iterdir()) == []


def test_a_document_is_not_replaced(spark, tmp_path):
    rows = spark.createDataFrame([("p", 1, "m")], "project string, number long, message string")
    documents.write_array(rows, str(tmp_path / "out"), ORDER)
    with pytest.raises(Exception, match="exists already"):
        documents.write_array(rows, str(tmp_path / "out"), ORDER)
    assert document(tmp_path / "out")[0] == [{"message": "m"}]
