import os

from pyspark.sql import functions as F

from typeaudit.operators import engine
from typeaudit.sources import files
from typeaudit.streaming import summary as stream


def test_running_summary_over_arriving_files(spark, tmp_path):
    root, out, checkpoint = (str(tmp_path / name) for name in ("src", "out", "checkpoint"))
    os.makedirs(root)

    def add(name, methods):
        body = "\n".join(f"  func m{i}() {{}}" for i in range(methods))
        (tmp_path / "src" / name).write_text(f"class Big {{\n{body}\n}}\n")

    def run():
        arriving = files.decode(stream.file_stream(spark, root)).select(
            F.lit("p").alias("project"), "path", F.lit("f").alias("file_name"), "text", "read_error"
        )
        stream.start_summary(arriving, out, checkpoint).awaitTermination()
        row = stream.summary_so_far(spark, out).first()
        return row.total_files, row.total_types, row.total_issues, row.criticals

    assert run() == (0, 0, 0, 0)
    add("A.swift", 12)
    add("B.swift", 3)
    assert run() == (2, 2, 1, 0)
    add("C.swift", 25)
    # Only the new file is read; the counters of the earlier ones stay.
    assert run() == (3, 3, 3, 2)
    assert run() == (3, 3, 3, 2)
    for number in range(4):
        add(f"D{number}.swift", 12)
        assert run() == (4 + number, 4 + number, 4 + number, 2)
    assert len([name for name in os.listdir(f"{out}/totals") if name.startswith("batch=")]) == 2


def test_a_replayed_batch_counts_once(spark, tmp_path):
    root, out = tmp_path / "src", str(tmp_path / "out")
    root.mkdir()
    (root / "A.swift").write_text("class A {}")
    arriving = files.decode(stream.file_stream(spark, str(root))).select(
        F.lit("p").alias("project"), "path", F.lit("f").alias("file_name"), "text", "read_error"
    )
    for checkpoint in ("first", "again"):
        # A new checkpoint gives the same batch the same number, as a restart before its commit does.
        stream.start_summary(arriving, out, str(tmp_path / checkpoint)).awaitTermination()
        assert stream.summary_so_far(spark, out).first().total_files == 1


def test_a_file_that_comes_again_replaces_its_counters(spark, tmp_path):
    """Against the newest version of each file after every batch, over several merges of the state; batches are replayed too."""
    root, out = str(tmp_path / "src"), str(tmp_path / "out")
    shape = "project string, path string, file_name string, text string, read_error string, stamp int"
    os.makedirs(root)
    newest, stamp = {}, 0

    def text(methods):
        return "class Big {\n" + "".join(f"  func m{i}() {{}}\n" for i in range(methods)) + "}\n"

    def add(*rows):
        nonlocal stamp
        stamp += 1
        found = [("p", path, path, None if methods is None else text(methods), None, 10 * stamp + order) for order, (path, methods) in enumerate(rows)]
        newest.update({path: methods for path, methods in rows})
        spark.createDataFrame(found, shape).coalesce(1).write.mode("append").parquet(root)

    def run(checkpoint="c"):
        arriving = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(root)
        stream.start_summary(arriving, out, str(tmp_path / checkpoint), version="stamp", compact_every=2).awaitTermination()
        row = stream.summary_so_far(spark, out).first()
        readable = {path: methods for path, methods in newest.items() if methods is not None}
        assert (row.total_files, row.total_types) == (len(newest), len(readable))
        assert row.total_issues == sum((m > 10) + (m > 20) for m in readable.values())
        kept = {r.path: r.total_types for r in stream.files_so_far(spark, out).collect()}
        assert kept == {path: int(methods is not None) for path, methods in newest.items()}

    add(("A", 25), ("B", 3))
    run()
    add(("A", 2), ("C", 12))
    run()
    # Two versions in one batch, a file that can no longer be read, and one that is as it was.
    add(("B", 30), ("B", 11), ("C", None), ("A", 2))
    run()
    add(("C", 21))
    add(("A", 12))
    run()
    assert len([name for name in os.listdir(f"{out}/state") if name.startswith("batch=")]) <= 3


def test_rules_run_on_a_stream_of_types(spark, make_types, tmp_path):
    types = make_types(("model", "MonsterModel", 30, 25, 400), ("unknown", "Quiet", 1, 1, 5))
    types.write.parquet(str(tmp_path / "types"))
    found = engine.evaluate(spark.readStream.schema(types.schema).parquet(str(tmp_path / "types")))
    query = (
        stream.type_totals(found).writeStream.format("memory").queryName("totals").outputMode("complete")
        .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    row = spark.table("totals").first()
    assert (row.total_types, row.total_issues, row.criticals) == (2, 1, 1)
