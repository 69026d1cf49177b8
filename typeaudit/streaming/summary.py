"""Running summary over files that keep arriving."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from typeaudit.functions import severity as sev
from typeaudit.operators import engine, extract
from typeaudit.operators import rules as R
from typeaudit.operators.summary import COUNTERS, file_counters
from typeaudit.schema import FILE_KEY
from typeaudit.session import remove_shared_path


def file_stream(spark: SparkSession, root: str, suffix: str = ".swift") -> DataFrame:
    """Source files below ``root`` as a stream of ``path, content`` rows."""
    return (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", f"*{suffix}")
        .load(root)
        .select("path", "content")
    )


def type_totals(found: DataFrame) -> DataFrame:
    """Counters over a stream (or table) of evaluated types; use output mode ``complete``.

    Rules are row expressions, so they run on the stream itself and the only state is one row.
    """
    return found.agg(
        F.count("*").alias("total_types"),
        F.coalesce(F.sum(engine.count_by_severity(found)), F.lit(0)).alias("total_issues"),
        F.coalesce(F.sum(engine.count_by_severity(found, sev.WARNING)), F.lit(0)).alias("warnings"),
        F.coalesce(F.sum(engine.count_by_severity(found, sev.INFO)), F.lit(0)).alias("infos"),
        F.coalesce(F.sum(engine.count_by_severity(found, sev.CRITICAL)), F.lit(0)).alias("criticals"),
    )


#: Batches after which the state is written as one table again.
COMPACT_EVERY = 16


def start_summary(
    sources: DataFrame,
    out: str,
    checkpoint: str,
    rules: Sequence[R.Rule] = R.DEFAULT_RULES,
    settings: R.Settings | None = None,
    available_now: bool = True,
    version: str | None = None,
    compact_every: int = COMPACT_EVERY,
    partitions: int | None = None,
) -> StreamingQuery:
    """Analyze each micro-batch of a ``sources`` stream and bring the counters in ``out`` up to date.

    The state is a table of counters by file, ``out/state``, in a folder for each batch; the newest row of a file counts. A file
    that comes again replaces what it gave before: the totals change by the difference. Of several rows of a file in one
    batch the one with the greatest ``version`` counts, and with the greatest text where that is equal or not given.

    A batch meets only the state of its own files. Replayed, it starts from the batches before and overwrites its folders, so every
    file counts exactly once, also after a restart. Every ``compact_every`` batches the state is written as one table and what it
    replaces is removed; of the totals two folders are kept. ``partitions`` deals the texts of a batch out, where they
    arrive in fewer parts than there are cores.
    """
    spark = sources.sparkSession
    shape = ", ".join(f"{name} bigint" for name in COUNTERS)
    spark.createDataFrame([[0] * len(COUNTERS)], shape).write.mode("ignore").parquet(f"{out}/totals/batch=-1")
    state = ", ".join(["project string", "path string", shape])
    spark.createDataFrame([], state).write.mode("ignore").parquet(f"{out}/state/batch=-1")

    def analyze(batch: DataFrame, batch_id: int) -> None:
        rows = newest_rows(batch, version)
        found = engine.evaluate(extract.extract_types(rows, partitions), rules, settings)
        own_path = f"{out}/state/batch={batch_id}"
        file_counters(found, rows).write.mode("overwrite").parquet(own_path)
        own = spark.read.schema(state).parquet(own_path)
        known = spark.read.schema(state + ", batch bigint").parquet(f"{out}/state").where(F.col("batch") < batch_id)
        earlier = newest_state(known.join(own.select(*FILE_KEY), [*FILE_KEY], "left_semi"))
        change = _sums(own), _sums(earlier)
        before = _latest(spark, out, batch_id).first()
        total = [before[name] + change[0][name] - change[1][name] for name in COUNTERS]
        spark.createDataFrame([total], shape).coalesce(1).write.mode("overwrite").parquet(f"{out}/totals/batch={batch_id}")
        _remove_before(spark, f"{out}/totals", batch_id - 1)
        if batch_id % compact_every == compact_every - 1:
            merged = newest_state(known.unionByName(own.withColumn("batch", F.lit(batch_id).cast("bigint"))))
            staged = f"{out}/merged-{batch_id}"
            merged.write.mode("overwrite").parquet(staged)
            spark.read.schema(state).parquet(staged).write.mode("overwrite").parquet(own_path)
            remove_shared_path(spark, staged)
        elif batch_id % compact_every == 0:
            # The merge of the batch before is complete once this batch runs.
            _remove_before(spark, f"{out}/state", batch_id - 1)

    writer = sources.writeStream.foreachBatch(analyze).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def newest_rows(batch: DataFrame, version: str | None = None) -> DataFrame:
    """One row for each file. Only the texts of files that come several times in the batch move."""
    again = batch.groupBy(*FILE_KEY).count().where("count > 1").select(*FILE_KEY)
    if again.isEmpty():
        return batch
    rank = [F.col(version)] if version else []
    newest = F.max_by(F.struct(*batch.columns), F.struct(*rank, "text")).alias("newest")
    several = batch.join(again, [*FILE_KEY], "left_semi").groupBy(*FILE_KEY).agg(newest).select("newest.*")
    return batch.join(again, [*FILE_KEY], "left_anti").select(batch.columns).unionByName(several.select(batch.columns))


def newest_state(rows: DataFrame) -> DataFrame:
    """The counters of each file from its last batch."""
    counters = F.max_by(F.struct(*COUNTERS), "batch").alias("newest")
    return rows.groupBy(*FILE_KEY).agg(counters).select(*FILE_KEY, "newest.*")


def _sums(rows: DataFrame) -> Row:
    return rows.agg(*[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in COUNTERS]).first()


def _latest(spark: SparkSession, out: str, before: int | None = None) -> DataFrame:
    rows = spark.read.parquet(f"{out}/totals")
    if before is not None:
        rows = rows.where(F.col("batch") < before)
    return rows.agg(*[F.max_by(name, "batch").alias(name) for name in COUNTERS])


def _remove_before(spark: SparkSession, path: str, batch_id: int) -> None:
    """Remove the folders of batches before ``batch_id``; a replay reads no others."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in system.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith("batch=") and int(name.removeprefix("batch=")) < batch_id:
            system.delete(status.getPath(), True)


def summary_so_far(spark: SparkSession, out: str) -> DataFrame:
    """The counters of all files seen by :func:`start_summary`."""
    return _latest(spark, out)


def files_so_far(spark: SparkSession, out: str) -> DataFrame:
    """The counters of each file, from its newest version."""
    return newest_state(spark.read.parquet(f"{out}/state"))
