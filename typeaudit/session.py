"""Session defaults, and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The bytes of rows that Spark hands to a Python worker at once. Its own bound, 64 MB, is held several times over outside the
#: heap: in the vectors, in the stream to the worker and in the worker.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

# AQE sizes reduce tasks, splits skewed join partitions and turns a shuffled join
# into a broadcast one only after the real size of a side is known.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    # Lets the listing of files skip folders that no row of a query can lie in.
    "spark.sql.python.filterPushdown.enabled": "true",
    BATCH_BYTES: str(4 << 20),
    # Call-site tracking of every column expression; costs more than building the plans.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "typeaudit", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def bound_batches(spark: SparkSession) -> None:
    """Bound the batches of a session that says nothing about them; Spark reads the setting when a plan runs."""
    if BATCH_BYTES not in spark.conf.getAll:
        spark.conf.set(BATCH_BYTES, DEFAULTS[BATCH_BYTES])


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder of this machine.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="typeaudit-")
    context.setCheckpointDir(folder)
    return folder


def new_shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def remove_shared_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that :func:`new_shared_path` named."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def materialize(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder, in folders by the column ``by`` if one is given, and read it back.

    For a table that several reports read (the extracted types): the work is done once and
    a lost executor costs a re-read of its splits, not a new extraction.
    """
    spark = df.sparkSession
    path = new_shared_path(spark, label)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(written: DataFrame) -> None:
    """Delete what :func:`materialize` wrote for ``written``; nothing may read it any more."""
    for folder in {file.rsplit("/", 1)[0] for file in written.inputFiles()}:
        remove_shared_path(written.sparkSession, folder)
