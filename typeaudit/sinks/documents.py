"""One JSON array over many part files, in the order of emission, committed at once.

Tasks write records in parallel, each to a staged part of its own. The commit gives the parts their final names and puts the array's
brackets and the commas between parts beside them, as files of a few bytes. Read in the order of names, the files are one JSON document
(``cat path/*.json``, ``hdfs dfs -getmerge``); no task and no driver ever holds it. The manifest comes last: a folder without one is
no document. A task that fails, or is run twice, leaves nothing behind: the folder of staged parts is made before the tasks start and only
then, so a task that still runs when the job is given up has nowhere to write (in a store without folders it may leave a staged part).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from typeaudit.sources import listing

FORMAT = "json_array"
MANIFEST = "_SUCCESS"
OPEN, BETWEEN, CLOSE = b"[\n", b",\n", b"\n]\n"


@dataclass
class Part(WriterCommitMessage):
    """What a task staged: the number of its partition, the file's name, and how much it holds."""

    partition: int
    name: str
    n_records: int
    n_bytes: int


def _put(system, path: str, content: bytes) -> None:
    with system.open_output_stream(path) as stream:
        stream.write(content)


class ArrayWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path
        self.staged = f"_staged-{uuid.uuid4().hex}"

    def _folders(self):
        system, folder = listing.opened(self.path)
        folder = folder.rstrip("/")
        return system, folder, f"{folder}/{self.staged}"

    def prepare(self) -> None:
        system, _, staged = self._folders()
        system.create_dir(staged, recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        """The partition's records, with commas between them. An empty partition has no file."""
        system, _, staged = self._folders()
        context = TaskContext.get()
        part = Part(context.partitionId(), f"{context.partitionId()}-{context.taskAttemptId()}", 0, 0)
        stream = None
        try:
            for batch in iterator:
                # A null is no record.
                lines = [line.encode() for line in batch.column(0).to_pylist() if line is not None]
                if not lines:
                    continue
                if stream is None:
                    stream = system.open_output_stream(f"{staged}/{part.name}")
                content = (BETWEEN if part.n_records else b"") + BETWEEN.join(lines)
                stream.write(content)
                part.n_records += len(lines)
                part.n_bytes += len(content)
        finally:
            if stream is not None:
                stream.close()
        return part

    def commit(self, messages: list[Part | None]) -> None:
        """Partitions are numbered in the order of the records."""
        system, folder, staged = self._folders()
        system.create_dir(folder, recursive=True)
        parts = sorted((m for m in messages if m is not None and m.n_records), key=lambda m: m.partition)
        width = len(str(2 * len(parts) + 1))
        files = []
        for number, part in enumerate(parts):
            frame, body = (f"part-{2 * number + k:0{width}d}.json" for k in (0, 1))
            _put(system, f"{folder}/{frame}", BETWEEN if number else OPEN)
            system.move(f"{staged}/{part.name}", f"{folder}/{body}")
            files += [frame, body]
        last = f"part-{2 * len(parts):0{width}d}.json"
        _put(system, f"{folder}/{last}", CLOSE if parts else OPEN + CLOSE.lstrip())
        self._drop(system, staged)
        found = {"files": [*files, last], "records": sum(p.n_records for p in parts), "bytes": sum(p.n_bytes for p in parts)}
        _put(system, f"{folder}/{MANIFEST}", json.dumps(found).encode())

    def abort(self, messages: list[Part | None]) -> None:
        """The folder was empty before, so all that is in it is this job's."""
        from pyarrow import fs

        system, folder, _ = self._folders()
        if system.get_file_info(folder).type == fs.FileType.Directory:
            # Under its new name no task that still runs can add to the folder; stores without folders cannot rename it.
            given_up = f"{folder.rpartition('/')[0]}/_given-up-{uuid.uuid4().hex}"
            try:
                system.move(folder, given_up)
            except NotImplementedError:
                given_up = folder
            self._drop(system, given_up)

    @staticmethod
    def _drop(system, folder: str) -> None:
        from pyarrow import fs

        if system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)


class JsonArray(DataSource):
    """``df.write.format("json_array").mode("append").save(path)`` of one string column of JSON texts, as they are partitioned and sorted."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "line string"

    def writer(self, schema: StructType, overwrite: bool) -> ArrayWriter:
        from pyarrow import fs

        path = self.options["path"]
        if [field.dataType.typeName() for field in schema.fields] != ["string"]:
            raise ValueError("the document is written from one column of strings")
        system, folder = listing.opened(path)
        if overwrite or system.get_file_info(folder.rstrip("/")).type != fs.FileType.NotFound:
            raise ValueError(f"{path} exists already, or was to be replaced; a document is written once")
        writer = ArrayWriter(path)
        writer.prepare()
        return writer


def write_array(records: DataFrame, path: str, order: list[str]) -> None:
    """``records`` as one array, by ``order``; these columns are not part of a record. Keys are sorted, absent values left out.

    Ranges are cut by all columns of ``order``, so a file or project with most of the records is spread over tasks; records that
    are equal in all of them stand in any order. Without a record the array is empty.
    """
    records.sparkSession.dataSource.register(JsonArray)
    record = F.to_json(F.struct(*sorted(c for c in records.columns if c not in order)))
    placed = records.select(*order, record.alias("line")).repartitionByRange(*order).sortWithinPartitions(*order)
    placed.select("line").write.format(FORMAT).mode("append").save(path)


def read_array(spark, path: str, schema: str) -> DataFrame:
    """The records of a committed document. A record is one line: JSON texts of Spark hold no line breaks."""
    from pyarrow import fs

    system, folder = listing.opened(path)
    if system.get_file_info(f"{folder.rstrip('/')}/{MANIFEST}").type != fs.FileType.File:
        raise ValueError(f"{path} has no committed document")
    lines = spark.read.text(f"{path}/*.json").where("value LIKE '{%'")
    return lines.select(F.from_json(F.regexp_replace("value", ",$", ""), schema).alias("record")).select("record.*")
