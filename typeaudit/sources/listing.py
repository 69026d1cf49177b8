"""Listing of source files as a data source, and reading of what it lists.

The driver opens only as many folders as there should be tasks; the tasks walk what lies below. A folder that is ignored is never entered, and
one that no row of the query can lie in (filters on project and on the beginning of the path are pushed here) isn't either. The rows are
names, so files can be dealt out evenly before a byte of them is read, wherever they lie.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, StringStartsWith
from pyspark.sql.types import StructType

FORMAT = "source_listing"
COLUMNS = "project string, path string, relative_path string, n_bytes long, root string, read_error string"

NOT_LISTED = "folder could not be listed"
NOT_READ = "file could not be read"
TOO_LARGE = "file is larger than {} bytes"

#: A text must fit in a row.
MAX_BYTES = (1 << 31) - (1 << 20)
#: Bytes of contents handed on at once.
_BATCH_BYTES = 16 << 20


def opened(folder: str):
    """Arrow's file system of a folder, and the path in it. ``s3a`` is Hadoop's name of ``s3``."""
    from pyarrow import fs

    return fs.FileSystem.from_uri("s3" + folder[3:] if folder.startswith("s3a://") else folder)


def _inside(system, folder: str) -> Iterator[tuple[str, bool, int | None, str | None]]:
    """Path, whether it is a folder, size, and error of what lies in a folder. What is neither file nor folder is not opened."""
    from pyarrow import fs

    if system.type_name != "local":
        for entry in system.get_file_info(fs.FileSelector(folder)):
            is_file = entry.type == fs.FileType.File
            is_folder = entry.type == fs.FileType.Directory
            yield entry.path, is_folder, entry.size if is_file else None, None if is_file or is_folder else NOT_READ
        return
    with os.scandir(folder) as entries:
        for entry in entries:
            # Links to folders may lead in circles; they are not followed.
            if entry.is_dir():
                if not entry.is_symlink():
                    yield entry.path, True, None, None
            elif entry.is_file():
                yield entry.path, False, entry.stat().st_size, None
            else:
                yield entry.path, False, None, NOT_READ


class Folders(InputPartition):
    """Folders of one root that a task walks. ``deep`` ones with all below, the others only for the files in them."""

    def __init__(self, project: str, root: str, folders: list[tuple[str, bool]]):
        super().__init__((project, root, tuple(folders)))


class ListingReader(DataSourceReader):
    def __init__(self, options: dict):
        self.roots: dict[str, str] = json.loads(options["roots"])
        self.ignored = frozenset(json.loads(options.get("ignored", "[]")))
        self.suffix = options.get("suffix", "")
        self.absolute = options.get("absolute", "false") == "true"
        self.tasks = int(options.get("tasks", "64"))
        self.prefixes: dict[str, list[str]] = {"path": [], "relative_path": []}
        self.projects: list[frozenset[str]] = []

    def pushFilters(self, filters):
        """Beginnings of paths prune folders and are tested again by the planner; projects are decided here."""
        for one in filters:
            column = one.attribute[0] if len(getattr(one, "attribute", ())) == 1 else None
            if column == "project" and isinstance(one, EqualTo | In):
                self.projects.append(frozenset([one.value] if isinstance(one, EqualTo) else one.value))
                continue
            if column in self.prefixes and isinstance(one, StringStartsWith | EqualTo):
                self.prefixes[column].append(one.value)
            yield one

    def _may_hold(self, folder: str, base: str) -> bool:
        """Can anything below the folder begin with the prefixes asked for?"""
        inside = folder[len(base) + 1 :]
        for column, name in (("path", folder), ("relative_path", inside)):
            for prefix in self.prefixes[column]:
                if not (f"{name}/".startswith(prefix) or prefix.startswith(f"{name}/") or not name):
                    return False
        return True

    def _entries(self, system, folder: str, base: str, others: frozenset[str]):
        """Folders to enter, and files with their size or what is wrong with them, in order of names."""
        folders, found = [], []
        for path, is_folder, size, problem in sorted(_inside(system, folder)):
            name = path.rsplit("/", 1)[-1]
            if name.startswith(".") or name in self.ignored:
                continue
            if is_folder:
                # A root inside a root lists itself.
                if path not in others and self._may_hold(path, base):
                    folders.append(path)
            elif name.endswith(self.suffix):
                found.append((path, size, problem))
        return folders, found

    def _wanted(self):
        for project, root in sorted(self.roots.items()):
            if all(project in names for names in self.projects):
                system, base = opened(root)
                base = base.rstrip("/")
                if not (self.absolute and self.ignored.intersection(base.split("/"))):
                    yield project, root, system, base

    def _others(self, base: str) -> frozenset[str]:
        paths = {opened(root)[1].rstrip("/") for root in self.roots.values()}
        return frozenset(paths - {base})

    def partitions(self):
        """Breadth first, until there is a folder for each task."""
        from pyarrow import fs

        found = []
        for project, root, system, base in self._wanted():
            if system.get_file_info(base).type != fs.FileType.Directory:
                raise ValueError(f"{root} is no folder")
            units, level, others = [], [base], self._others(base)
            while level and len(level) + len(found) < self.tasks:
                below = []
                for folder in level:
                    units.append((folder, False))
                    try:
                        below += self._entries(system, folder, base, others)[0]
                    except OSError:
                        # The task that lists it reports it.
                        continue
                level = below
            units += [(folder, True) for folder in level]
            found += [Folders(project, root, [unit]) for unit in units]
        return found or [Folders("", "", [])]

    def read(self, partition: Folders):
        project, root, folders = partition.value
        if not folders:
            return
        system, base = opened(root)
        base = base.rstrip("/")
        others = self._others(base)
        for start, deep in folders:
            waiting = [start]
            while waiting:
                folder = waiting.pop()
                try:
                    below, found = self._entries(system, folder, base, others)
                except OSError:
                    yield project, folder, folder[len(base) + 1 :], None, root, NOT_LISTED
                    continue
                if deep:
                    waiting += reversed(below)
                for path, size, problem in found:
                    yield project, path, path[len(base) + 1 :], size, root, problem


class Listing(DataSource):
    """``spark.read.format("source_listing")`` with the options ``roots`` (JSON, project to folder), ``ignored`` (JSON, names),
    ``suffix``, ``absolute`` (are folders above a root tested too?) and ``tasks``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema: StructType) -> ListingReader:
        return ListingReader(self.options)


def list_sources(
    spark: SparkSession, roots: dict[str, str], ignored: list[str], suffix: str, absolute: bool = False, tasks: int | None = None
) -> DataFrame:
    """Names of the files below ``roots``; a folder that cannot be listed is a row with ``read_error``."""
    spark.dataSource.register(Listing)
    options = {
        "roots": json.dumps(roots), "ignored": json.dumps(list(ignored)), "suffix": suffix, "absolute": str(absolute).lower(),
        "tasks": str(tasks or 2 * spark.sparkContext.defaultParallelism),
    }
    return spark.read.format(FORMAT).options(**options).load()


def _contents(batches: Iterator[pa.RecordBatch], max_bytes: int, opened: Callable) -> Iterator[pa.RecordBatch]:
    systems: dict[str, object] = {}

    def content_of(root: str, path: str, size: int | None) -> tuple[bytes | None, str | None]:
        if size is not None and size > max_bytes:
            return None, TOO_LARGE.format(max_bytes)
        try:
            if root not in systems:
                systems[root] = opened(root)[0]
            with systems[root].open_input_stream(path, compression=None) as stream:
                content = stream.read(max_bytes + 1)
        except Exception:  # whatever a file system raises, it concerns this file alone
            return None, NOT_READ
        return (None, TOO_LARGE.format(max_bytes)) if len(content) > max_bytes else (content, None)

    for batch in batches:
        column = {name: batch.column(name).to_pylist() for name in batch.schema.names}
        rows = list(zip(column["project"], column["path"], column["relative_path"], column["n_bytes"], column["root"], column["read_error"], strict=True))
        held, size = [], 0
        for project, path, inside, n_bytes, root, failed in rows:
            content, problem = (None, failed) if failed is not None else content_of(root, path, n_bytes)
            held.append((project, path, inside, content, problem))
            size += len(content or b"")
            if size >= _BATCH_BYTES:
                yield _rows(held)
                held, size = [], 0
        yield _rows(held)


def _rows(held: list[tuple]) -> pa.RecordBatch:
    names = ["project", "path", "relative_path", "content", "read_error"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.binary(), pa.string()]
    columns = list(zip(*held, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def read_listed(listed: DataFrame, max_bytes: int = MAX_BYTES, partitions: int | None = None, opened: Callable = opened) -> DataFrame:
    """``project, path, relative_path, content, read_error``: the files of a listing, dealt out by path.

    What cannot be read, or is larger than ``max_bytes``, has no content but an error; the others are read all the same.
    """
    spark = listed.sparkSession
    # A number of one's own: names are too small for the planner to deal them by size.
    count = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    columns = "project string, path string, relative_path string, content binary, read_error string"
    return listed.repartition(count, "path").mapInArrow(lambda it: _contents(it, max_bytes, opened), columns)
