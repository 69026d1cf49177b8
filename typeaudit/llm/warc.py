"""WARC archives of fetched pages: deterministic sharded writer, committed by a manifest, and a reader.

1. The order of records is page_id, payload digest, url. A narrow table without payloads is sorted in ranges; the bytes before each record
   cut the order into shards of ``shard_bytes`` of payload. What is kept of that is the first key of each shard, so shards follow from
   the rows, not from the number of tasks or the sampled ranges.
2. Of records with equal payloads of at least ``min_bytes``, the last in the order is the response; a notice for each of the others names it.
3. Pages and notices are dealt to their shards and sorted. A task merges them: a notice stands before the pages it is for, which
   become revisits. Each record is a gzip member of its own, and a file ends when it holds ``file_bytes`` compressed. Headers, lengths and digests
   are made anew from the payload; identifiers follow from the key, dates from the settings, so equal rows give equal files.
4. Files have names of their own until the rows that describe them are written as a table (the manifest). Then each is moved to its final
   name. A lost, repeated or speculative task leaves files that no manifest names; their folder is removed.

Scale: a payload moves once, to its shard; all else is done on rows of some hundred bytes. Groups of equal payloads are counted by partial
sums of digests, and only digests found more than once are joined, so a page that a third of all rows hold is no hot task. What tasks get of the shards
is one key of 57 characters for each ``shard_bytes`` of payload, a millionth of the input. A task holds one record at a time, and the
reader too. Rows equal in page_id, url and payload share a shard.

Cases: null html is an empty payload, and empty payloads are equal payloads. A null page_id is smaller than any. Rows equal in page_id, url and
payload: one is the response, the others revisit it. A null url leaves its header out; control characters and blanks in one are percent-encoded.
Other columns are ignored. An empty table gives an empty manifest and no row.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from typeaudit.session import materialize, new_shared_path


class Settings(NamedTuple):
    #: Payload bytes of a shard, about.
    shard_bytes: int = 64 << 20
    #: Compressed bytes at which a file is full.
    file_bytes: int = 8 << 20
    #: Smaller payloads are always responses.
    min_bytes: int = 0
    #: WARC-Date of all records; part of the files, so no clock.
    date: str = "2024-01-01T00:00:00Z"
    level: int = 6


# The format's version, profile and content types.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_RESPONSE = b"application/http; msgtype=response"
FIELDS = b"application/warc-fields"

_PLACED = "key string, before long, n_bytes long, range int"
_MANIFEST = "shard long, file int, name string, temporary string, n_records long, n_bytes long, sha256 string"
_RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _system(folder: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")


def sha1(data: bytes) -> bytes:
    return base64.b32encode(hashlib.sha1(data).digest())


# --- writer ------------------------------------------------------------------------------


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the bytes before each row in this range, and the range's number."""
    part, total = TaskContext.get().partitionId(), 0
    for batch in batches:
        sizes = batch.column("n_bytes").to_numpy()
        sums = total + sizes.cumsum()
        arrays = [batch.column("key"), pa.array(sums - sizes), batch.column("n_bytes"), pa.array([part] * batch.num_rows, pa.int32())]
        yield pa.RecordBatch.from_arrays(arrays, ["key", "before", "n_bytes", "range"])
        total = int(sums[-1]) if batch.num_rows else total


def _identifier(name: str) -> bytes:
    return f"<urn:uuid:{uuid.UUID(hashlib.sha256(name.encode()).hexdigest()[:32])}>".encode()


def _uri(url: str) -> bytes:
    """Without what would end or split a header."""
    return b"".join(b"%%%02X" % c if c <= 32 or c == 127 else bytes([c]) for c in url.encode())


def record(headers: list[tuple[bytes, bytes]], block: bytes) -> bytes:
    lines = [VERSION, *[name + b": " + value for name, value in headers]]
    lines += [b"WARC-Block-Digest: sha1:" + sha1(block), b"Content-Length: %d" % len(block), b"", b""]
    return b"\r\n".join(lines) + block + b"\r\n\r\n"


def _head(kind: bytes, identifier: bytes, content: bytes, settings: Settings) -> list[tuple[bytes, bytes]]:
    return [
        (b"WARC-Type", kind), (b"WARC-Record-ID", identifier), (b"WARC-Date", settings.date.encode()), (b"Content-Type", content)
    ]


def _name(key: str, url: str | None, copy: int) -> str:
    """What a record is identified by; ``copy`` tells apart records of equal key and url."""
    return f"record {key} {copy} {'-' if url is None else '+' + url}"


class Notice(NamedTuple):
    """The response of a group of equal payloads."""

    page_id: int | None
    key: str
    url: str | None


def page_record(row: dict, copy: int, response: Notice | None, settings: Settings) -> bytes:
    """A page as a response, or as a revisit of ``response``."""
    payload = row["payload"] or b""
    digest = sha1(payload)
    headers = _head(b"response" if response is None else b"revisit", _identifier(_name(row["key"], row["url"], copy)), HTTP_RESPONSE, settings)
    if row["url"] is not None:
        headers.append((b"WARC-Target-URI", _uri(row["url"])))
    headers.append((b"WARC-Payload-Digest", b"sha1:" + digest))
    if row["page_id"] is not None:
        headers.append((b"WARC-Page-ID", b"%d" % row["page_id"]))
    if response is not None:
        headers += [(b"WARC-Profile", REVISIT_PROFILE), (b"WARC-Refers-To", _identifier(_name(response.key, response.url, 0)))]
        if response.page_id is not None:
            headers.append((b"WARC-Refers-To-Page-ID", b"%d" % response.page_id))
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    return record(headers, block + (payload if response is None else b""))


def _member(data: bytes, level: int) -> bytes:
    coder = zlib.compressobj(level, zlib.DEFLATED, 31)
    return coder.compress(data) + coder.flush()


class _Archive:
    """A file under a name of its own."""

    def __init__(self, folder: str, shard: int, number: int, settings: Settings):
        self.system, root = _system(folder)
        self.shard, self.number, self.records, self.bytes, self.sum = shard, number, 0, 0, hashlib.sha256()
        self.name = f"{shard:08d}-{number:04d}.warc.gz"
        self.temporary = f"{uuid.uuid4().hex}-{self.name}"
        self.out = self.system.open_output_stream(f"{root}/.writing/{self.temporary}", compression=None)
        info = b"software: typeaudit\r\nformat: WARC File Format 1.1\r\n"
        head = _head(b"warcinfo", _identifier(f"file {self.name}"), FIELDS, settings)
        self.add(record([*head, (b"WARC-Filename", self.name.encode())], info), settings)
        self.records = 0

    def add(self, data: bytes, settings: Settings) -> None:
        packed = _member(data, settings.level)
        self.out.write(packed)
        self.sum.update(packed)
        self.records, self.bytes = self.records + 1, self.bytes + len(packed)

    def close(self) -> dict:
        self.out.close()
        return {
            "shard": self.shard, "file": self.number, "name": self.name, "temporary": self.temporary,
            "n_records": self.records, "n_bytes": self.bytes, "sha256": self.sum.hexdigest(),
        }


_FILES = pa.schema(
    [("shard", pa.int64()), ("file", pa.int32()), ("name", pa.string()), ("temporary", pa.string()),
     ("n_records", pa.int64()), ("n_bytes", pa.int64()), ("sha256", pa.string())]
)


def _write(batches: Iterator[pa.RecordBatch], folder: str, settings: Settings) -> Iterator[pa.RecordBatch]:
    """Sorted pages and notices to files; a row for each file."""
    archive, at, copy, notice = None, None, 0, None
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: column[i].as_py() for name, column in zip(batch.schema.names, batch.columns, strict=True)}
            if at != (row["key"], row["url"]):
                at, copy, notice = (row["key"], row["url"]), 0, None
            if row["notice"] is not None:
                notice = Notice(**row["notice"])
                continue
            if archive is None or archive.shard != row["shard"] or archive.bytes >= settings.file_bytes:
                number = 0
                if archive is not None:
                    yield pa.RecordBatch.from_pylist([archive.close()], _FILES)
                    number = archive.number + 1 if archive.shard == row["shard"] else 0
                archive = _Archive(folder, row["shard"], number, settings)
            is_it = notice is not None and (notice.key, notice.url) == at and copy == 0
            archive.add(page_record(row, copy, None if is_it else notice, settings), settings)
            copy += 1
    if archive is not None:
        yield pa.RecordBatch.from_pylist([archive.close()], _FILES)


def _commit(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Moves the files of the manifest to their names. A repeated task finds them moved."""
    system, root = _system(folder)
    for batch in batches:
        for temporary, name in zip(batch.column("temporary").to_pylist(), batch.column("name").to_pylist(), strict=True):
            source = f"{root}/.writing/{temporary}"
            if system.get_file_info(source).type != pa.fs.FileType.NotFound:
                system.move(source, f"{root}/{name}")
        yield batch


def _keyed(pages: DataFrame) -> DataFrame:
    """``page_id, url, payload, n_bytes, key``; keys sort by page_id, nulls first, then by digest."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    taken = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    number = F.lpad(F.hex(F.col("page_id").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    key = F.concat(F.when(F.col("page_id").isNull(), "0" * 17).otherwise(F.concat(F.lit("1"), number)), F.sha1("payload"))
    return taken.withColumns({"n_bytes": F.octet_length("payload").cast("long"), "key": key})


def shard_starts(narrow: DataFrame, settings: Settings) -> list[str]:
    """The first key of each shard but the first, in order. A shard begins where a multiple of ``shard_bytes`` does."""
    # The salt deals equal keys over several ranges.
    salted = narrow.select("key", "n_bytes").withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))
    in_order = salted.repartitionByRange("key", "salt").sortWithinPartitions("key", "salt").select("key", "n_bytes")
    placed = materialize(in_order.mapInArrow(_placed, _PLACED), "warc-order")
    ranges = placed.groupBy("range").agg(F.sum("n_bytes").alias("bytes"))
    so_far = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # A row for each sorted range.
    starts = ranges.select("range", F.coalesce(F.sum("bytes").over(so_far), F.lit(0)).alias("earlier"))
    shard = F.floor((F.col("earlier") + F.col("before")) / settings.shard_bytes)
    first = placed.join(starts, "range").groupBy(shard.alias("shard")).agg(F.min("key").alias("key"))
    return sorted({row.key for row in first.where("shard > 0").select("key").collect()})


def notices(narrow: DataFrame, settings: Settings) -> DataFrame:
    """``key, url, notice`` for each page of a group of equal payloads."""
    payload = [F.substring("key", 18, 40).alias("digest"), "n_bytes"]
    members = narrow.where(F.col("n_bytes") >= settings.min_bytes).select("key", "url", "page_id", *payload)
    last = F.max(F.struct("key", "url", "page_id")).alias("last")
    shared = members.groupBy("digest", "n_bytes").agg(last, F.count("*").alias("held")).where("held > 1").drop("held")
    each = members.select("key", "url", "digest", "n_bytes").distinct().join(shared, ["digest", "n_bytes"])
    return each.select("key", "url", F.struct("last.page_id", "last.key", "last.url").alias("notice"))


def write(pages: DataFrame, folder: str | None = None, settings: Settings = Settings()) -> str:
    """Writes ``pages(page_id, url, html)`` as archives below ``folder``, which is returned.

    Without ``folder`` a new one below the session's shared folder is taken. The manifest is the table ``manifest`` in it.
    """
    spark = pages.sparkSession
    folder = folder or new_shared_path(spark, "warc")
    system, root = _system(folder)
    system.create_dir(f"{root}/.writing", recursive=True)
    keyed = _keyed(pages)
    narrow = materialize(keyed.drop("payload"), "warc-keys")
    starts = np.array([key.encode() for key in shard_starts(narrow, settings)], dtype="S57")

    @F.pandas_udf("long")
    def shard_of(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(starts, keys.to_numpy().astype("S57"), side="right"))

    no_notice, no_page = F.lit(None).cast("struct<page_id:long,key:string,url:string>"), F.lit(None)
    rows = keyed.select("key", "url", "page_id", "payload", no_notice.alias("notice")).unionByName(
        notices(narrow, settings).select("key", "url", no_page.cast("long").alias("page_id"), no_page.cast("binary").alias("payload"), "notice")
    )
    dealt = rows.withColumn("shard", shard_of("key")).repartition("shard")
    in_order = dealt.sortWithinPartitions("shard", "key", F.col("url").asc_nulls_first(), F.col("notice").isNull())
    written = materialize(in_order.mapInArrow(lambda it: _write(it, folder, settings), _MANIFEST), "warc-files")
    written.mapInArrow(lambda it: _commit(it, folder), _MANIFEST).drop("temporary").write.parquet(f"{folder}/manifest")
    system.delete_dir(f"{root}/.writing")
    return folder


# --- reader ------------------------------------------------------------------------------


#: Files that a task reads, about.
_FILES_A_TASK = 4


class Broken(ValueError):
    """An archive isn't what its manifest or its own digests say."""


def _chunks(stream, size: int = 1 << 18) -> Iterator[bytes]:
    while data := stream.read(size):
        yield data


def members(stream, name: str) -> Iterator[bytes]:
    """The uncompressed gzip members of a file, one at a time."""
    coder, parts = zlib.decompressobj(31), []
    for data in _chunks(stream):
        while data:
            parts.append(coder.decompress(data))
            data = coder.unused_data
            if coder.eof:
                yield b"".join(parts)
                coder, parts = zlib.decompressobj(31), []
    if b"".join(parts):
        raise Broken(f"{name} ends inside a record")


def parse(data: bytes, name: str) -> tuple[dict[bytes, bytes], bytes]:
    """Headers by lower-cased name, and the block, whose length and digest must be as stated."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not mark or lines[0] != VERSION:
        raise Broken(f"{name} holds a record without a version")
    headers = {}
    for line in lines[1:]:
        key, _, value = line.partition(b":")
        headers[key.strip().lower()] = value.strip()
    size = int(headers[b"content-length"])
    block = rest[:size]
    if rest[size:] != b"\r\n\r\n" or headers[b"warc-block-digest"] != b"sha1:" + sha1(block):
        raise Broken(f"{name} holds a record that differs from its digest")
    return headers, block


def _page(headers: dict[bytes, bytes], block: bytes, name: str) -> dict:
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = headers[b"warc-payload-digest"].removeprefix(b"sha1:")
    kind = headers[b"warc-type"].decode()
    if kind == "response" and stated != sha1(payload):
        raise Broken(f"{name} holds a payload that differs from its digest")
    sizes = [line.split(b":")[1] for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")]
    whole = {key: int(headers[key]) if key in headers else None for key in (b"warc-page-id", b"warc-refers-to-page-id")}
    return {
        "page_id": whole[b"warc-page-id"],
        "url": headers[b"warc-target-uri"].decode() if b"warc-target-uri" in headers else None,
        "payload_bytes": int(sizes[0]), "payload_digest": stated.decode(), "record_type": kind,
        "refers_to": whole[b"warc-refers-to-page-id"] if kind == "revisit" else None,
    }


def _read(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    system, root = _system(folder)
    schema = pa.schema(
        [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
         ("record_type", pa.string()), ("refers_to", pa.int64())]
    )
    for batch in batches:
        for name, want in zip(batch.column("name").to_pylist(), batch.column("n_records").to_pylist(), strict=True):
            found, count = [], 0
            with system.open_input_stream(os.path.join(root, name), compression=None) as stream:
                for data in members(stream, name):
                    headers, block = parse(data, name)
                    if headers[b"warc-type"] == b"warcinfo":
                        continue
                    found.append(_page(headers, block, name))
                    count += 1
                    if len(found) == 4096:
                        yield pa.RecordBatch.from_pylist(found, schema)
                        found = []
            if count != want:
                raise Broken(f"{name} holds {count} records; its manifest says {want}")
            if found:
                yield pa.RecordBatch.from_pylist(found, schema)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/manifest")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The page records of the archives that the manifest names; each file is read by one task, record by record.

    ``payload_bytes`` and ``payload_digest`` are those of the full payload, for revisits too.
    """
    files = read_manifest(spark, folder).select("name", "n_records")
    # By number, since the rows are too small to be dealt by size.
    tasks = -(-files.count() // _FILES_A_TASK) or 1
    return files.repartition(tasks).mapInArrow(lambda it: _read(it, folder), _RECORDS)
