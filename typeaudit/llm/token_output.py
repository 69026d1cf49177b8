"""Token ids as binary shards in training order.

Texts are encoded, each with one end, and cut into sequences of ``length`` ids (the last of a task is filled with ends). Sequences are
numbered without gaps; a keyed Feistel permutation over the next even power of two, walked along its cycle until it falls
below the count, gives each number its slot. A range of ``per_shard`` slots is a shard: a file of ids of fixed width, so
a reader resumes anywhere by one seek.

Scale: texts are encoded once and written compressed; their tokens move once, by shard. What is broadcast is one row for each input
partition. Slots are a permutation, so shards are even whatever the sources are. A task writes a shard under a name of its own and
moves it into place, so a lost or repeated task leaves one whole file.

Cases: null and empty texts are one end. A null ``doc_id`` stays null. Repeated rows are written as often as they stand. Columns other
than ``doc_id`` and ``text`` are ignored. An empty table gives no shard.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from typeaudit.llm import scan, tokens
from typeaudit.session import new_shared_path


class Settings(NamedTuple):
    length: int = 2048
    per_shard: int = 4096
    key: int = 20_240_229
    rounds: int = 4
    vocabulary: str = tokens.VOCABULARY


def slots(numbers: np.ndarray, count: int, key: int, rounds: int = 4) -> np.ndarray:
    """Permutation of ``0 .. count - 1``: a balanced Feistel network, walked until the value is in range."""
    half = np.uint64(max(1, ((max(count, 2) - 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = scan.mix(np.arange(1, rounds + 1, dtype=np.uint64) + np.uint64(key * 0x9E3779B97F4A7C15 % (1 << 64)))
    found = numbers.astype(np.uint64)
    walking = np.ones(len(found), bool)
    while walking.any():
        left, right = found[walking] >> half, found[walking] & mask
        for secret in keys:
            left, right = right, left ^ (scan.mix(right ^ secret) & mask)
        found[walking] = (left << half) | right
        walking = found >= count
    return found.astype(np.int64)


#: Sequences are written once and moved once in this form; a twentieth less than at the fastest level.
ZSTD_LEVEL = 12
SEQUENCES = "part int, at long, first_doc long, n_tokens int, ids binary"


def _sequences(batches: Iterator[pa.RecordBatch], settings: Settings) -> Iterator[pa.RecordBatch]:
    part, at, length = TaskContext.get().partitionId(), 0, settings.length
    end = tokens.end_id(settings.vocabulary)
    kind = np.uint16 if end < 1 << 16 else np.uint32
    left, owners = np.empty(0, kind), np.empty(0, np.int64)
    valid = np.empty(0, bool)

    coder = pa.Codec("zstd", compression_level=ZSTD_LEVEL)

    def rows(ids: np.ndarray, owner: np.ndarray, known: np.ndarray, real: int) -> pa.RecordBatch:
        nonlocal at
        count = len(ids) // length
        raw = ids.tobytes()
        stride = length * ids.itemsize
        used = np.full(count, length, np.int32)
        if real:
            used[-1] = real
        found = pa.RecordBatch.from_arrays(
            [pa.array(np.full(count, part, np.int32)), pa.array(np.arange(at, at + count)),
             pa.array(owner[::length], mask=~known[::length]), pa.array(used),
             pa.array([coder.compress(raw[i * stride : (i + 1) * stride], asbytes=True) for i in range(count)], pa.binary())],
            ["part", "at", "first_doc", "n_tokens", "ids"],
        )
        at += count
        return found

    for batch in (part_ for whole in batches for part_ in scan.slices(whole, "text")):
        ids, bounds = tokens.encode(batch.column("text"), settings.vocabulary)
        size = np.diff(bounds)
        joined = np.insert(ids.astype(kind), bounds[1:], end)
        doc = batch.column("doc_id")
        left = np.concatenate((left, joined))
        owners = np.concatenate((owners, np.repeat(doc.fill_null(0).to_numpy(), size + 1)))
        valid = np.concatenate((valid, np.repeat(doc.is_valid().to_numpy(zero_copy_only=False), size + 1)))
        whole = len(left) // length * length
        if whole:
            yield rows(left[:whole], owners[:whole], valid[:whole], 0)
            left, owners, valid = left[whole:], owners[whole:], valid[whole:]
    if len(left):
        filled = np.concatenate((left, np.full(length - len(left), end, kind)))
        yield rows(filled, np.resize(owners, length), np.resize(valid, length), len(left))


INDEX = "slot long, shard long, byte_offset long, first_doc long, n_tokens int, sha256 string"


def _write(batches: Iterator[pa.RecordBatch], folder: str, settings: Settings) -> Iterator[pa.RecordBatch]:
    """Rows of one partition, in the order of their slots, to the files of their shards."""
    system, root = pa.fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
    shard, out, name = None, None, ""

    def close() -> None:
        if out is not None:
            out.close()
            system.move(name, f"{root}/shard-{shard:08d}.bin")

    for batch in batches:
        numbers, places = batch.column("shard").to_pylist(), batch.column("slot").to_pylist()
        digests, offsets = [], []
        for number, slot, packed in zip(numbers, places, batch.column("ids"), strict=True):
            if number != shard:
                close()
                shard, name = number, f"{root}/.shard-{number:08d}-{uuid.uuid4().hex}"
                out = system.open_output_stream(name)
            width = 2 if tokens.end_id(settings.vocabulary) < 1 << 16 else 4
            ids = pa.decompress(packed.as_py(), settings.length * width, "zstd", asbytes=True)
            offsets.append((slot - number * settings.per_shard) * len(ids))
            digests.append(hashlib.sha256(ids).hexdigest())
            out.write(ids)
        yield pa.RecordBatch.from_arrays(
            [batch.column("slot"), batch.column("shard"), pa.array(offsets, pa.int64()), batch.column("first_doc"), batch.column("n_tokens"), pa.array(digests, pa.string())],
            ["slot", "shard", "byte_offset", "first_doc", "n_tokens", "sha256"],
        )
    close()


def materialize_order(docs: DataFrame, folder: str | None = None, settings: Settings = Settings()) -> DataFrame:
    """Writes the shards to ``folder`` when evaluated; a row for each sequence says where it lies.

    Without ``folder`` a new one below the session's shared folder is taken.
    """
    spark = docs.sparkSession
    folder = folder or new_shared_path(spark, "shards")
    system, root = pa.fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
    system.create_dir(root, recursive=True)
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    path = new_shared_path(spark, "sequences")
    chosen.mapInArrow(lambda it: _sequences(it, settings), SEQUENCES).write.option("compression", "none").parquet(path)
    found = spark.read.schema(SEQUENCES).parquet(path)
    parts = found.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # A row for each task that has read texts.
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), "n")
    count = parts.agg(F.sum("n")).first()[0] or 0

    @F.pandas_udf("long")
    def slot_of(numbers: pd.Series) -> pd.Series:
        return pd.Series(slots(numbers.to_numpy(), count, settings.key, settings.rounds))

    placed = (
        found.join(F.broadcast(parts.drop("n")), "part")
        .withColumn("slot", slot_of(F.col("before") + F.col("at")))
        .withColumn("shard", F.floor(F.col("slot") / settings.per_shard))
    )
    shards = -(-count // settings.per_shard) or 1
    ordered = placed.select("shard", "slot", "first_doc", "n_tokens", "ids").repartition(shards, "shard").sortWithinPartitions("shard", "slot")
    return ordered.mapInArrow(lambda it: _write(it, folder, settings), INDEX)


def read_slots(folder: str, slot: int, count: int, settings: Settings = Settings()) -> np.ndarray:
    """``count`` sequences from ``slot`` on, fewer at the end; reads the files that hold them, in order."""
    system, root = pa.fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
    kind = np.uint16 if tokens.end_id(settings.vocabulary) < 1 << 16 else np.uint32
    stride, found = settings.length * np.dtype(kind).itemsize, []
    while count > 0:
        shard, inner = divmod(slot, settings.per_shard)
        name = f"{root}/shard-{shard:08d}.bin"
        if system.get_file_info(name).type == pa.fs.FileType.NotFound:
            break
        with system.open_input_file(name) as file:
            file.seek(inner * stride)
            raw = file.read(min(count, settings.per_shard - inner) * stride)
        if not raw:
            break
        part = np.frombuffer(raw, kind).reshape(-1, settings.length)
        found.append(part)
        slot, count = slot + len(part), count - len(part)
    return np.concatenate(found) if found else np.empty((0, settings.length), kind)
