"""Removal of repeated byte strings, by suffix order of sharded text.

A string of ``window`` bytes is repeated if it starts anywhere else, in the same text or another. Each window belongs
to its anchor, the leftmost of its ``core``-byte strings with the least hash; equal windows have equal anchors at equal
places, so windows are compared only with those of the same anchor string:

1. every text gives its anchors, each with the run of windows it stands for (one window, one anchor);
2. anchor strings that occur once end there; runs that occur twice as a whole are repeated as a whole;
3. one copy of every other run goes to the shard of its anchor string. A shard puts its suffixes in order by external
   induced sorting (``induced.py``); neighbours with ``window`` common bytes are repeated;
4. the repeated windows go back to the texts that hold them, and the bytes they cover are removed.

Scale: steps 1 and 2 move some 30 bytes for each 70 bytes of text, and counts are partial sums, so copies of one text or a passage
in a third of all rows reduce before they move. Step 3 holds distinct runs only, in
shards kept small enough for memory: beyond their bounds queues and arrays go to disk, but other arrays stay in memory. An anchor string with very many distinct runs, such as a line that a third of all texts hold,
would make a shard that more machines don't shorten: its windows are hashed one by one and counted by partial sums instead.
A text is never split, nor are two compared.

Cases: null and empty texts have no bytes. Texts shorter than the window keep all. Repeated rows are texts like others:
each repeats the other. Overlapping repeats inside one text count. All columns of the input stay in ``row``, so their names cannot
clash. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from typeaudit.llm import induced, scan
from typeaudit.session import materialize


class Settings(NamedTuple):
    window: int = 200
    core: int = 64
    #: Bytes of runs in a shard, about.
    shard_bytes: int = 2 << 20
    #: Distinct runs of one anchor string that a shard takes; more are compared window by window.
    shard_runs: int = 20_000


ANCHORS = "rid long, low int, high int, key long, run long"
SEPARATOR = 257


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, from running minimums of blocks."""
    count = len(values) - width + 1
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    square = padded.reshape(blocks, width)
    before = np.minimum.accumulate(square, axis=1).reshape(-1)
    after = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(after[:count], before[width - 1 : width - 1 + count])


def anchors(data: np.ndarray, offsets: np.ndarray, settings: Settings) -> tuple[np.ndarray, ...]:
    """Text, first and last window (places in the text), anchor hash and run hash, for each anchor."""
    window, core = settings.window, settings.core
    first, text = scan.windows(offsets, window)
    if not len(first):
        return tuple(np.empty(0, np.int64) for _ in range(5))
    sums = scan.prefix_sums(data)
    places = np.arange(len(data) - core + 1)
    hashes = scan.range_hashes(sums, places, places + core)
    # A hash and its place in one number: the least is the leftmost of equal ones.
    bits = np.uint64(int(len(data)).bit_length())
    ranked = (hashes >> bits << bits) | places.astype(np.uint64)
    at = (_sliding_least(ranked, window - core + 1)[first] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    begin, length = scan.runs(at)
    low, high, place, owner = first[begin], first[begin + length - 1], at[begin], text[begin]
    run = scan.mix(scan.range_hashes(sums, low, high + window) + (place - low).astype(np.uint64))
    return owner, low - offsets[owner], high - offsets[owner], hashes[place].view(np.int64), run.view(np.int64)


def _anchors(batches: Iterator[pa.RecordBatch], settings: Settings) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in scan.slices(whole, "text")):
        owner, low, high, key, run = anchors(*scan.texts(batch.column("text")), settings)
        yield pa.RecordBatch.from_arrays(
            [batch.column("rid").take(pa.array(owner)), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32)), pa.array(key), pa.array(run)],
            ["rid", "low", "high", "key", "run"],
        )


def _cut_runs(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted runs of each text."""
    for batch in (part for whole in batches for part in scan.slices(whole, "text")):
        data, offsets = scan.texts(batch.column("text"))
        wanted = batch.column("wanted")
        parents = pc.list_parent_indices(wanted).to_numpy(zero_copy_only=False)
        flat = wanted.flatten()
        low, high = (flat.field(name).to_numpy() for name in ("low", "high"))
        begin, end = offsets[parents] + low, offsets[parents] + high + window
        bounds = np.concatenate(([0], np.cumsum(end - begin)))
        held = data[np.arange(bounds[-1]) - np.repeat(bounds[:-1] - begin, end - begin)]
        pieces = pa.Array.from_buffers(
            pa.binary(), len(begin), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(held))]
        )
        yield pa.RecordBatch.from_arrays([flat.field("key"), flat.field("run"), flat.field("twice"), pieces], ["key", "run", "twice", "piece"])


REPEATED = "key long, run long, spans array<struct<low:int,high:int>>"
_SPANS = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))


def _shard(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Repeated windows of the runs of one partition."""
    chunks, sizes, keys, runs, twice = [], [], [], [], []
    for batch in batches:
        data, offsets = scan.texts(batch.column("piece"))
        size = np.diff(offsets)
        piece = np.full(len(data) + len(size), SEPARATOR, np.int16)
        shift = np.repeat(np.arange(len(size)), size)
        piece[np.arange(len(data)) + shift] = data.astype(np.int16) + 1
        part = induced.array(len(piece), np.int16)
        part[:] = piece
        chunks.append(part)
        sizes.append(size)
        for held, name in ((keys, "key"), (runs, "run"), (twice, "twice")):
            held.append(batch.column(name).to_numpy(zero_copy_only=False))
    if not chunks:
        return
    size, key, run, double = (np.concatenate(x) for x in (sizes, keys, runs, twice))
    text = induced.array(int(sum(map(len, chunks))) + 1, np.int16)
    fill = 0
    for part in chunks:
        text[fill : fill + len(part)] = part
        fill += len(part)
    del chunks
    begin = np.concatenate(([0], np.cumsum(size + 1)))[:-1]
    order, common = induced.suffix_order(text, window)
    heads = np.flatnonzero(common < window)
    group_size = np.diff(np.append(heads, len(order)))
    repeated = induced.array(len(text), np.bool_)
    for at in range(0, len(order), 1 << 20):
        # The group of each place is the last head at or before it.
        here = np.arange(at, min(at + (1 << 20), len(order)))
        repeated[order[here]] = group_size[np.searchsorted(heads, here, side="right") - 1] > 1
    for low in range(0, len(size), 1 << 12):
        high = min(low + (1 << 12), len(size))
        spans = []
        for i in range(low, high):
            count = size[i] - window + 1
            flags = np.ones(count, bool) if double[i] else repeated[begin[i] : begin[i] + count]
            edges = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).astype(np.int8)))
            spans.append([{"low": int(b), "high": int(e) - 1} for b, e in zip(edges[::2], edges[1::2], strict=True)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(key[low:high]), pa.array(run[low:high]), pa.array(spans, _SPANS)], ["key", "run", "spans"]
        )


_WINDOWS = "key long, run long, at int, copies int, h0 long, h1 long"


def _windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Every window of each run, by two hashes: of all its bytes and of its first half."""
    for batch in (part for whole in batches for part in scan.slices(whole, "piece", scan.SLICE_BYTES >> 2)):
        data, offsets = scan.texts(batch.column("piece"))
        first, owner = scan.windows(offsets, window)
        sums = scan.prefix_sums(data)
        taken = pa.array(owner)
        copies = np.where(batch.column("twice").to_numpy(zero_copy_only=False), 2, 1)[owner]
        yield pa.RecordBatch.from_arrays(
            [batch.column("key").take(taken), batch.column("run").take(taken), pa.array((first - offsets[owner]).astype(np.int32)),
             pa.array(copies.astype(np.int32)), pa.array(scan.range_hashes(sums, first, first + window).view(np.int64)),
             pa.array(scan.range_hashes(sums, first, first + window // 2).view(np.int64))],
            ["key", "run", "at", "copies", "h0", "h1"],
        )


def _window_by_window(pieces: DataFrame, window: int) -> DataFrame:
    """The same result as ``_shard``, for runs of crowded anchor strings."""
    each = pieces.mapInArrow(lambda it: _windows(it, window), _WINDOWS)
    again = each.groupBy("h0", "h1").agg(F.sum("copies").alias("n")).where("n > 1").select("h0", "h1")
    # A run has no more windows than the anchor's distance allows.
    spans = F.collect_list(F.struct(F.col("at").alias("low"), F.col("at").alias("high"))).alias("spans")
    return each.join(again, ["h0", "h1"]).groupBy("key", "run").agg(spans)


CUT = "n_bytes long, n_removed long, n_spans long, kept binary"


def _remove(batches: Iterator[pa.RecordBatch], field: int, window: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        rows = whole.column("row")
        whole = pa.RecordBatch.from_arrays([rows, rows.field(field), whole.column("spans")], ["row", "text", "spans"])
        for batch in scan.slices(whole, "text"):
            data, offsets = scan.texts(batch.column("text"))
            spans = pc.fill_null(batch.column("spans"), pa.scalar([], batch.column("spans").type))
            parents = pc.list_parent_indices(spans).to_numpy(zero_copy_only=False)
            flat = spans.flatten()
            low, high = (offsets[parents] + flat.field(name).to_numpy() for name in ("low", "high"))
            change = np.bincount(low, minlength=len(data) + 1) - np.bincount(high + window, minlength=len(data) + 1)
            gone = np.cumsum(change)[: len(data)] > 0
            total = np.concatenate(([0], np.cumsum(gone)))[offsets]
            opens = gone.copy()
            opens[1:] &= ~gone[:-1]
            inner = offsets[:-1][offsets[1:] > offsets[:-1]]
            opens[inner] = gone[inner]
            opened = np.concatenate(([0], np.cumsum(opens)))[offsets]
            left = data[~gone]
            bounds = (offsets - total).astype(np.int32)
            kept = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(bounds), pa.py_buffer(left)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), *(pa.array(x) for x in (np.diff(offsets), np.diff(total), np.diff(opened))), kept],
                ["row", "n_bytes", "n_removed", "n_spans", "kept"],
            )


def repeated_windows(texts: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``rid, spans`` of the texts with repeated windows, from ``texts(rid, text)``; equal rids are equal texts."""
    window = settings.window
    found = scan.mapped(texts.select("rid", "text"), lambda it: _anchors(it, settings), ANCHORS)
    # Copies of a run count once for each; an anchor string of one run and one place ends here.
    keys = found.groupBy("key").agg(F.count("*").alias("n"), (F.min("run") < F.max("run")).alias("mixed"))
    keys = materialize(keys.where("n > 1").select("key", "mixed"), "anchors")
    held = materialize(found.join(keys, "key"), "runs")
    whole = held.where("not mixed").select("rid", F.struct("low", "high").alias("span"))

    copies = held.where("mixed").groupBy("key", "run").agg(
        F.min(F.struct("rid", "low", "high")).alias("one"), (F.count("*") > 1).alias("twice")
    )
    wanted = copies.groupBy("one.rid").agg(F.collect_list(F.struct("one.low", "one.high", "key", "run", "twice")).alias("wanted"))
    cut = scan.mapped(
        texts.select("rid", "text").join(wanted, "rid"), lambda it: _cut_runs(it, window), "key long, run long, twice boolean, piece binary"
    )
    pieces = materialize(cut.dropDuplicates(["key", "run"]), "pieces")
    volume = pieces.agg(F.sum(F.octet_length("piece"))).first()[0] or 0
    shards = int(volume // settings.shard_bytes) + 1
    crowded = pieces.groupBy("key").count().where(F.col("count") > settings.shard_runs).select("key")
    crowded = materialize(crowded, "crowded")
    few = pieces if crowded.isEmpty() else pieces.join(crowded, "key", "left_anti")
    repeated = few.repartition(shards, "key").mapInArrow(lambda it: _shard(it, window), REPEATED)
    if few is not pieces:
        repeated = repeated.unionByName(_window_by_window(pieces.join(crowded, "key", "left_semi"), window))
    repeated = repeated.where(F.size("spans") > 0)
    part = held.where("mixed").join(repeated, ["key", "run"]).select("rid", "low", F.explode("spans").alias("s")).select(
        "rid", F.struct((F.col("low") + F.col("s.low")).alias("low"), (F.col("low") + F.col("s.high")).alias("high")).alias("span")
    )
    return whole.unionByName(part).groupBy("rid").agg(F.collect_set("span").alias("spans"))


def without_repeats(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``row`` (all columns of ``docs``, ``text`` among them), ``n_bytes, n_removed, n_spans`` and the bytes ``kept``."""
    field = docs.columns.index("text")
    texts = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).select(
        F.xxhash64("row.doc_id", "row.text").alias("rid"), "row"
    )
    spans = repeated_windows(texts.select("rid", F.col("row.text").alias("text")), settings)
    schema = T.StructType([T.StructField("row", docs.schema), *T.StructType.fromDDL(CUT).fields])
    found = texts.join(spans, "rid", "left").select("row", "spans")
    return scan.mapped(found, lambda it: _remove(it, field, settings.window), schema)

