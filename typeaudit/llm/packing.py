"""Best-fit packing of documents into training sequences, under conflicts.

A sequence (bin) takes no two documents of one source and no two of one duplicate cluster; both are kept as
bitmaps in the bin. Bins stand in the order of what is left in them. A piece, longest first, takes the tightest bin
that it fits: the search starts at the least sufficient residual and goes on to the next larger one until the bitmaps
allow the bin; else a new bin is opened. Documents longer than a sequence are cut; full parts are sequences of their own.

The cluster is the component of near copies that ``pack_apart`` finds by ``near_dedup``; without one, texts
of the same words are a cluster.

Scale: one narrow pass measures the texts; with ``components``, lengths and hashes (no texts) are joined with them by key.
Each task then packs blocks of ``block_rows`` consecutive rows and holds the lengths of one block; nothing
is keyed by source or cluster, so a source with a third of all rows meets itself only inside a block. A block leaves at most a
few bins part-filled. Blocks are numbered by partition and order; write the result to fix the numbers.

Cases: null and empty texts have no tokens but their end, and are packed as that; texts without a word are one cluster. Rows
without source conflict with none. Repeated rows conflict as copies. Columns of the input but the text stay in ``row``. An empty
table gives an empty one.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from typeaudit.llm import near_dedup, scan, tokens


class Settings(NamedTuple):
    capacity: int = 4096
    block_rows: int = 4096
    vocabulary: str = tokens.VOCABULARY


def clusters(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hash of each text's words in lower case: copies but for case and blanks are one cluster."""
    lower = scan.LOWER[data]
    spans = scan.words(lower, offsets, scan.NOT_BLANK)
    hashes = scan.mix(scan.range_hashes(scan.prefix_sums(lower), spans.start, spans.end))
    place = np.arange(len(hashes)) - np.repeat(spans.first[:-1], np.diff(spans.first))
    sums = np.concatenate(([np.uint64(0)], np.cumsum(scan.mix(hashes + place.astype(np.uint64)), dtype=np.uint64)))
    return scan.mix(sums[spans.first[1:]] - sums[spans.first[:-1]])


def best_fit(lengths: list[int], sources: list, duplicates: list, capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each piece; lengths are positive and at most ``capacity``."""
    source_bit = {s: 1 << i for i, s in enumerate(dict.fromkeys(s for s in sources if s is not None))}
    often = [c for c, n in Counter(duplicates).items() if n > 1]
    cluster_bit = {c: 1 << i for i, c in enumerate(often)}
    # Open bins as (left, bin); what is full leaves.
    open_bins: list[tuple[int, int]] = []
    masks: list[tuple[int, int]] = []
    bins, places = [0] * len(lengths), [0] * len(lengths)
    for piece in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        length = lengths[piece]
        own_source, own_cluster = source_bit.get(sources[piece], 0), cluster_bit.get(duplicates[piece], 0)
        at = bisect_left(open_bins, (length, -1))
        while at < len(open_bins):
            in_source, in_cluster = masks[open_bins[at][1]]
            if not (in_source & own_source or in_cluster & own_cluster):
                break
            at += 1
        if at < len(open_bins):
            left, chosen = open_bins.pop(at)
        else:
            left, chosen = capacity, len(masks)
            masks.append((0, 0))
        bins[piece], places[piece] = chosen, capacity - left
        masks[chosen] = (masks[chosen][0] | own_source, masks[chosen][1] | own_cluster)
        if left > length:
            insort(open_bins, (left - length, chosen))
    return bins, places


MEASURED = "n_bytes long, n_tokens long, cluster long"
PIECES = "n_tokens long, piece int, piece_tokens int, bin long, bin_offset int"


def _measure(batches: Iterator[pa.RecordBatch], vocabulary: str, by_words: bool) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in scan.slices(whole, "text")):
        found = scan.texts(batch.column("text"))
        length = tokens.lengths(batch.column("text"), vocabulary) + 1
        # Rows without component have no words.
        cluster = clusters(*found) if by_words else np.zeros(batch.num_rows, np.uint64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("key"), pa.array(np.diff(found.offsets)), pa.array(length),
             pa.array(cluster.view(np.int64))],
            ["row", "key", "n_bytes", "n_tokens", "cluster"],
        )


def pack(docs: DataFrame, settings: Settings = Settings(), components: DataFrame | None = None, key: str = "") -> DataFrame:
    """``row`` (all columns of ``docs`` but ``text`` and ``key``) and, for each piece of it, its place in a bin.

    ``n_tokens`` counts the document's tokens and one end. ``components(key, component)`` has each value of the column
    ``key`` once, as ``near_dedup.row_components`` gives it; rows without component are told apart by their words.
    """
    carried = docs.drop("text", key)
    source_at = carried.columns.index("source")
    row_field = T.StructField("row", carried.schema)
    schema = T.StructType([row_field, *T.StructType.fromDDL(PIECES).fields])

    def packed(block: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
        rows = pa.concat_arrays([b.column("row") for b in block])
        length, cluster = (np.concatenate([b.column(c).to_numpy() for b in block]) for c in ("n_tokens", "cluster"))
        source = rows.field(source_at).to_pylist()
        count = -(-length // settings.capacity)
        owner = np.repeat(np.arange(len(length)), count)
        piece = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        size = np.minimum(length[owner] - piece * settings.capacity, settings.capacity)
        bins, places = best_fit(size.tolist(), [source[i] for i in owner], cluster[owner].tolist(), settings.capacity)
        return pa.RecordBatch.from_arrays(
            [rows.take(pa.array(owner)), pa.array(length[owner]), pa.array(piece.astype(np.int32)), pa.array(size.astype(np.int32)),
             pa.array(np.array(bins, np.int64) + (number << 20)), pa.array(places, pa.int32())],
            ["row", "n_tokens", "piece", "piece_tokens", "bin", "bin_offset"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, waiting, held, volume = TaskContext.get().partitionId() << 20, [], 0, 0
        for batch in batches:
            ends, begin = np.cumsum(batch.column("n_bytes").to_numpy()), 0
            while begin < batch.num_rows:
                before = int(ends[begin - 1]) if begin else 0
                # The row that reaches the block's volume is still of the block.
                full = int(np.searchsorted(ends, before + 16 * scan.SLICE_BYTES - volume)) + 1
                end = min(full, begin + settings.block_rows - held, batch.num_rows)
                waiting.append(batch.slice(begin, end - begin))
                held, volume, begin = held + end - begin, volume + int(ends[end - 1]) - before, end
                if held >= settings.block_rows or volume >= 16 * scan.SLICE_BYTES:
                    yield packed(waiting, number)
                    number, waiting, held, volume = number + 1, [], 0, 0
        if waiting:
            yield packed(waiting, number)

    by_words = components is None
    number = F.lit(0).cast("long") if by_words else F.col(f"`{key}`")
    row = F.struct(*(F.col(f"`{c}`") for c in carried.columns)).alias("row")
    measured = scan.mapped(
        docs.select(row, number.alias("key"), F.col("text").cast("string").alias("text")),
        lambda it: _measure(it, settings.vocabulary, by_words),
        T.StructType([row_field, T.StructField("key", T.LongType()), *T.StructType.fromDDL(MEASURED).fields]),
    )
    if components is not None:
        cluster = F.coalesce("component", "cluster").alias("cluster")
        measured = measured.join(components, "key", "left").select("row", "n_bytes", "n_tokens", cluster)
    return measured.select("row", "n_bytes", "n_tokens", "cluster").mapInArrow(run, schema)


def pack_apart(docs: DataFrame, settings: Settings = Settings(), near: near_dedup.Settings = near_dedup.Settings()) -> DataFrame:
    """As ``pack``, with the components of near copies as clusters."""
    key = near_dedup.free_name(docs, "near_key")
    keyed = near_dedup.with_row_key(docs, key)
    return pack(keyed, settings, near_dedup.row_components(keyed, key, near), key)
