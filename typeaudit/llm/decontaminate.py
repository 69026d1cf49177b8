"""Benchmark passages in documents: a prefix-filtered set join over item-sized windows.

Every window of an item (``width`` consecutive words; a shorter item is one window) is a set of word
positions ordered by how rare the words are in the corpus. Full containment needs only the first of this
order, so the join's key is the window's rarest word: a document word equal to it proposes the window that
many words further left, the position bound drops what would begin or end outside the text, and the
remaining words are compared one by one.

Scale: the benchmark is taken in blocks of at most ``BLOCK_WINDOWS`` windows, which bounds what tasks and the
driver hold of it; a block costs two narrow passes over the documents (word counts, then the join) and its counts are
partial sums. Nothing is keyed by document, source or passage, so no group is hot.

Cases: null texts have no words and items without words no windows. An item without ``item_id`` marks words but
is not listed; items that repeat an id are listed once. Repeated rows get equal results. All columns of the documents
stay in ``row``, so their names cannot clash. Empty tables give no hits, or no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from typeaudit.llm import scan

WIDTH = 10
BLOCK_WINDOWS = 50_000
SPAN = "array<struct<begin:int,end:int>>"


class Windows(NamedTuple):
    """Distinct windows of a block; window i has the words ``words[i, : size[i]]``."""

    words: np.ndarray
    size: np.ndarray
    items: list[list[str]]


def _word_hashes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = scan.texts(array)
    lower = scan.LOWER[data]
    spans = scan.words(lower, offsets, scan.ALPHANUMERIC)
    return scan.range_hashes(scan.prefix_sums(lower), spans.start, spans.end), spans.first


def item_windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """``words, items`` of each distinct window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in scan.slices(whole, "text")):
            hashes, first = _word_hashes(batch.column("text"))
            ids, rows, names = batch.column("item_id").to_pylist(), [], []
            for i, name in enumerate(ids):
                words = hashes[first[i] : first[i + 1]].view(np.int64)
                for begin in range(max(len(words) - width, 0) + 1) if len(words) else ():
                    rows.append(words[begin : begin + width])
                    names.append(name)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.list_(pa.int64())), pa.array(names, pa.string())], ["words", "item"]
            )

    chosen = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    found = scan.mapped(chosen, run, "words array<long>, item string")
    return found.groupBy("words").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _blocks(windows: DataFrame, width: int, block_windows: int) -> Iterator[Windows]:
    """Blocks of bounded size, in the order of a hash of their words."""
    windows = windows.withColumn("block", F.xxhash64("words")).persist()
    try:
        blocks = -(-windows.count() // block_windows)
        for number in range(blocks):
            part = windows.where(F.pmod(F.col("block"), F.lit(blocks)) == number).toPandas()
            words = np.zeros((len(part), width), np.uint64)
            size = part["words"].map(len).to_numpy().astype(np.int64)
            for i, row in enumerate(part["words"]):
                words[i, : size[i]] = np.asarray(row, np.int64).view(np.uint64)
            yield Windows(words, size, [list(x) for x in part["items"]])
    finally:
        windows.unpersist()


def _frequencies(docs: DataFrame, words: np.ndarray) -> np.ndarray:
    """How often each of the sorted ``words`` occurs in ``row.text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(words), np.int64)
        for batch in (part for whole in batches for part in scan.slices(whole, "text")):
            hashes, _ = _word_hashes(batch.column("text"))
            at = np.minimum(np.searchsorted(words, hashes), len(words) - 1)
            total += np.bincount(at[words[at] == hashes], minlength=len(words))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["at", "n"])

    found = scan.mapped(docs.select(F.col("row.text").alias("text")), run, "at long, n long")
    counts = found.groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    frequency = np.zeros(len(words), np.int64)
    frequency[counts["at"].to_numpy(np.int64)] = counts["n"].to_numpy(np.int64)
    return frequency


class Index(NamedTuple):
    """Windows in the order of their key; ``keys`` holds each key once, its windows from ``first[i]`` on."""

    keys: np.ndarray
    first: np.ndarray
    window: np.ndarray
    offset: np.ndarray
    windows: Windows


def _index(windows: Windows, vocabulary: np.ndarray, frequency: np.ndarray) -> Index:
    rarity = frequency[np.searchsorted(vocabulary, windows.words).clip(max=len(vocabulary) - 1)].astype(np.float64)
    rarity[np.arange(windows.words.shape[1]) >= windows.size[:, None]] = np.inf
    offset = np.argmin(rarity, axis=1)
    key = windows.words[np.arange(len(offset)), offset]
    order = np.argsort(key, kind="stable")
    begin, _ = scan.runs(key[order])
    return Index(key[order][begin], np.append(begin, len(order)), order, offset[order], windows)


def _matches(hashes: np.ndarray, first: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and window of every occurrence."""
    at = np.minimum(np.searchsorted(index.keys, hashes), len(index.keys) - 1)
    where = np.flatnonzero(index.keys[at] == hashes)
    many = (index.first[1:] - index.first[:-1])[at[where]]
    entry = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(index.first[at[where]], many)
    begin = np.repeat(where, many) - index.offset[entry]
    text = np.repeat(np.searchsorted(first, where, side="right") - 1, many)
    window = index.window[entry]
    size = index.windows.size[window]
    inside = (begin >= first[text]) & (begin + size <= first[text + 1])
    begin, text, window, size = begin[inside], text[inside], window[inside], size[inside]
    same = np.ones(len(begin), bool)
    for k in range(index.windows.words.shape[1]):
        live = np.flatnonzero(same & (size > k))
        same[live] = hashes[begin[live] + k] == index.windows.words[window[live], k]
    return text[same], begin[same], window[same]


def _found(batch: pa.RecordBatch, rows: pa.Array, index: Index | None) -> pa.RecordBatch:
    hashes, first = _word_hashes(batch.column("text"))
    count = batch.num_rows
    spans: list[list[dict]] = [[] for _ in range(count)]
    items: list[list[str]] = [[] for _ in range(count)]
    if index is not None:
        text, begin, window = _matches(hashes, first, index)
        frame = pd.DataFrame({"text": text, "begin": begin - first[text], "window": window}).sort_values(["text", "begin"])
        for i, part in frame.groupby("text"):
            items[i] = sorted({item for w in part["window"].unique() for item in index.windows.items[w]})
            b, e = part["begin"].to_numpy(), part["begin"].to_numpy() + index.windows.size[part["window"].to_numpy()]
            reach = np.maximum.accumulate(e)
            heads = np.flatnonzero(np.concatenate(([True], b[1:] > reach[:-1])))
            tails = np.append(heads[1:], len(b)) - 1
            spans[i] = [{"begin": int(b[h]), "end": int(reach[t])} for h, t in zip(heads, tails, strict=True)]
    return pa.RecordBatch.from_arrays(
        [
            rows,
            pa.array(np.diff(first).astype(np.int64)),
            pa.array(spans, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))),
            pa.array(items, pa.list_(pa.string())),
        ],
        ["carried", "n_words", "new_spans", "new_items"],
    )


def _pass(found: DataFrame, field: int, index: Index | None) -> DataFrame:
    """One block's matches added to ``row, spans, items``."""
    carried = found.select(F.struct("row", "spans", "items").alias("carried"))
    schema = T.StructType(
        [carried.schema["carried"], *T.StructType.fromDDL(f"n_words long, new_spans {SPAN}, new_items array<string>").fields]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            rows = whole.column(0)
            whole = pa.RecordBatch.from_arrays([rows, rows.field(0).field(field)], ["carried", "text"])
            for batch in scan.slices(whole, "text"):
                yield _found(batch, batch.column("carried"), index)

    return scan.mapped(carried, run, schema).select(
        "carried.row",
        "n_words",
        F.concat("carried.spans", "new_spans").alias("spans"),
        F.array_union("carried.items", "new_items").alias("items"),
    )


def n_hit(spans: str = "spans") -> Column:
    """Words inside any of the spans, which may overlap."""
    start = F.struct(F.lit(0).alias("reach"), F.lit(0).cast("long").alias("total"))
    return F.aggregate(
        F.array_sort(spans),
        start,
        lambda acc, x: F.struct(
            F.greatest(acc["reach"], x["end"]).alias("reach"),
            (acc["total"] + F.greatest(x["end"] - F.greatest(acc["reach"], x["begin"]), F.lit(0))).alias("total"),
        ),
    )["total"]


def passages(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """``row`` (all columns of ``docs``, ``text`` among them), ``n_words``, ``spans`` of hit words and ``items``."""
    field = docs.columns.index("text")
    start = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    found = start.select(
        "row", F.lit(None).cast("long").alias("n_words"), F.array().cast(SPAN).alias("spans"), F.array().cast("array<string>").alias("items")
    )
    any_block = False
    for windows in _blocks(item_windows(benchmark, width), width, block_windows):
        if not len(windows.size):
            continue
        inside = np.arange(width) < windows.size[:, None]
        vocabulary = np.unique(windows.words[inside])
        found = _pass(found, field, _index(windows, vocabulary, _frequencies(start, vocabulary)))
        any_block = True
    return found if any_block else _pass(found, field, None)
