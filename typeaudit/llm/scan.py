"""Vectorized reading of text columns inside Arrow tasks: slices, words, lines and their hashes.

Positions are bytes of the UTF-8 text. Only A-Z are lower-cased, so a lower-cased text has the
same length. Hashes are 64-bit; a task holds the arrays of one slice, never of a whole partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from typeaudit.session import bound_batches

#: Text bytes and rows that a task works on at once.
SLICE_BYTES = 1 << 20
SLICE_ROWS = 2048

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX_2 = np.uint64(0x94D049BB133111EB)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Table of 256 flags: True for bytes inside any of the inclusive ranges."""
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: ``[^\\x20\\x09-\\x0D]``
NOT_BLANK = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``, for text in lower case
ALPHANUMERIC = ~byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


class Texts(NamedTuple):
    """Bytes of consecutive texts; text i is ``data[offsets[i]:offsets[i + 1]]``."""

    data: np.ndarray
    offsets: np.ndarray


class Spans(NamedTuple):
    """Words or lines; those of text i are ``first[i]`` up to ``first[i + 1]``."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def text(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def mapped(
    rows: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str
) -> DataFrame:
    """``mapInArrow`` for rows with texts: batches are bounded by bytes, however long the texts are."""
    bound_batches(rows.sparkSession)
    return rows.mapInArrow(function, schema)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about ``limit`` bytes of text each, at least one row and at most ``rows`` each."""
    if not batch.num_rows:
        return
    offsets = _buffers(batch.column(column)).offsets
    begin = 0
    while begin < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[begin] + limit, side="right")) - 1
        end = min(max(end, begin + 1), begin + rows, batch.num_rows)
        yield batch.slice(begin, end - begin)
        begin = end


def texts(array: pa.Array) -> Texts:
    """The bytes of a string or binary column; null counts as empty."""
    data, offsets = _buffers(array)
    return Texts(data[offsets[0] : offsets[-1]], offsets - offsets[0])


def _buffers(array: pa.Array) -> Texts:
    if array.null_count:
        array = pc.fill_null(array, b"" if pa.types.is_binary(array.type) else "")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)
    offsets = offsets[array.offset : array.offset + len(array) + 1].astype(np.int64)
    return Texts(np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8), offsets)


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> Spans:
    """Maximal runs of bytes with ``inside[byte]``, within each text."""
    member = inside[data]
    opens, closes = member.copy(), member.copy()
    opens[1:] &= ~member[:-1]
    closes[:-1] &= ~member[1:]
    filled = offsets[1:] > offsets[:-1]
    heads, tails = offsets[:-1][filled], offsets[1:][filled] - 1
    opens[heads] = member[heads]
    closes[tails] = member[tails]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return Spans(start, end, np.searchsorted(start, offsets))


def lines(data: np.ndarray, offsets: np.ndarray) -> Spans:
    """The pieces between line feeds; an empty text has one empty line."""
    feeds = np.flatnonzero(data == 10)
    before = np.searchsorted(feeds, offsets)
    count = np.diff(before) + 1
    first = np.concatenate(([0], np.cumsum(count)))
    start, end = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
    is_first, is_last = np.zeros(len(start), bool), np.zeros(len(start), bool)
    is_first[first[:-1]] = True
    is_last[first[1:] - 1] = True
    start[is_first], end[is_last] = offsets[:-1], offsets[1:]
    start[~is_first], end[~is_last] = feeds + 1, feeds
    return Spans(start, end, first)


def mix(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * _MIX_1
    values = (values ^ (values >> np.uint64(27))) * _MIX_2
    return values ^ (values >> np.uint64(31))


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 .. count-1 of the hash's factor and of its inverse, modulo 2**64."""
    if len(_powers[0]) < count:
        for at, factor in enumerate((_FACTOR, _INVERSE)):
            steps = np.full(count + count // 4, factor, np.uint64)
            steps[0] = 1
            _powers[at] = np.multiply.accumulate(steps)
    return _powers[0][:count], _powers[1][:count]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """``range_hashes`` takes these; one entry more than bytes."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data) + 1)[0][:-1], out=sums[1:])
    return sums


def range_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes ``start`` up to ``end``, whatever their position."""
    value = (sums[end] - sums[start]) * powers(len(sums))[1][start]
    return mix(value + (end - start).astype(np.uint64) * _MIX_2)


def window_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """Hash of ``values[i : i + width]`` for each i; callers pick the windows inside one text."""
    count = len(values) - width + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(count, np.uint64)
    for at in range(width):
        total = total * _FACTOR + values[at : at + count]
    return mix(total)


def windows(first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows of ``width`` spans that lie in one text, and the text of each."""
    count = np.maximum(np.diff(first) - width + 1, 0)
    text = np.repeat(np.arange(len(count)), count)
    begin = np.concatenate(([0], np.cumsum(count)))[:-1]
    return np.arange(len(text)) - np.repeat(begin - first[:-1], count), text


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and length of the runs of equal values in a sorted array."""
    if not len(keys):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    begin = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return begin, np.diff(np.concatenate((begin, [len(keys)])))
