"""Suffix order and common prefixes of one shard by external induced sorting.

The suffixes of a byte text fall into larger (L) and smaller (S) than their right neighbour. The leftmost of each
run of S suffixes are sorted first; every other suffix is then induced from its right neighbour: a scan in
increasing order appends each L suffix to the queue of its first byte, a scan in decreasing order each S suffix.
As the scans are monotone, the priority queue over (first byte, rank of the rest) is a first-in first-out queue for
each byte. Queues hold (position, common prefix with the suffix before) and go to disk beyond a bound, as do the
shard's arrays; the scans take them in chunks. The common prefix of two induced neighbours is one more than the least
common prefix passed in the scan between their right neighbours, which is carried for each queue.

The leftmost S suffixes get their order from names: an induction over unsorted ones sorts the substrings between
them, which are named, and the string of names is ranked by doubling, as deep as ``depth`` bytes need.
"""

from __future__ import annotations

import tempfile
from collections import deque

import numpy as np

from typeaudit.llm import scan

CHUNK = 1 << 18
#: Entries of all queues, and bytes of one array, that are kept in memory.
QUEUE_ENTRIES = 1 << 22
ARRAY_BYTES = 64 << 20
SYMBOLS = 258


def array(size: int, kind: type) -> np.ndarray:
    """A zeroed array; in a file of the task's scratch folder if it is large."""
    if size * np.dtype(kind).itemsize <= ARRAY_BYTES:
        return np.zeros(size, kind)
    return np.memmap(tempfile.TemporaryFile(), dtype=kind, mode="w+", shape=(size,))


class Queues:
    """A queue for each symbol; what doesn't fit in memory is appended to a file of the symbol."""

    def __init__(self) -> None:
        self.parts: list[deque] = [deque() for _ in range(SYMBOLS)]
        self.files: dict[int, object] = {}
        self.held = 0

    def put(self, symbol: int, entries: np.ndarray) -> None:
        if self.held + len(entries) <= QUEUE_ENTRIES:
            self.parts[symbol].append(entries)
            self.held += len(entries)
            return
        out = self.files.setdefault(symbol, tempfile.TemporaryFile())
        begin = out.seek(0, 2)
        out.write(entries.tobytes())
        self.parts[symbol].append((begin, len(entries)))

    def take(self, symbol: int) -> np.ndarray | None:
        """The next entries, about a chunk of them."""
        found, size = [], 0
        while self.parts[symbol] and size < CHUNK:
            part = self.parts[symbol].popleft()
            if isinstance(part, np.ndarray):
                self.held -= len(part)
            else:
                self.files[symbol].seek(part[0])
                part = np.frombuffer(self.files[symbol].read(part[1] * ENTRY.itemsize), ENTRY)
            found.append(part)
            size += len(part)
        return np.concatenate(found) if found else None


ENTRY = np.dtype([("at", np.int64), ("common", np.int64)])
_FAR = np.int64(1 << 40)


def _least(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minimum of ``values[low : high + 1]`` for each pair, from minimums of power-of-two ranges."""
    found = np.full(len(low), _FAR)
    level, width = values, 1
    length = high - low + 1
    while True:
        here = np.flatnonzero((length >= width) & (length < 2 * width))
        found[here] = np.minimum(level[low[here]], level[high[here] - width + 1])
        if 2 * width > len(values):
            return found
        level = np.minimum(level[:-width], level[width:])
        width *= 2


class _Scan:
    """Appends to each queue, with the common prefix since the queue's last entry."""

    def __init__(self, text: np.ndarray, wanted: np.ndarray, depth: int) -> None:
        self.text, self.wanted, self.depth = text, wanted, depth
        self.queues = Queues()
        self.passed = np.full(SYMBOLS, _FAR)
        self.empty = np.ones(SYMBOLS, bool)

    def over(self, at: np.ndarray, common: np.ndarray) -> None:
        """A chunk of the scan: positions, and common prefixes with the position scanned before."""
        if not len(at):
            return
        before = at - 1
        live = np.flatnonzero((before >= 0) & self.wanted[np.maximum(before, 0)])
        symbols = self.text[before[live]]
        # Short integers are sorted by their digits.
        order = np.argsort(symbols, kind="stable")
        live, symbols = live[order], symbols[order].astype(np.int64)
        begin, length = scan.runs(symbols)
        entries = np.empty(len(live), ENTRY)
        entries["at"] = before[live]
        heads = symbols[begin]
        entries["common"] = self._common(common, live, begin, length, heads) if self.depth else 0
        for symbol, b, n in zip(heads.tolist(), begin.tolist(), length.tolist(), strict=True):
            self.queues.put(symbol, entries[b : b + n])

    def _common(self, common: np.ndarray, live: np.ndarray, begin: np.ndarray, length: np.ndarray, heads: np.ndarray) -> np.ndarray:
        low = np.empty(len(live), np.int64)
        low[1:] = live[:-1] + 1
        low[begin] = 0
        since = _least(common, low, live)
        since[begin] = np.minimum(since[begin], self.passed[heads])
        joined = np.minimum(since + 1, self.depth)
        joined[begin[self.empty[heads]]] = 0
        np.minimum(self.passed, common.min(), out=self.passed)
        last = live[begin + length - 1]
        tail = np.full(len(last), _FAR)
        inner = last + 1 < len(common)
        tail[inner] = _least(common, last[inner] + 1, np.full(inner.sum(), len(common) - 1))
        self.passed[heads] = tail
        self.empty[heads] = False
        return joined


def _agree(text: np.ndarray, a: int, b: int, depth: int) -> int:
    x, y = text[a : a + depth], text[b : b + depth]
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[:n] != y[:n])
    return int(differ[0]) if len(differ) else n


def _chunks(*arrays: np.ndarray):
    for begin in range(0, len(arrays[0]), CHUNK):
        yield tuple(a[begin : begin + CHUNK] for a in arrays)


def induce(text: np.ndarray, small: np.ndarray, stars: np.ndarray, common: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in order, and common prefixes (``depth`` at most; 0: none are kept), from the ordered leftmost
    S suffixes."""
    size = len(text)
    star_end = np.searchsorted(text[stars], np.arange(SYMBOLS + 1))
    order, shared = array(size, np.int64), array(size, np.int64)
    bounds = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=SYMBOLS))))
    rising = _Scan(text, ~small, depth)
    large = np.zeros(SYMBOLS, np.int64)
    for symbol in range(SYMBOLS):
        fill = begin = int(bounds[symbol])
        while (entries := rising.queues.take(symbol)) is not None:
            order[fill : fill + len(entries)], shared[fill : fill + len(entries)] = entries["at"], entries["common"]
            fill += len(entries)
            for part in _chunks(entries["at"], entries["common"]):
                rising.over(*part)
        large[symbol] = fill
        mine, agree = stars[star_end[symbol] : star_end[symbol + 1]], common[star_end[symbol] : star_end[symbol + 1]].copy()
        if len(mine):
            agree[0] = _agree(text, int(order[fill - 1]), int(mine[0]), depth) if fill > begin else 0
            for part in _chunks(mine, agree):
                rising.over(*part)
    falling = _Scan(text, small, depth)
    for symbol in range(SYMBOLS - 1, -1, -1):
        begin, middle, fill = int(bounds[symbol]), int(large[symbol]), int(bounds[symbol + 1])
        while (entries := falling.queues.take(symbol)) is not None:
            low = fill - len(entries)
            order[low:fill] = entries["at"][::-1]
            # An entry's value is what it shares with the larger one before it, so it belongs one place higher.
            upper = min(fill + 1, int(bounds[symbol + 1]))
            shared[low + 1 : upper] = entries["common"][::-1][: upper - low - 1]
            fill = low
            for part in _chunks(entries["at"], entries["common"]):
                falling.over(*part)
        if symbol == 0 and fill > middle:
            # The end of the text is induced by nothing.
            fill -= 1
            order[fill], shared[fill] = size - 1, 0
        if fill < int(bounds[symbol + 1]):
            shared[fill] = _agree(text, int(order[middle - 1]), int(order[fill]), depth) if middle > begin else 0
        if middle > begin:
            back = np.empty(middle - begin, np.int64)
            back[1:] = shared[begin + 1 : middle][::-1]
            back[0] = shared[middle] if middle < int(bounds[symbol + 1]) else 0
            for part in _chunks(order[begin:middle][::-1], back):
                falling.over(*part)
    return order, shared


def _types(text: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than their right neighbour; the last one is."""
    begin, length = scan.runs(text)
    rises = np.append(text[begin[1:]] > text[begin[:-1]], True)
    return np.repeat(rises, length)


def _rank(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of a string of names, by doubling; names stand for two symbols or more."""
    rank, reach = names.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while 2 * reach < depth and rank.max() < len(rank) - 1:
        behind = np.zeros(len(rank), np.int64)
        behind[:-reach or None] = rank[reach:] + 1
        pair = rank * (len(rank) + 2) + behind
        order = np.argsort(pair, kind="stable")
        begin, length = scan.runs(pair[order])
        rank = np.empty(len(rank), np.int64)
        rank[order] = np.repeat(np.arange(len(begin)), length)
        reach *= 2
    return order


def _shared_by_hash(sums: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Common prefixes of pairs of positions, by halving steps."""
    found, step, size = np.zeros(len(a), np.int64), 1 << (depth.bit_length() - 1), len(sums) - 1
    while step:
        x, y = a + found, b + found
        fits = np.flatnonzero(np.maximum(x, y) + step <= size)
        same = scan.range_hashes(sums, x[fits], x[fits] + step) == scan.range_hashes(sums, y[fits], y[fits] + step)
        found[fits[same]] += step
        step //= 2
    return np.minimum(found, depth)


def suffix_order(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``text`` in the order of their first ``depth`` symbols, and common prefixes with the one before.

    Symbols are below SYMBOLS - 1; the last one, and no other, is 0.
    """
    small = _types(text)
    stars = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if not len(stars):
        stars = np.array([len(text) - 1])
    zeros = np.zeros(len(stars), np.int64)
    by_symbol = stars[np.argsort(text[stars], kind="stable")]
    rough, _ = induce(text, small, by_symbol, zeros, 0)
    is_star = np.zeros(len(text), bool)
    is_star[stars] = True
    sorted_stars = rough[is_star[rough]]
    ends = np.append(stars[1:], len(text) - 1) + 1
    sums = scan.prefix_sums(text)
    rank_of = np.empty(len(text), np.int64)
    rank_of[stars] = np.arange(len(stars))
    piece = scan.range_hashes(sums, stars, np.minimum(ends, len(text)))[rank_of[sorted_stars]]
    names = np.empty(len(stars), np.int64)
    names[rank_of[sorted_stars]] = np.cumsum(np.concatenate(([0], (piece[1:] != piece[:-1]).astype(np.int64))))
    ordered = stars[_rank(names, depth)]
    common = np.zeros(len(ordered), np.int64)
    common[1:] = _shared_by_hash(sums, ordered[:-1], ordered[1:], depth)
    return induce(text, small, ordered, common, depth)
