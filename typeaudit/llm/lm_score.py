"""Language-model scores: a weighted backoff automaton of smoothed n-grams.

Tokens are blank-separated words in lower case and one end. The probability of a word after a context is
``(c(context, word) + strength * p(word after the context without its first word)) / (c(context) + strength)``;
below the single words stands ``(c(word) + 1) / (tokens + words + 1)``. So each context is a state, each
counted continuation an arc with the logarithm of this value, and a word without arc takes the failure arc,
whose weight is ``log(strength / (c(context) + strength))``, to the shorter context. A text is read from left to
right; the state is carried and the weights are summed. The state before a text is the one after an end. Counted
grams are closed under leaving out their first or last word, so the state carried to a place is the longest counted
context that ends there, and the texts of a block take each step of the traversal together.

Scale: the model is as large as the corpus and never in one place. Documents
are packed, as they are read, into blocks of bounded size, written once. A block counts its own n-grams; the
counts travel as sorted runs, one row for each block and key range, are summed by key range, and the sums travel back
in the order of the block's keys, without them. Each block then builds the part of the automaton that its texts
reach. A key range holds hashes of whole n-grams, so a word with a third of all occurrences is one entry of each
block, not a group.

Cases: null and empty texts are one end. A null ``doc_id`` is in no held-out fold and teaches like others; repeated rows
teach as often as they stand and get equal scores. Columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typeaudit.llm import scan
from typeaudit.session import materialize


class Settings(NamedTuple):
    order: int = 2
    strength: float = 16.0
    folds: int = 7
    held_out: int = 2
    #: Text bytes of a block, and distinct n-grams of a key range, about.
    block_bytes: int = 8 << 20
    range_keys: int = 1 << 19


END = b"\n"
PACK = "block long, volume long, texts binary"
RUN = "range int, block long, keys binary, counts binary"
#: Block number of the rows that hold, for a key range, the taught tokens and distinct words.
TOTALS = -1


class Block(NamedTuple):
    """Token ids of the texts of a block, end to end, each with the end token (id 0) last."""

    ids: np.ndarray
    first: np.ndarray
    #: Hash of each token id.
    hashes: np.ndarray


def read_block(array: pa.Array) -> Block:
    vocabulary: dict[bytes, int] = {END: 0}
    ids: list[int] = []
    first = [0]
    for text in array:
        value = text.as_py()
        for word in (value.encode() if value else b"").lower().split():
            ids.append(vocabulary.setdefault(word, len(vocabulary)))
        ids.append(0)
        first.append(len(ids))
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in vocabulary), np.uint64, len(vocabulary))
    return Block(np.array(ids, np.int64), np.array(first, np.int64), hashes)


class Grams(NamedTuple):
    """The distinct n-grams of a block for one n: key, first place, and the place-to-gram map (-1: none)."""

    keys: np.ndarray
    at: np.ndarray
    of: np.ndarray


def grams(block: Block, order: int) -> list[Grams]:
    """For n = 1 .. order. A gram of place i ends there; it may begin with the end before its text, no earlier."""
    found = []
    ids = np.concatenate(([0], block.ids))
    length = len(block.ids)
    place = np.arange(length) - np.repeat(block.first[:-1], np.diff(block.first))
    inverse = ids[1:]
    for n in range(1, order + 1):
        if n == 1:
            code, valid = block.ids, np.ones(length, bool)
        else:
            # The gram that ends one place earlier, and this word. Before a text stands an end alone.
            earlier = np.concatenate(([-1], inverse[:-1]))
            earlier = np.where(place == 0, 0 if n == 2 else -1, earlier)
            valid = earlier >= 0
            code = earlier * len(block.hashes) + block.ids
        distinct, at, back = np.unique(code[valid], return_index=True, return_inverse=True)
        inverse = np.full(length, -1, np.int64)
        inverse[valid] = back
        at = np.flatnonzero(valid)[at]
        key = np.full(len(at), n, np.uint64)
        for k in range(n - 1, -1, -1):
            behind = at - k
            word = np.where(behind >= np.repeat(block.first[:-1], np.diff(block.first))[at], block.ids[np.maximum(behind, 0)], 0)
            key = scan.mix(key * np.uint64(0x9E3779B97F4A7C15) + block.hashes[word])
        # The lowest bits tell n, so that single words can be counted.
        key = (key & ~np.uint64(3)) | np.uint64(n - 1)
        found.append(Grams(key, at, inverse))
    return found


def is_held_out(doc_id: int | None, settings: Settings) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % settings.folds == settings.held_out


def _teaching(ids: list, block: Block, settings: Settings) -> np.ndarray:
    """Flags of the places whose text teaches."""
    return np.repeat([not is_held_out(i, settings) for i in ids], np.diff(block.first))


def _local_counts(block: Block, every: list[Grams], teaches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = [], []
    for gram in every:
        used = gram.of[teaches & (gram.of >= 0)]
        keys.append(gram.keys)
        counts.append(np.bincount(used, minlength=len(gram.keys)))
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(keys)
    return keys[order], counts[order]


def _range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _packed(keys: np.ndarray) -> bytes:
    """Differences of sorted keys, by bytes of equal weight, the rare high ones together."""
    steps = np.diff(keys, prepend=np.uint64(0))
    return np.ascontiguousarray(steps.astype(">u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(">u8").reshape(-1).astype(np.uint64), dtype=np.uint64)


def _counts_packed(counts: np.ndarray) -> bytes:
    """By bytes of equal weight, eight for each count: sums over the corpus outgrow four. High planes are zero and compress."""
    return np.ascontiguousarray(counts.astype(">i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _counts_unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(">i8").reshape(-1).astype(np.int64)


def _runs(number: int, keys: np.ndarray, counts: np.ndarray, ranges: int) -> Iterator[tuple]:
    part = _range_of(keys, ranges)
    begin, length = scan.runs(part)
    for b, n in zip(begin, length, strict=True):
        yield int(part[b]), number, _packed(keys[b : b + n]), _counts_packed(counts[b : b + n])


def _table(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


_RUN_NAMES, _RUN_KINDS = ["range", "block", "keys", "counts"], [pa.int32(), pa.int64(), pa.binary(), pa.binary()]


def _pack(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows as blocks of about ``block_bytes``; the number is unique, and fixed once it is written."""
    number, waiting, volume = TaskContext.get().partitionId() << 32, [], 0

    def packed() -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, waiting[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            for part in waiting:
                out.write_batch(part)
        return pa.RecordBatch.from_arrays(
            [pa.array([number]), pa.array([volume]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "volume", "texts"]
        )

    for part in (part for whole in batches for part in scan.slices(whole, "text")):
        waiting.append(part)
        volume += len(scan.texts(part.column("text")).data)
        if volume >= block_bytes:
            yield packed()
            number, waiting, volume = number + 1, [], 0
    if waiting:
        yield packed()


def _unpack(texts: bytes) -> tuple[list, Block]:
    table = pa.ipc.open_stream(texts).read_all()
    return table.column("doc_id").to_pylist(), read_block(table.column("text").combine_chunks())


def _count(batches: Iterator[pa.RecordBatch], settings: Settings, ranges: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for number, texts in zip(batch.column("block").to_pylist(), batch.column("texts"), strict=True):
            ids, block = _unpack(texts.as_py())
            keys, counts = _local_counts(block, grams(block, settings.order), _teaching(ids, block, settings))
            yield from _table(list(_runs(number, keys, counts, ranges)), _RUN_NAMES, _RUN_KINDS).to_batches()


def _sum_range(group: pa.Table) -> pa.Table:
    """To each block the sums of its keys, in their order; one row more with how much was taught."""
    keys = [_unpacked(x) for x in group.column("keys").to_pylist()]
    counts = [_counts_unpacked(x) for x in group.column("counts").to_pylist()]
    distinct, back = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, back, np.concatenate(counts))
    single = total[(distinct & np.uint64(3)) == 0]
    number = group.column("range")[0].as_py()
    rows = [(number, TOTALS, int((single > 0).sum()).to_bytes(8, "big"), int(single.sum()).to_bytes(8, "big"))]
    begin = 0
    for block, own in zip(group.column("block").to_pylist(), keys, strict=True):
        rows.append((number, block, None, _counts_packed(total[back[begin : begin + len(own)]])))
        begin += len(own)
    return _table(rows, _RUN_NAMES, _RUN_KINDS)


class Automaton(NamedTuple):
    """States are the counted contexts; the one of a place is the longest that ends there, so it is carried by place.

    ``arcs[n]`` holds for each place whether the gram of n + 1 words that ends there is an arc, and its weight;
    ``penalty[n]`` the weight of the failure arc from the context of n words that ends there.
    """

    arcs: list[tuple[np.ndarray, np.ndarray]]
    penalty: list[np.ndarray]


def build(block: Block, every: list[Grams], count_of: list[np.ndarray], tokens: int, types: int, settings: Settings) -> Automaton:
    """The part of the automaton that the block's texts reach, laid out along them."""
    strength = settings.strength
    starts = np.repeat(block.first[:-1], np.diff(block.first))
    # The probability of each gram's last word after the rest of the gram.
    probability = (count_of[0] + 1) / (tokens + types + 1)
    arcs = [(np.ones(len(block.ids), bool), np.log10(probability)[block.ids])]
    penalty = [np.zeros(len(block.ids))]
    for n in range(1, settings.order):
        gram, at = every[n], every[n].at
        # The context of the gram that ends at a place ends one place earlier; before a text it is the end alone.
        context = np.where(at == starts[at], 0, every[n - 1].of[np.maximum(at - 1, 0)])
        total, shorter = count_of[n - 1][context], probability[every[n - 1].of[at]]
        probability = np.where(total > 0, (count_of[n] + strength * shorter) / (total + strength), shorter)
        there = gram.of >= 0
        of = np.where(there, gram.of, 0)
        arcs.append((there & (count_of[n][of] > 0), np.log10(probability)[of]))
        penalty.append(np.where(there & (total > 0)[of], np.log10(strength / (total + strength))[of], 0.0))
    return Automaton(arcs, penalty)


def traverse(automaton: Automaton) -> np.ndarray:
    """Weight of each place: from the longest context carried there, failure arcs down to the first context with an arc."""
    weight = np.zeros(len(automaton.penalty[0]))
    falling = np.ones(len(weight), bool)
    for (arc, value), penalty in zip(reversed(automaton.arcs), reversed(automaton.penalty), strict=True):
        weight += np.where(falling, np.where(arc, value, penalty), 0.0)
        falling &= ~arc
    return weight


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _score(group: pa.Table, sums: pa.Table, tokens: int, types: int, settings: Settings) -> pa.Table:
    ids, block = _unpack(group.column("texts")[0].as_py())
    every = grams(block, settings.order)
    keys = np.sort(np.concatenate([gram.keys for gram in every]))
    # The sums come by key range, so in the order of the block's sorted keys.
    numbers, parts = sums.column("range").to_numpy(), sums.column("counts").to_pylist()
    totals = np.concatenate([_counts_unpacked(parts[i]) for i in np.argsort(numbers)])
    count_of = [totals[np.searchsorted(keys, gram.keys)] for gram in every]
    automaton = build(block, every, count_of, tokens, types, settings)
    root, first = automaton.arcs[0][1], block.first[:-1]
    return pa.table(
        [
            pa.array(ids, pa.int64()),
            pa.array([is_held_out(i, settings) for i in ids], pa.bool_()),
            pa.array(np.diff(block.first)),
            pa.array(np.add.reduceat((count_of[0] > 0).astype(np.int64)[block.ids], first)),
            pa.array(np.add.reduceat(root, first)),
            pa.array(np.add.reduceat(traverse(automaton), first)),
        ],
        names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
    )


def scores(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Per row of ``docs``: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``."""
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    packs = materialize(chosen.mapInArrow(lambda it: _pack(it, settings.block_bytes), PACK), "blocks")
    volume = packs.agg(F.sum("volume")).first()[0] or 0
    # About one distinct n-gram of a block and order in ten bytes of its text.
    ranges = volume * settings.order // (10 * settings.range_keys) + 1
    runs = packs.select("block", "texts").mapInArrow(lambda it: _count(it, settings, ranges), RUN)
    sums = materialize(runs.groupBy("range").applyInArrow(_sum_range, RUN), "sums")
    # One row for each key range, of two numbers, added up before it comes here.
    totals = sums.where(F.col("block") == TOTALS).select(
        F.conv(F.hex("counts"), 16, 10).cast("decimal(38,0)").alias("tokens"),
        F.conv(F.hex("keys"), 16, 10).cast("decimal(38,0)").alias("types"),
    )
    tokens, types = (int(x or 0) for x in totals.agg(F.sum("tokens"), F.sum("types")).first())
    found = (
        packs.select("block", "texts")
        .groupBy("block")
        .cogroup(sums.where(F.col("block") != TOTALS).select("range", "block", "counts").groupBy("block"))
        .applyInArrow(lambda a, b: _score(a, b, tokens, types, settings), _SCORES)
    )
    return found.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )
