"""Phrases that occur more often than their parts make likely, by prefix-free parsing of the corpus.

Texts are cut at punctuation into pieces, pieces into words. A word from which on the next ``overlap`` words hash to 0 modulo ``modulus``
is a trigger; what lies between two triggers, with the overlap that begins the next one, is a chunk. As triggers depend on the words alone, equal
passages give equal chunks whatever stands around them. A chunk owns the places before its overlap, so each window of ``overlap + 1`` words
lies whole in the one chunk that owns its first place.

1. Texts become chunks; distinct chunks with their frequency are the dictionary, kept in blocks of some two megabytes.
2. Each block sends the hashes of its distinct word pairs with their weighted counts, dealt by hash; what comes back is a bit for each, whether the pair
   reaches ``least`` in the corpus. Hashes only leave out: pairs that share one can only be kept for longer.
3. Every owned place of a distinct chunk begins phrases, weighted with the chunk's frequency: a word, and longer ones as long as each pair in them has its bit.
   A phrase with ``least`` occurrences holds only such pairs, so its count is whole. Counts go by the phrase itself, not by a hash.
4. Phrases meet their parts (cuts) and the longer phrases that hold them by joins on (lang, phrase).

Scale: copies and shared passages shrink to dictionary entries before anything is counted; pairs move as sorted, compressed runs, and longer phrases
only where they can be frequent. Every count is a partial sum before it moves, so neither a hot language nor a hot phrase makes a hot task; a hot
pair comes once from each block. Buckets of pairs grow in number with the corpus, not in size; runs get shorter with that, down to a row for each pair
in a block (beyond some ten terabytes). The last ranks are taken in salted parts first, so a language with a third of all phrases sends ``top`` rows for each
part. A chunk ends after ``longest`` words even without trigger, which changes no count.

Cases: null and empty texts have no words. A null ``lang`` is ``und``. Only A-Z are lower-cased. Repeated rows count as often as they stand. Ties of a score go
by count, then by the phrase's bytes. Columns other than ``text`` and ``lang`` are ignored. An empty table gives no phrase.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from typeaudit.llm import scan
from typeaudit.session import materialize


class Settings(NamedTuple):
    #: Words of the longest phrase, two at least.
    words: int = 4
    #: Occurrences a phrase must have.
    least: int = 30
    #: Per cent of a phrase's occurrences that a longer one may hold.
    held: int = 80
    #: Phrases returned for each language.
    top: int = 2000
    #: One place in so many is a trigger.
    modulus: int = 24
    #: Words that a chunk owns at most.
    longest: int = 4096
    #: Text bytes of a block.
    block_bytes: int = 2 << 20
    #: Pairs of a bucket, about.
    bucket_pairs: int = 2 << 20


SCALE = 2_000_000
UNDEFINED = "und"
_BLANK = scan.byte_class((0x20, 0x20), (0x09, 0x09))
_MARK = scan.byte_class((0x0A, 0x0D), *[(ord(c), ord(c)) for c in ".,;:!?"])
_IN_WORD = ~(_BLANK | _MARK)
_PARTS = 32

_CHUNKS = "chunk string, freq long"
_BLOCKS = "block long, places long, rows binary"
_PAIRS = "bucket long, block long, pairs binary, counts binary"
_BITS = "block long, bucket long, n int, bits binary"
_PHRASES = "lang string, phrase string, n long"

#: Bits of a pair's hash.
_HASH_BITS = 40
#: After the words of a chunk come a line feed, how many of them are overlap (from this character on), and the language.
_OVERLAP = 0x30


# --- parsing -----------------------------------------------------------------------------


class Chunks(NamedTuple):
    """Chunk i is the words ``begin[i]`` up to ``end[i]`` and owns ``own[i]`` places."""

    begin: np.ndarray
    end: np.ndarray
    own: np.ndarray


def pieces(data: np.ndarray, words: scan.Spans) -> np.ndarray:
    """Numbers of the words that begin a piece: the first of a text, and those after a mark."""
    marks = np.concatenate(([0], np.cumsum(_MARK[data])))
    fresh = np.ones(len(words.start), bool)
    fresh[1:] = marks[words.start[1:]] > marks[words.end[:-1]]
    fresh[words.first[:-1][np.diff(words.first) > 0]] = True
    return np.flatnonzero(fresh)


def parse(hashes: np.ndarray, piece: np.ndarray, settings: Settings) -> Chunks:
    """``hashes`` of all words and the first word of each piece, to chunks."""
    count, overlap = len(hashes), settings.words - 1
    if not count:
        return Chunks(*[np.empty(0, np.int64)] * 3)
    piece_end = np.concatenate((piece[1:], [count]))
    owner = np.repeat(np.arange(len(piece)), piece_end - piece)
    opens = np.zeros(count, bool)
    if overlap and count >= overlap:
        keys = scan.window_hashes(hashes, overlap)
        at = np.flatnonzero(keys % np.uint64(settings.modulus) == 0)
        opens[at[at + overlap <= piece_end[owner[at]]]] = True
    opens[piece] = True
    begin = np.flatnonzero(opens)
    # Long runs without a trigger are cut at a fixed distance.
    size = np.diff(np.concatenate((begin, [count])))
    for first, length in zip(begin[size > settings.longest], size[size > settings.longest], strict=True):
        opens[first : first + length : settings.longest] = True
    begin = np.flatnonzero(opens)
    stop = np.concatenate((begin[1:], [count]))
    end = np.minimum(stop + overlap, piece_end[owner[begin]])
    return Chunks(begin, end, stop - begin)


def _gathered(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """Strings of the bytes ``begin[i]`` up to ``end[i]``, which may overlap."""
    size = end - begin
    offsets = np.concatenate(([0], np.cumsum(size)))
    source = np.arange(offsets[-1], dtype=np.int64) + np.repeat(begin - offsets[:-1], size)
    return pa.Array.from_buffers(
        pa.large_string(), len(begin), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[source])]
    )


def _joined(data: np.ndarray, words: scan.Spans) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words with one blank after each, and where each begins and ends in that."""
    size = words.end - words.start
    end = np.cumsum(size + 1) - 1
    start = end - size
    inside = np.ones(int(end[-1]) + 1 if len(end) else 0, bool)
    inside[end] = False
    out = np.full(len(inside), 0x20, np.uint8)
    held = np.zeros(len(data) + 1, np.int8)
    held[words.start] += 1
    np.subtract.at(held, words.end, 1)
    out[inside] = data[np.cumsum(held[:-1]) > 0]
    return out, start, end


def _chunks(batches: Iterator[pa.RecordBatch], settings: Settings) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in scan.slices(whole, "text")):
        data, offsets = scan.texts(batch.column("text"))
        data = scan.LOWER[data]
        words = scan.words(data, offsets, _IN_WORD)
        if not len(words.start):
            continue
        hashes = scan.range_hashes(scan.prefix_sums(data), words.start, words.end)
        found = parse(hashes, pieces(data, words), settings)
        out, start, end = _joined(data, words)
        lang = batch.column("lang").cast(pa.large_string())
        marks = pa.array([f"\n{chr(_OVERLAP + n)}" for n in range(settings.words)], pa.large_string())
        mark = marks.take(pa.array(found.end - found.begin - found.own))
        texts = _gathered(out, start[found.begin], end[found.end - 1])
        keys = pc.binary_join_element_wise(texts, mark, lang.take(pa.array(words.text[found.begin])), pa.scalar("", pa.large_string()))
        counted = pa.table({"chunk": keys}).group_by("chunk").aggregate([([], "count_all")])
        yield from counted.rename_columns(["chunk", "freq"]).cast(pa.schema([("chunk", pa.string()), ("freq", pa.int64())])).to_batches()


# --- the dictionary ----------------------------------------------------------------------


def _packed(batches: Iterator[pa.RecordBatch], settings: Settings) -> Iterator[pa.RecordBatch]:
    """Dictionary rows to blocks."""
    at, held, size = TaskContext.get().partitionId() << 33, [], 0

    def block() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        packed = [pa.array([at]), pa.array([len(_Block(rows).hashes)]), pa.array([_frozen(rows)], pa.binary())]
        return pa.RecordBatch.from_arrays(packed, ["block", "places", "rows"])

    for batch in (part for whole in batches for part in scan.slices(whole, "chunk", settings.block_bytes, settings.block_bytes)):
        held.append(batch)
        size += batch.nbytes
        if size >= settings.block_bytes:
            yield block()
            at, held, size = at + 1, [], 0
    if held:
        yield block()


def _frozen(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


class _Block:
    """Chunks of the dictionary with their words; ``own`` and ``freq`` by chunk, the other arrays by word."""

    def __init__(self, batch: pa.RecordBatch | bytes):
        if isinstance(batch, bytes):
            batch = pa.ipc.open_stream(batch).read_all().combine_chunks().to_batches()[0]
        self.data, offsets = scan.texts(batch.column("chunk"))
        freq = batch.column("freq").to_numpy()
        feeds = np.flatnonzero(self.data == 10)
        # The first line feed ends the words; a language may hold others.
        stop = feeds[np.searchsorted(feeds, offsets[:-1])]
        overlaps = self.data[stop + 1].astype(np.int64) - _OVERLAP
        langs = _gathered(self.data, stop + 2, offsets[1:])
        found = scan.words(self.data, offsets, _NOT_SPACE)
        inside = found.start < stop[found.text]
        self.start, self.end, self.chunk = found.start[inside], np.minimum(found.end, stop[found.text])[inside], found.text[inside]
        count = np.bincount(self.chunk, minlength=len(stop))
        first = np.concatenate(([0], np.cumsum(count)))
        sums = scan.prefix_sums(self.data)
        of_lang = scan.mix(scan.range_hashes(sums, stop + 2, offsets[1:]))
        self.hashes = scan.range_hashes(sums, self.start, self.end) ^ of_lang[self.chunk]
        self.left = first[1:][self.chunk] - np.arange(len(self.chunk))
        self.langs, self.freq, self.overlaps = langs, freq[self.chunk], overlaps

    def owned(self) -> np.ndarray:
        return self.left > self.overlaps[self.chunk]

    def pairs(self, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct hashes of the pairs, the sum of the weights of each, and for each word the place of its pair (-1: none)."""
        place = np.full(len(self.hashes), -1, np.int64)
        begins = np.flatnonzero(self.left[:-1] > 1) if len(self.left) else np.empty(0, np.int64)
        keys = scan.window_hashes(self.hashes, 2)[begins] >> np.uint64(64 - _HASH_BITS)
        distinct, inverse = np.unique(keys, return_inverse=True)
        place[begins] = inverse
        totals = np.zeros(len(distinct), np.int64)
        np.add.at(totals, inverse, weights[begins])
        return distinct, totals, place


_NOT_SPACE = ~scan.byte_class((0x20, 0x20))


def dictionary(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``chunk, freq``: the distinct chunks (words, size of the overlap, language) and how often each occurs."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(UNDEFINED))
    chosen = docs.select(lang.alias("lang"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(lambda it: _chunks(it, settings), _CHUNKS).groupBy("chunk").agg(F.sum("freq").alias("freq"))


# --- pairs that can be frequent ----------------------------------------------------------


def _thin(values: np.ndarray) -> bytes:
    """Integers from 0 on, compressed; high bytes of small ones cost nothing."""
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8).T
    return pa.compress(np.ascontiguousarray(planes), codec="zstd", asbytes=True)


def _wide_again(packed: bytes, count: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, count * 8, "zstd", asbytes=True), np.uint8).reshape(8, count)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1)


def _pairs_of(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """The pairs of each block, a row for each bucket: sizes in front of steps between sorted hashes."""
    for batch in batches:
        for number, rows in zip(batch.column("block").to_pylist(), batch.column("rows"), strict=True):
            block = _Block(rows.as_py())
            distinct, totals, _ = block.pairs(np.where(block.owned(), block.freq, 0))
            buckets = (distinct >> np.uint64(_HASH_BITS - bits)).astype(np.int64)
            found = []
            for begin, size in zip(*scan.runs(buckets), strict=True):
                of_bucket = distinct[begin : begin + size]
                steps = np.diff(of_bucket, prepend=np.uint64(0))
                head = int(size).to_bytes(8, "little")
                found.append((int(buckets[begin]), number, head + _thin(steps), _thin(totals[begin : begin + size])))
            columns = list(zip(*found, strict=True)) or [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["bucket", "block", "pairs", "counts"]
            )


def _bits_of(table: pa.Table, least: int) -> pa.Table:
    """All runs of one bucket: which of their pairs reach ``least`` together."""
    sizes = [int.from_bytes(run.as_py()[:8], "little") for run in table.column("pairs")]
    runs = [np.cumsum(_wide_again(run.as_py()[8:], n), dtype=np.uint64) for run, n in zip(table.column("pairs"), sizes, strict=True)]
    counts = [_wide_again(run.as_py(), n) for run, n in zip(table.column("counts"), sizes, strict=True)]
    distinct, inverse = np.unique(np.concatenate(runs), return_inverse=True)
    totals = np.zeros(len(distinct), np.int64)
    np.add.at(totals, inverse, np.concatenate(counts).astype(np.int64))
    flags = np.split((totals >= least)[inverse], np.cumsum(sizes)[:-1])
    bits = [np.packbits(part).tobytes() for part in flags]
    return pa.table(
        {"block": table.column("block"), "bucket": table.column("bucket"), "n": pa.array(sizes, pa.int32()), "bits": pa.array(bits, pa.binary())}
    )


# --- counting ----------------------------------------------------------------------------


def _phrases(blocks: pa.Table, bits: pa.Table, settings: Settings) -> pa.Table:
    """The phrases of one block, of pairs with their bit, and the number of its words under the empty phrase."""
    found = []
    bits = bits.sort_by("bucket")
    flags = [np.unpackbits(np.frombuffer(b.as_py(), np.uint8), count=n.as_py()) for b, n in zip(bits.column("bits"), bits.column("n"), strict=True)]
    flags = np.concatenate([*flags, np.zeros(1, np.uint8)]).astype(bool)
    for rows in blocks.column("rows"):
        block = _Block(rows.as_py())
        _, _, place = block.pairs(block.freq)
        linked = flags[place]
        begins = np.flatnonzero(block.owned())
        for size in range(1, settings.words + 1):
            if size > 1:
                begins = begins[block.left[begins] >= size]
                begins = begins[linked[begins + size - 2]]
            texts = _gathered(block.data, block.start[begins], block.end[begins + size - 1])
            lang = block.langs.take(pa.array(block.chunk[begins]))
            counted = pa.table({"lang": lang, "phrase": texts, "n": pa.array(block.freq[begins])})
            found.append(counted.group_by(["lang", "phrase"]).aggregate([("n", "sum")]).rename_columns(["lang", "phrase", "n"]))
            if size == 1:
                total = counted.group_by("lang").aggregate([("n", "sum")]).rename_columns(["lang", "n"])
                nothing = pa.array([""] * total.num_rows, pa.large_string())
                found.append(total.add_column(1, "phrase", nothing))
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])
    return pa.concat_tables(found).cast(schema)


def _size(phrase: Column) -> Column:
    return F.length(phrase) - F.length(F.replace(phrase, F.lit(" "), F.lit(""))) + 1


def phrase_counts(chunks: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``lang, phrase, size, f`` of all phrases with ``least`` occurrences; of size 0, the number of words of the language."""
    # One set of files; both passes over it number places alike.
    blocks = materialize(chunks.mapInArrow(lambda it: _packed(it, settings), _BLOCKS), "dictionary")
    places = blocks.agg(F.sum("places")).first()[0] or 0
    bits = min(max(-(-places // settings.bucket_pairs) - 1, 0).bit_length(), _HASH_BITS)
    pairs = blocks.select("block", "rows").mapInArrow(lambda it: _pairs_of(it, bits), _PAIRS)
    flags = pairs.groupBy("bucket").applyInArrow(lambda table: _bits_of(table, settings.least), _BITS)
    met = blocks.select("block", "rows").groupBy("block").cogroup(flags.groupBy("block"))
    found = met.applyInArrow(lambda left, right: _phrases(left, right, settings), _PHRASES)
    counted = found.groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
    size = F.when(F.col("phrase") == "", 0).otherwise(_size(F.col("phrase"))).cast("int")
    return counted.where((F.col("f") >= settings.least) | (F.col("phrase") == "")).select("lang", "phrase", size.alias("size"), "f")


def _wide(value: Column) -> Column:
    return value.cast("decimal(20,0)")


def _part(words: Column, begin: Column | int, count: Column | int) -> Column:
    return F.array_join(F.slice(words, begin, count), " ")


def scored(counts: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``lang, phrase, a, l, r, score`` of all candidates that no longer one holds too often."""
    candidates = counts.where("size > 1").withColumn("words", F.split("phrase", " "))
    size = F.col("size")
    cuts = candidates.select(
        "lang", "phrase", "f",
        F.explode(F.transform(F.sequence(F.lit(1), size - 1), lambda k: F.struct(
            k.alias("k"), _part(F.col("words"), F.lit(1), k).alias("head"), _part(F.col("words"), k + 1, F.col("size") - k).alias("rest"),
        ))).alias("cut"),
    ).select("lang", "phrase", "f", "cut.*")
    counts = counts.where("size > 0")
    heads = counts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    rests = counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    # A part occurs at least as often as the phrase, so each is there.
    met = cuts.join(heads, ["lang", "head"]).join(rests, ["lang", "rest"])
    score = F.try_divide(_wide(F.col("f")) * F.lit(SCALE).cast("decimal(10,0)"), _wide(F.col("l")) + _wide(F.col("r")))
    least = F.min(F.struct(F.floor(score).cast("long").alias("score"), "k", "l", "r")).alias("least")
    rated = met.groupBy("lang", "phrase").agg(F.max("f").alias("a"), least)
    inner = F.transform(
        F.sequence(F.lit(2), size - 1),
        lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda at: _part(F.col("words"), at, n)),
    )
    held = candidates.where("size > 2").select("lang", F.explode(F.array_distinct(F.flatten(inner))).alias("phrase"), "f")
    held = held.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = rated.join(held, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (_wide(F.col("longer")) * 100 < _wide(F.col("a")) * settings.held)
    )
    return kept.select("lang", "phrase", "a", "least.l", "least.r", "least.score")


def collocations(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best phrases of each language; n counts all its words."""
    counts = materialize(phrase_counts(dictionary(docs, settings), settings), "counts")
    totals = counts.where("size = 0").select("lang", F.col("f").alias("n"))
    by = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    parts = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(_PARTS))).orderBy(*by)
    first = scored(counts, settings).withColumn("rank", F.row_number().over(parts)).where(F.col("rank") <= settings.top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by))).where(F.col("rank") <= settings.top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
