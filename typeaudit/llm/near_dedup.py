"""Near-duplicate documents: a multi-index Hamming join over b-bit MinHash signatures.

A document's set is its distinct word shingles. Its signature has ``chunks * width`` slots of 16 bits.
By pigeonhole, of two signatures that differ in fewer than ``chunks * (errors + 1)`` slots some chunk
pair differs in at most ``errors`` slots; every chunk is therefore indexed once for each choice of
``errors`` slots left out, and an equality join on these keys meets all such pairs. A pair at the
threshold that no chunk catches has a probability of about 2e-6 with the defaults. What met in a bucket is
screened by a lower bound of the sets' difference: each shingle toggles one of 1,024 bits, so sets differ in at
least as many shingles as their bits do. Links are confirmed on the full sets.

Scale: texts with equal sets are one node. The bucket keys move once, as rows of three numbers; sets and bits are dealt out by node
once and stay where they are for all rounds. A bucket is never expanded into its pairs while one pass over
its rows does the work: in the first rounds each bucket links its rows to one representative, confirmed
links are merged into components, and only what lies in *different* components of a bucket goes on to
the last round, which compares all of that. So a group of copies costs rows, not pairs, and no link
between different texts is lost. No step gathers a bucket in a task; the joins on keys can be split.

Cases: null, empty or blank texts have an empty set and no link. Repeated rows get equal results. Where a
``doc_id`` stands for several texts, each row is judged by its own text, whatever the order of the rows: its
component is that text's, named by the smallest ``doc_id`` of any row in it. Rows without ``doc_id`` get the
component of the texts with the same set, or null. Further columns of the input are ignored. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from typeaudit.llm import scan
from typeaudit.llm.components import smallest_reachable
from typeaudit.session import discard, materialize


class Settings(NamedTuple):
    shingle: int = 5
    percent: int = 80
    chunks: int = 10
    width: int = 5
    errors: int = 1
    star_rounds: int = 2


SCREEN = [f"s{i}" for i in range(16)]
SCREEN_BITS = 64 * len(SCREEN)
SIGNED = f"doc_id long, n_shingles long, d0 long, d1 long, {', '.join(f'{s} long' for s in SCREEN)}, keys array<long>"
SETS = "node long, members array<long>"


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, concatenated, and where each text's begin.

    A text with fewer words than ``width`` has its whole sequence as one shingle.
    """
    lower = scan.LOWER[data]
    spans = scan.words(lower, offsets, scan.NOT_BLANK)
    hashes = scan.range_hashes(scan.prefix_sums(lower), spans.start, spans.end)
    begin, text = scan.windows(spans.first, width)
    values = scan.window_hashes(hashes, width)[begin] if len(begin) else np.empty(0, np.uint64)
    count = np.diff(spans.first)
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        whole = [scan.window_hashes(hashes[spans.first[i] : spans.first[i + 1]], int(count[i]))[0] for i in short]
        values, text = np.concatenate((values, np.array(whole, np.uint64))), np.concatenate((text, short))
    if len(short):
        order = np.argsort(text, kind="stable")
        values, text = values[order], text[order]
    ends = np.searchsorted(text, np.arange(len(offsets)))
    for i in range(len(ends) - 1):
        values[ends[i] : ends[i + 1]].sort()
    if len(values):
        fresh = np.concatenate(([True], (values[1:] != values[:-1]) | (text[1:] != text[:-1])))
        values, text = values[fresh], text[fresh]
    return values, np.searchsorted(text, np.arange(len(offsets)))


def _factors(count: int) -> np.ndarray:
    return scan.mix(np.arange(1, count + 1, dtype=np.uint64)) | np.uint64(1)


def _signatures(values: np.ndarray, first: np.ndarray, settings: Settings) -> tuple[list[np.ndarray], np.ndarray]:
    """Digests and screens, as columns, and bucket keys of the texts whose set isn't empty."""
    sizes = np.diff(first)
    begin, sizes = first[:-1][sizes > 0], sizes[sizes > 0]
    slots = settings.chunks * settings.width
    factors = _factors(slots + 3)
    columns = [np.add.reduceat(scan.mix(values ^ f), begin) for f in factors[-2:]]
    bit = (scan.mix(values ^ factors[-3]) % np.uint64(SCREEN_BITS)).astype(np.int64)
    tally = np.bincount(np.repeat(np.arange(len(begin)) * SCREEN_BITS, sizes) + bit, minlength=len(begin) * SCREEN_BITS)
    screen = np.packbits((tally & 1).astype(np.uint8)).view(np.uint64).reshape(len(begin), -1)
    columns += [np.ascontiguousarray(screen[:, i]) for i in range(len(SCREEN))]
    lowest = np.empty((len(begin), slots), np.uint64)
    product = np.empty_like(values)
    for at, factor in enumerate(factors[:slots]):
        np.multiply(values, factor, out=product)
        lowest[:, at] = np.minimum.reduceat(product, begin)
    # The least product is small; which value it came from decides the bits, so they are mixed anew.
    signature = scan.mix(lowest) >> np.uint64(48)
    keys = []
    for chunk in range(settings.chunks):
        part = signature[:, chunk * settings.width : (chunk + 1) * settings.width]
        for left_out in combinations(range(settings.width), settings.errors):
            key = np.full(len(begin), len(keys), np.uint64)
            for slot in set(range(settings.width)) - set(left_out):
                key = scan.mix(key + part[:, slot] * factors[slot])
            keys.append(key)
    return columns, np.stack(keys, axis=1)


def _sign(settings: Settings, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    width = settings.chunks * len(list(combinations(range(settings.width), settings.errors)))
    for batch in (part for whole in batches for part in scan.slices(whole, "text")):
        values, first = shingle_sets(*scan.texts(batch.column("text")), settings.shingle)
        size = np.diff(first)
        some = size > 0
        if some.any():
            columns, keys = _signatures(values, first, settings)
        else:
            columns, keys = [np.empty(0, np.uint64)] * (2 + len(SCREEN)), np.empty((0, width), np.uint64)

        def column(of: np.ndarray) -> pa.Array:
            spread = np.zeros(len(size), np.int64)
            spread[some] = of.view(np.int64)
            return pa.array(spread, mask=~some)

        bounds = np.concatenate(([0], np.cumsum(some * width))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(keys.reshape(-1).view(np.int64)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), pa.array(size.astype(np.int64)), *map(column, columns), lists],
            ["doc_id", "n_shingles", "d0", "d1", *SCREEN, "keys"],
        )


def _members(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in scan.slices(whole, "text")):
        values, first = shingle_sets(*scan.texts(batch.column("text")), width)
        lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values.view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), lists], ["node", "members"])


def _sizes_may_link(a: str, b: str, settings: Settings) -> Column:
    least, most = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")
    return least * 100 >= most * settings.percent


def _bits_may_link(a: str, b: str, settings: Settings) -> Column:
    """Sizes and bits that a pair at the threshold can have; no pair at or above it is turned away."""
    col = lambda side, name: F.col(f"{side}.{name}")
    apart = sum((F.bit_count(col(a, s).bitwiseXOR(col(b, s))) for s in SCREEN), F.lit(0))
    # Of sets with the union u and the similarity p, (1 - p) * u shingles are in one only, and na + nb = (1 + p) * u.
    differing = (col(a, "n") + col(b, "n")) * (100 - settings.percent)
    return apart * (100 + settings.percent) <= differing


def _stars(rows: DataFrame, number: int, settings: Settings) -> DataFrame:
    """Pairs of each bucket's representative with the bucket's rows of other components."""
    order = F.col("node") if number == 0 else F.xxhash64("node", F.lit(number))
    heads = rows.groupBy("key").agg(F.min(F.struct(order.alias("order"), "node", "comp", "n")).alias("head"))
    heads = heads.select("key", "head.*").alias("h")
    met = rows.alias("r").join(heads, "key").where(
        (F.col("r.comp") != F.col("h.comp")) & _sizes_may_link("r", "h", settings)
    )
    return met.select(F.least("r.node", "h.node").alias("a"), F.greatest("r.node", "h.node").alias("b"))


def _across(rows: DataFrame, settings: Settings) -> DataFrame:
    """All pairs of a bucket that lie in different components and may link; ``rows`` have their bits, so no other pair is made."""
    met = rows.alias("l").join(rows.alias("r"), "key").where(
        (F.col("l.node") < F.col("r.node")) & (F.col("l.comp") != F.col("r.comp"))
        & _sizes_may_link("l", "r", settings) & _bits_may_link("l", "r", settings)
    )
    return met.select(F.col("l.node").alias("a"), F.col("r.node").alias("b"))


def _screened(pairs: DataFrame, screens: DataFrame, settings: Settings) -> DataFrame:
    """The pairs whose bits allow a link; each pair meets the bits of its nodes once, however many buckets it shares."""
    left, right = screens.alias("l"), screens.alias("r")
    sides = pairs.join(left, F.col("a") == F.col("l.node")).join(right, F.col("b") == F.col("r.node"))
    return sides.where(_bits_may_link("l", "r", settings)).select("a", "b")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    # The larger nodes come last: many pairs may have one representative as the smaller one.
    sides = pairs.join(sets.select(F.col("node").alias("a"), F.col("members").alias("ma")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("members").alias("mb")), "b"
    )
    shared = F.size(F.array_intersect("ma", "mb")).cast("long")
    return sides.where(shared * 100 >= (F.size("ma").cast("long") + F.size("mb") - shared) * percent).select("a", "b")


def _placed(rows: DataFrame, repeated: bool) -> DataFrame:
    """``rows`` dealt out by ``node`` once and kept on the executors' disks, so that no join on ``node`` moves them again.

    Where rows are ``repeated``, one of each node is kept.
    """
    count = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(count, "node")
    return (dealt.dropDuplicates(["node"]) if repeated else dealt).persist(StorageLevel.DISK_ONLY)


def near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: ``doc_id, n_shingles, component_id, kept``.

    ``component_id`` is the smallest ``doc_id`` reachable over links (itself included); ``kept`` says
    that the document is that one.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = _signed(texts, settings)
    digest = F.struct("d0", "d1")
    seen = signed.where("doc_id is not null and d0 is not null").groupBy(F.col("doc_id").alias("id"))
    again = seen.agg((F.min(digest) < F.max(digest)).alias("differ"), F.count("*").alias("rows")).where("rows > 1")
    again = materialize(again, "several")
    several = again.where("differ").select("id")
    if several.isEmpty():
        return _linked(texts, signed, settings, not again.isEmpty())
    # Each text of such an id is a document of its own under a key made from both.
    hashed = F.xxhash64("doc_id", "text").bitwiseAND(F.lit(HASHED - 1)).bitwiseOR(F.lit(HASHED))
    keyed = texts.join(several, F.col("doc_id") == F.col("id"), "left").select(
        F.when(F.col("id").isNull(), F.col("doc_id")).otherwise(hashed).alias("doc_id"), "text", "id"
    )
    ids = materialize(keyed.where("id is not null").select(F.col("doc_id").alias("key"), "id").distinct(), "ids")
    keyed = materialize(keyed.select("doc_id", "text"), "texts")
    found = _linked(keyed, _signed(keyed, settings), settings, True)
    found = materialize(found.join(ids, F.col("doc_id") == F.col("key"), "left").select(
        F.coalesce("id", "doc_id").alias("doc_id"), "n_shingles", F.col("component_id").alias("class")
    ), "classes")
    # Keys made from hashes do not follow the ids they stand for, so the smallest id is looked for here.
    least = found.where("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("least"))
    component = F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id"))
    return _kept(found.join(least, "class", "left").select("doc_id", "n_shingles", component.alias("component_id")))


def _kept(found: DataFrame) -> DataFrame:
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def _signed(texts: DataFrame, settings: Settings) -> DataFrame:
    return materialize(scan.mapped(texts, lambda it: _sign(settings, it), SIGNED), "signatures")


def _linked(texts: DataFrame, signed: DataFrame, settings: Settings, repeated: bool) -> DataFrame:
    """The result for texts of which no two that differ share a ``doc_id``; ``repeated`` if some ``doc_id`` has several rows."""
    nodes = signed.where("d0 is not null").groupBy("d0", "d1").agg(F.min("doc_id").alias("node"))
    own = signed.where("d0 is not null").join(nodes, ["d0", "d1"]).where("doc_id = node")
    # A bucket's rows lie side by side in one sort. Repeated rows of a node are neighbours, and the first stands for all.
    beside = W.partitionBy("key").orderBy("node")
    bucket = beside.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    entries = own.select(F.explode("keys").alias("key"), "node", F.col("n_shingles").alias("n")).select(
        "*",
        F.lag("node").over(beside).alias("before"),
        (F.min("node").over(bucket) < F.max("node").over(bucket)).alias("shared"),
    )
    once = F.col("shared") & ~F.col("before").eqNullSafe(F.col("node"))
    buckets = materialize(entries.where(once).select("key", "node", "n"), "buckets")
    wanted = buckets.select("node").distinct()
    screens = _placed(
        signed.withColumnRenamed("doc_id", "node").join(wanted, "node", "left_semi")
        .select("node", F.col("n_shingles").alias("n"), *SCREEN), repeated
    )
    chosen = texts.where("doc_id is not null").join(wanted, F.col("doc_id") == F.col("node"), "left_semi")
    sets = _placed(scan.mapped(chosen, lambda it: _members(settings.shingle, it), SETS), repeated)

    rows, done = buckets.withColumn("comp", F.col("node")), [buckets]
    links = tried = components = None
    for number in range(settings.star_rounds + 1):
        if number < settings.star_rounds:
            pairs = _screened(_stars(rows, number, settings).distinct(), screens, settings)
        else:
            pairs = _across(rows.join(screens.drop("n"), "node"), settings).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "pairs")
        done.append(pairs)
        found = _confirmed(pairs, sets, settings.percent)
        tried = pairs if tried is None else tried.unionByName(pairs)
        # What the components so far say is kept as links to their smallest node.
        links = found if components is None else found.unionByName(
            components.select(F.col("node").alias("a"), F.col("component").alias("b"))
        )
        components = smallest_reachable(links)
        if number < settings.star_rounds:
            rows = buckets.join(components, "node", "left").select(
                "key", "node", "n", F.coalesce("component", "node").alias("comp")
            )
            apart = rows.groupBy("key").agg((F.min("comp") < F.max("comp")).alias("apart")).where("apart").select("key")
            rows = materialize(rows.join(apart, "key"), "open")
            done.append(rows)
    screens.unpersist()
    sets.unpersist()
    # The components are written; nothing reads the steps before them again.
    for step in done:
        discard(step)
    labels = nodes.join(components, "node", "left").select("d0", "d1", F.coalesce("component", "node").alias("class"))
    component = F.when(F.col("d0").isNull(), F.col("doc_id")).otherwise(F.col("class"))
    return _kept(signed.join(labels, ["d0", "d1"], "left").select("doc_id", "n_shingles", component.alias("component_id")))


#: Keys made from hashes begin here; smaller ids are keys themselves.
HASHED = 1 << 62


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, made longer until no column has it; columns are told apart without regard to case."""
    taken = {column.lower() for column in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_row_key(docs: DataFrame, name: str) -> DataFrame:
    """``docs(doc_id, text, ..)`` with a key that only rows of equal ``doc_id`` and text share, as column ``name``.

    It is the ``doc_id``, so that the order of ids is kept; rows without one, and rows whose ``doc_id`` stands for
    several texts, get a hash of both, larger than any such id. Null and empty texts are told apart. ``name`` must be
    free in ``docs``; see ``free_name``.
    """
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    hashed = F.xxhash64(doc_id.isNull(), doc_id, text.isNull(), text)
    hashed = hashed.bitwiseAND(F.lit(HASHED - 1)).bitwiseOR(F.lit(HASHED))
    again = free_name(docs, "several")
    seen = docs.where("doc_id is not null").groupBy(doc_id.alias(again)).agg((F.min(hashed) < F.max(hashed)).alias("differ"))
    several = materialize(seen.where("differ").select(again), "several")
    own = doc_id.isNotNull() & (doc_id < HASHED)
    if several.isEmpty():
        return docs.withColumn(name, F.when(own, doc_id).otherwise(hashed))
    met = docs.join(several, doc_id == F.col(again), "left")
    return met.withColumn(name, F.when(own & F.col(again).isNull(), doc_id).otherwise(hashed)).drop(again)


def row_components(keyed: DataFrame, key: str, settings: Settings = Settings()) -> DataFrame:
    """``key, component``, once for each key of ``with_row_key``; the component is its smallest key, null without a word in the text."""
    found = near_duplicates(keyed.select(F.col(key).alias("doc_id"), "text"), settings)
    component = F.when(F.col("n_shingles") > 0, F.col("component_id"))
    return found.groupBy(F.col("doc_id").alias("key")).agg(F.min(component).alias("component"))
