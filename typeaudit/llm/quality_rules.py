"""Quality rules: decision lists learned by sequential covering, applied as Spark conditional expressions.

1. ``measure`` adds counts of each whole text in one narrow pass.
2. ``learn`` fits on at most ``sample_rows`` labelled rows, taken in the order of a hash of ``doc_id``:
   marked terms (words, and beginnings of words) are picked greedily by the toxic rows that no earlier term
   covers; then conjunctions of thresholds are grown by information gain on two thirds of the sample,
   pruned on the other third, and kept while their precision there holds.
3. ``DecisionList.verdict`` is one ordered ``CASE`` over the measured columns; the first rule that fits rejects.

Scale: two scans of the texts, the first only for the sampled ids, and no shuffle of texts; state on the
driver is bounded by ``sample_rows``. Measures look at whole texts and at nothing outside the row, so no key is hot.

Cases: null and empty texts have no words and fail the base rule. Labels that are null or name no document are not used;
of several labels of a document the worst counts. Without usable labels the list is empty and only the
base rule rejects. Repeated rows get equal verdicts. All columns of the input stay in ``row``, so their names
cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from typeaudit.llm import scan


class Settings(NamedTuple):
    #: Bound of the labelled rows that the rules are learned from.
    sample_rows: int = 30_000
    min_words: int = 10
    max_repeat_percent: int = 20
    window: int = 5
    #: Lengths in bytes of the beginnings of words that may be marked.
    beginnings: tuple[int, ...] = (4, 5, 6)
    term_precision: float = 0.95
    #: Chance of any meaningless term passing by its counts alone.
    term_error: float = 0.01
    rule_precision: float = 0.95
    min_covered: int = 3
    max_conditions: int = 4


COUNTS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_distinct_words", "n_upper", "n_digits", "n_exclaims", "n_marked",
]
#: What thresholds are put on: a count for each unit of another.
RATIOS = {
    "mean_word_chars": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "distinct_share": ("n_distinct_words", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "digit_share": ("n_digits", "word_chars"),
    "exclaims_per_word": ("n_exclaims", "n_words"),
    "words": ("n_words", None),
    "marked": ("n_marked", None),
    "marked_share": ("n_marked", "n_words"),
}
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_UPPER, _DIGIT, _EXCLAIM = scan.byte_class((65, 90)), scan.byte_class((48, 57)), scan.byte_class((33, 33))
_WHOLE = np.uint64(0xA5A5A5A5A5A5A5A5)


def _per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(flags)))[bounds])


def _repeats(values: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts (text, value), and for each place in it the length of its run of equals."""
    keys = scan.mix(values ^ scan.mix(text.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(keys)
    begin, length = scan.runs(keys[order])
    return order, np.repeat(length, length)


def _terms(lower: np.ndarray, offsets: np.ndarray, beginnings: tuple[int, ...]) -> tuple[scan.Spans, list[np.ndarray]]:
    """Words, and hashes of each and of its beginnings; 0 where a word is shorter."""
    spans = scan.words(lower, offsets, scan.ALPHANUMERIC)
    sums = scan.prefix_sums(lower)
    found = [scan.range_hashes(sums, spans.start, spans.end) ^ _WHOLE]
    for size in beginnings:
        long = spans.end - spans.start > size
        found.append(np.where(long, scan.range_hashes(sums, spans.start, np.minimum(spans.start + size, spans.end)), np.uint64(0)))
    return spans, found


def text_counts(data: np.ndarray, offsets: np.ndarray, marked: np.ndarray, settings: Settings) -> dict[str, np.ndarray]:
    """The columns of COUNTS for each text."""
    spans = scan.words(data, offsets, scan.NOT_BLANK)
    filled = scan.NOT_BLANK[data]
    sums = scan.prefix_sums(data)
    texts = len(offsets) - 1

    pieces = scan.lines(data, offsets)
    so_far = np.concatenate(([0], np.cumsum(filled)))
    with_word = so_far[pieces.end] > so_far[pieces.start]
    piece_text = pieces.text[with_word]
    order, length = _repeats(scan.range_hashes(sums, pieces.start[with_word], pieces.end[with_word]), piece_text)
    # Each run of n equal lines counts n - 1, spread evenly over its places.
    dup_lines = np.rint(np.bincount(piece_text[order], (length - 1) / length, texts)).astype(np.int64)

    begin, text = scan.windows(spans.first, settings.window)
    words = scan.range_hashes(sums, spans.start, spans.end)
    order, length = _repeats(scan.window_hashes(words, settings.window)[begin], text)
    twice = begin[order[length > 1]]
    change = np.bincount(twice, minlength=len(words) + 1) - np.bincount(twice + settings.window, minlength=len(words) + 1)[: len(words) + 1]
    repeated = np.cumsum(change)[: len(words)] > 0
    order, length = _repeats(words, spans.text)
    distinct = np.rint(np.bincount(spans.text[order], 1 / length, texts)).astype(np.int64)

    counts = {
        "n_words": np.diff(spans.first),
        "word_chars": _per_text(filled & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": _per_text(_SYMBOL[data], offsets),
        "n_dup_lines": dup_lines,
        "n_repeat_words": _per_text(repeated, spans.first),
        "n_lines": _per_text(with_word, pieces.first),
        "n_distinct_words": distinct,
        "n_upper": _per_text(_UPPER[data], offsets),
        "n_digits": _per_text(_DIGIT[data], offsets),
        "n_exclaims": _per_text(_EXCLAIM[data], offsets),
    }
    if len(marked):
        spans, found = _terms(scan.LOWER[data], offsets, settings.beginnings)
        pairs = []
        for hashes in found:
            at = np.minimum(np.searchsorted(marked, hashes), len(marked) - 1)
            hit = np.flatnonzero(marked[at] == hashes)
            pairs.append((np.searchsorted(spans.first, hit, side="right") - 1) * len(marked) + at[hit])
        counts["n_marked"] = np.bincount(np.unique(np.concatenate(pairs)) // len(marked), minlength=texts)
    else:
        counts["n_marked"] = np.zeros(texts, np.int64)
    return counts


def measure(docs: DataFrame, marked: np.ndarray, settings: Settings = Settings(), text: str = "text") -> DataFrame:
    """``row`` (all columns of ``docs``) and the columns of COUNTS."""
    field = docs.columns.index(text)
    schema = T.StructType([T.StructField("row", docs.schema), *(T.StructField(c, T.LongType()) for c in COUNTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            rows = whole.column(0)
            whole = pa.RecordBatch.from_arrays([rows, rows.field(field)], ["row", "text"])
            for batch in scan.slices(whole, "text"):
                counts = text_counts(*scan.texts(batch.column("text")), marked, settings)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row"), *(pa.array(counts[c].astype(np.int64)) for c in COUNTS)], ["row", *COUNTS]
                )

    return scan.mapped(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")), run, schema)


def base_failed(settings: Settings = Settings()) -> Column:
    return (F.col("n_words") < settings.min_words) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * settings.max_repeat_percent
    )


class Condition(NamedTuple):
    feature: str
    at_least: bool
    threshold: float

    def column(self) -> Column:
        count, unit = RATIOS[self.feature]
        value = F.col(count).cast("double")
        if unit:
            value = value / F.greatest(F.col(unit), F.lit(1)).cast("double")
        return value >= self.threshold if self.at_least else value <= self.threshold

    def holds(self, values: dict[str, np.ndarray]) -> np.ndarray:
        found = values[self.feature]
        return found >= self.threshold if self.at_least else found <= self.threshold


class DecisionList(NamedTuple):
    rules: list[list[Condition]]
    #: Sorted hashes of the marked terms.
    marked: np.ndarray

    def verdict(self) -> Column:
        """True unless a rule rejects; rules in the order they were learned."""
        if not self.rules:
            return F.lit(True)
        chain = F
        for rule in self.rules:
            held = F.lit(True)
            for condition in rule:
                held &= condition.column()
            chain = chain.when(held, F.lit(False))
        return chain.otherwise(F.lit(True))


def _ratios(counts: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {
        name: counts[count] / (np.maximum(counts[unit], 1) if unit else 1.0) for name, (count, unit) in RATIOS.items()
    }


def _grow(values: dict[str, np.ndarray], bad: np.ndarray, most: int) -> list[Condition]:
    """Adds the threshold of the largest information gain until only bad rows are covered."""
    rule: list[Condition] = []
    covered = np.ones(len(bad), bool)
    while len(rule) < most and (covered & ~bad).any():
        p, n = (covered & bad).sum(), (covered & ~bad).sum()
        before = np.log2(p / (p + n))
        best, chosen = 1e-9, None
        for name, every in values.items():
            inside = every[covered]
            order = np.argsort(inside, kind="stable")
            ordered, marks = inside[order], bad[covered][order]
            cuts = np.flatnonzero(ordered[1:] > ordered[:-1])
            if not len(cuts):
                continue
            below = np.cumsum(marks)[cuts]
            middle = (ordered[cuts] + ordered[cuts + 1]) / 2
            for at_least, good in ((False, below), (True, p - below)):
                size = cuts + 1 if not at_least else len(ordered) - cuts - 1
                gain = good * (np.log2(np.maximum(good, 1e-12) / size) - before)
                top = int(np.argmax(gain))
                if gain[top] > best:
                    best, chosen = gain[top], Condition(name, at_least, float(middle[top]))
        if chosen is None:
            break
        rule.append(chosen)
        covered &= chosen.holds(values)
    return rule


def _covers(rule: list[Condition], values: dict[str, np.ndarray], rows: int) -> np.ndarray:
    covered = np.ones(rows, bool)
    for condition in rule:
        covered &= condition.holds(values)
    return covered


def cover(counts: dict[str, np.ndarray], bad: np.ndarray, held_back: np.ndarray, settings: Settings) -> list[list[Condition]]:
    """Ordered rules for the bad rows: grown on some rows, pruned and judged on those ``held_back``."""
    values = _ratios(counts)
    left, rules = np.ones(len(bad), bool), []
    while (left & bad & ~held_back).any():
        pick = lambda flags: {k: v[flags] for k, v in values.items()}
        growing, judging = left & ~held_back, left & held_back
        grown = _grow(pick(growing), bad[growing], settings.max_conditions)
        judged, truth = pick(judging), bad[judging]

        def worth(rule: list[Condition]) -> tuple[float, int]:
            covered = _covers(rule, judged, len(truth))
            p, n = (covered & truth).sum(), (covered & ~truth).sum()
            return ((p - n) / (p + n) if p + n else -1.0), p

        rule = max((grown[:k] for k in range(len(grown), 0, -1)), key=lambda r: worth(r), default=[])
        score, covered = worth(rule)
        if not rule or covered < settings.min_covered or (score + 1) / 2 < settings.rule_precision:
            break
        rules.append(rule)
        left &= ~_covers(rule, values, len(bad))
    return rules


def _labelled(docs: DataFrame, labels: DataFrame, settings: Settings) -> DataFrame:
    """``doc_id, text, quality, toxic`` of the sampled labelled rows, one for each distinct text."""
    worst = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(
        F.min("quality").alias("quality"), F.max("toxic").alias("toxic")
    )
    picked = worst.orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.sample_rows)
    # At most sample_rows rows of three numbers.
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")


def _sampled(batches: Iterator[pa.RecordBatch], settings: Settings) -> Iterator[pa.RecordBatch]:
    """Counts of the sampled rows, and the distinct terms of each."""
    for batch in (part for whole in batches for part in scan.slices(whole, "text")):
        data, offsets = scan.texts(batch.column("text"))
        counts = text_counts(data, offsets, np.empty(0, np.uint64), settings)
        spans, found = _terms(scan.LOWER[data], offsets, settings.beginnings)
        whole_text = scan.range_hashes(scan.prefix_sums(data), offsets[:-1], offsets[1:]).view(np.int64)
        lists, bounds = [], [0]
        for i in range(batch.num_rows):
            part = np.unique(np.concatenate([x[spans.first[i] : spans.first[i + 1]] for x in found]))
            lists.append(part)
            bounds.append(bounds[-1] + len(part))
        terms = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate(lists).view(np.int64)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), pa.array(whole_text), batch.column("quality").cast(pa.int64()),
             batch.column("toxic").cast(pa.int64()), terms, *(pa.array(counts[c].astype(np.int64)) for c in COUNTS)],
            ["doc_id", "text_hash", "quality", "toxic", "terms", *COUNTS],
        )


def _mark(sample: DataFrame, ids: np.ndarray, toxic: np.ndarray, settings: Settings) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Terms that mark toxic rows, picked by the rows that no earlier one covers."""
    rows, rate = len(ids), toxic.mean() if len(ids) else 0.0
    if not 0 < rate < 1:
        return np.empty(0, np.uint64), {}
    each = sample.select("doc_id", "toxic", F.explode("terms").alias("term")).where("term <> 0")
    counted = each.groupBy("term").agg(F.count("*").alias("n"), F.sum("toxic").alias("k"))
    all_terms = counted.count()
    least = int(np.ceil(np.log(settings.term_error / max(all_terms, 1)) / np.log(rate)))
    good = counted.where((F.col("k") >= least) & (F.col("k") >= F.col("n") * settings.term_precision)).select("term")
    where = {int(doc): i for i, doc in enumerate(ids)}
    holders: dict[int, list[int]] = {}
    for doc, term in each.join(good, "term").select("doc_id", "term").toPandas().itertuples(index=False):
        holders.setdefault(int(term), []).append(where[int(doc)])
    found = {term: np.array(rows) for term, rows in holders.items()}
    open_rows, chosen = toxic.astype(bool).copy(), []
    while found:
        # Ties go to the term with the fewest other rows, then to the smaller hash.
        term = max(found, key=lambda t: (open_rows[found[t]].sum(), -len(found[t]), -t))
        if not open_rows[found[term]].any():
            break
        chosen.append(term)
        open_rows[found[term]] = False
    marks = {term: found[term] for term in chosen}
    return np.sort(np.array(chosen, np.int64).view(np.uint64)), marks


def learn(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DecisionList:
    """Rules that reject what ``labels(doc_id, quality, toxic)`` calls quality 0 or toxic 1."""
    schema = "doc_id long, text_hash long, quality long, toxic long, terms array<long>, " + ", ".join(f"{c} long" for c in COUNTS)
    labelled = scan.mapped(_labelled(docs, labels, settings), lambda it: _sampled(it, settings), schema)
    # Equal texts are one row with their worst label and least id; of the texts of one id the one of the least hash counts.
    # So the rows that teach do not depend on the order in which they come.
    alike = [F.min(c).alias(c) for c in ("doc_id", "quality", "terms", *COUNTS)]
    distinct = labelled.groupBy("text_hash").agg(*alike, F.max("toxic").alias("toxic"))
    named = F.struct("text_hash", "quality", "toxic", "terms", *COUNTS)
    sample = distinct.groupBy("doc_id").agg(F.min(named).alias("row")).select("doc_id", "row.*").persist()
    try:
        rows = sample.drop("terms").orderBy("doc_id").toPandas()
        toxic = rows["toxic"].to_numpy() == 1
        marked, holders = _mark(sample, rows["doc_id"].to_numpy(), toxic, settings)
    finally:
        sample.unpersist()
    counts = {c: rows[c].to_numpy().astype(np.float64) for c in COUNTS}
    for held in holders.values():
        np.add.at(counts["n_marked"], held, 1)
    bad = toxic | (rows["quality"].to_numpy() == 0)
    failed = (counts["n_words"] < settings.min_words) | (
        counts["n_repeat_words"] * 100 > counts["n_words"] * settings.max_repeat_percent
    )
    keys = scan.mix(rows["doc_id"].to_numpy().astype(np.int64).view(np.uint64))
    pick = ~failed
    counts = {c: v[pick] for c, v in counts.items()}
    return DecisionList(cover(counts, bad[pick], (keys % np.uint64(3) == 0)[pick], settings), marked)


def judged(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``row``, the columns of COUNTS, ``base_failed`` and ``kept`` for each row of ``docs``."""
    rules = learn(docs, labels, settings)
    found = measure(docs, rules.marked, settings).withColumn("base_failed", base_failed(settings))
    return found.withColumn("kept", ~F.col("base_failed") & rules.verdict())
