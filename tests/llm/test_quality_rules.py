import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from typeaudit import session
from typeaudit.llm import quality_rules as rules
from typeaudit.llm import scan

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(text):
    raw = (text or "").encode()
    words = WORD.findall(raw)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = [False] * len(words)
    for i in range(len(words) - 4):
        if windows[tuple(words[i : i + 5])] > 1:
            hit[i : i + 5] = [True] * 5
    lines = Counter(line for line in raw.split(b"\n") if WORD.search(line))
    return (
        len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""),
        sum(n - 1 for n in lines.values()), sum(hit), len(set(words)), sum(lines.values()),
    )


def counts(docs):
    found = rules.measure(docs, np.empty(0, np.uint64)).collect()
    got = [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_distinct_words, r.n_lines) for r in found]
    return [(r.row.text, g) for r, g in zip(found, got, strict=True)]


def test_counts_equal_brute_force(sf_docs, odd_docs):
    for docs in (sf_docs.select("doc_id", "text"), odd_docs):
        for text, got in counts(docs):
            assert got == brute(text)


def prose(pick, n=60):
    return " ".join("".join(pick.choice("abcdefghij") for _ in range(pick.randrange(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def labelled(spark):
    """Clean prose, prose full of symbols, and prose with words that begin with one of two insults."""
    pick, docs, labels = random.Random(5), [], []
    for i in range(900):
        text, quality, toxic = prose(pick), 1, 0
        if i % 6 == 1:
            text, quality = " ".join(w + "###" for w in text.split()), 0
        elif i % 6 == 2:
            words = text.split()
            words[pick.randrange(60)] = pick.choice(["zonko" + prose(pick, 1), "quxxit"])
            text, toxic = " ".join(words), 1
        docs.append((i, text))
        if i % 3 or i % 2 == 0:
            labels.append((i, quality, toxic))
    labels += [(None, 0, 1), (5000, 0, 1), (3, None, 1), (6, 1, None), labels[0]]
    return (
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def test_learned_list_separates(labelled):
    docs, labels = labelled
    found = {r.row.doc_id: r for r in rules.judged(docs, labels).collect()}
    assert len(found) == 900 and not any(r.base_failed for r in found.values())
    assert [i for i, r in found.items() if r.kept != (i % 6 not in (1, 2))] == []


def test_the_rows_that_teach_do_not_depend_on_order(spark, labelled):
    """Every text stands under three ids with labels of their own, and one id has two texts."""
    docs, labels = labelled
    texts = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").limit(240).collect()]
    rows = [(i + k, text) for i, text in texts for k in (0, 1000, 2000)] + [(3, texts[8][1]), (1003, texts[9][1])]
    marks = [tuple(r) for r in labels.collect()] + [(i + 1000, 1, 0) for i in range(240)] + [(i + 2000, i % 5 and 1, i % 7 == 0 and 1 or 0) for i in range(240)]
    learned = []
    for order in (rows, rows[::-1], rows[300:] + rows[:300]):
        table = spark.createDataFrame(order, "doc_id long, text string").repartition(5)
        given = spark.createDataFrame(marks if order is rows else marks[::-1], "doc_id long, quality int, toxic int")
        found = rules.learn(table, given)
        learned.append((found.rules, found.marked.tolist()))
    assert learned[0] == learned[1] == learned[2] and learned[0][0]


def test_list_is_ordered_and_interpretable(labelled):
    learned = rules.learn(*labelled)
    assert {c.feature for rule in learned.rules for c in rule} <= set(rules.RATIOS)
    assert len(learned.rules) >= 2 and 2 <= len(learned.marked) <= 6


def test_base_rule(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i"), (2, "a b c d e f g h i j"), (3, "a b c d e " * 4), (4, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = {r.row.doc_id: (r.base_failed, r.kept) for r in rules.judged(docs, labels).collect()}
    assert found == {1: (True, False), 2: (False, True), 3: (True, False), 4: (True, False)}


def test_odd_rows_and_empty_tables(spark, odd_docs, odd_rows, no_docs):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    assert rules.judged(odd_docs, labels).count() == len(odd_rows)
    assert rules.judged(no_docs, labels).count() == 0


def test_sample_is_bounded(labelled):
    docs, labels = labelled
    sample = rules._labelled(docs, labels, rules.Settings(sample_rows=50))
    assert sample.count() <= 50


def test_batches_of_long_texts_are_bounded_unless_the_session_says_otherwise(spark):
    own = spark.conf.get(session.BATCH_BYTES)
    texts = spark.range(0, 64, 1, 1).select(F.col("id").alias("doc_id"), F.expr("repeat('word ', 50000)").alias("text"))

    def size(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["size"])

    try:
        spark.conf.unset(session.BATCH_BYTES)
        assert rules.measure(texts, np.empty(0, np.uint64)).where("n_words = 50000").count() == 64
        found = [r.size for r in scan.mapped(texts, size, "size long").collect()]
        assert sum(found) > 15_000_000 and max(found) < 5_000_000
        spark.conf.set(session.BATCH_BYTES, "1000000")
        scan.mapped(texts, size, "size long")
        assert spark.conf.get(session.BATCH_BYTES) == "1000000"
    finally:
        spark.conf.set(session.BATCH_BYTES, own)
