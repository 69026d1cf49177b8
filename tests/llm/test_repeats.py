import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from typeaudit.llm import induced, repeats


def brute(rows, window):
    texts = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(b[at : at + window] for _, b in texts for at in range(len(b) - window + 1))
    found = []
    for i, b in texts:
        gone = bytearray(len(b))
        for at in range(len(b) - window + 1):
            if count[b[at : at + window]] > 1:
                gone[at : at + window] = b"\1" * window
        spans = sum(1 for at, g in enumerate(gone) if g and not (at and gone[at - 1]))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        found.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return found


def digest(docs, settings):
    found = repeats.without_repeats(docs, settings)
    return found.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()


def in_order(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, *map(str, r)))


@pytest.mark.parametrize("window, core", [(200, 32), (50, 8)])
def test_equals_brute_force(sf_docs, window, core):
    rows = [tuple(r) for r in sf_docs.select("doc_id", "text").collect()]
    settings = repeats.Settings(window=window, core=core, shard_bytes=1 << 16)
    assert in_order(digest(sf_docs, settings)) == in_order(brute(rows, window))


@pytest.mark.parametrize("most", [1, 3])
def test_crowded_anchors_are_compared_window_by_window(sf_docs, most):
    rows = [tuple(r) for r in sf_docs.select("doc_id", "text").collect()]
    assert in_order(digest(sf_docs, repeats.Settings(core=16, shard_runs=most))) == in_order(brute(rows, 200))


def test_odd_rows(odd_docs, odd_rows):
    assert in_order(digest(odd_docs, repeats.Settings())) == in_order(brute([r[:2] for r in odd_rows], 200))


def test_shards_larger_than_the_bounds_in_memory(sf_docs, monkeypatch):
    """Files for queues and arrays, chunks of a few hundred entries; the same result."""
    monkeypatch.setattr(induced, "QUEUE_ENTRIES", 500)
    monkeypatch.setattr(induced, "ARRAY_BYTES", 1000)
    monkeypatch.setattr(induced, "CHUNK", 300)
    text = np.frombuffer(b"".join(r.text.encode() for r in sf_docs.limit(12).collect())[:12_000], np.uint8)
    order, common = induced.suffix_order(np.append(text.astype(np.int16) + 1, 0).astype(np.int16), 200)
    raw = text.tobytes()
    assert [raw[i : i + 200] for i in order] == sorted(raw[i : i + 200] for i in range(len(raw) + 1))
    for a, b, n in zip(order[:-1], order[1:], common[1:], strict=True):
        x, y = raw[a : a + 200], raw[b : b + 200]
        assert n == next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))


def test_random_small_texts():
    random = np.random.default_rng(3)
    for _ in range(150):
        size, symbols = int(random.integers(1, 80)), int(random.integers(1, 4))
        text = np.append(random.integers(1, symbols + 1, size), 0).astype(np.int16)
        order, _ = induced.suffix_order(text, 500)
        assert list(order) == sorted(range(len(text)), key=lambda i: tuple(text[i:]))


def test_empty(no_docs):
    assert repeats.without_repeats(no_docs).count() == 0
