import math
import re
import zlib
from collections import Counter

import pytest

from typeaudit.llm import lm_score

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(rows, order, strength):
    texts = [(i, WORD.findall((t or "").encode().lower()) + [None]) for i, t in rows]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    count = Counter()
    for i, words in texts:
        if not held(i):
            line = [None, *words]
            for at in range(1, len(line)):
                for n in range(1, order + 1):
                    if at - n + 1 >= 0:
                        count[tuple(line[at - n + 1 : at + 1])] += 1
    tokens = sum(v for g, v in count.items() if len(g) == 1)
    types = sum(len(g) == 1 for g in count)

    def p(word, context):
        if not context:
            return (count[(word,)] + 1) / (tokens + types + 1)
        shorter, total = p(word, context[1:]), count[context]
        return (count[(*context, word)] + strength * shorter) / (total + strength) if total else shorter

    found = []
    for i, words in texts:
        line = [None, *words]
        base = sum(math.log10(p(w, ())) for w in words)
        score = sum(math.log10(p(line[at], tuple(line[max(0, at - order + 1) : at]))) for at in range(1, len(line)))
        found.append((i, held(i), len(words), sum(count[(w,)] > 0 for w in words), tokens, base, score))
    return found


def same(found, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[6])
    found, want = sorted(map(tuple, found), key=key), sorted(want, key=key)
    assert [r[:5] for r in found] == [r[:5] for r in want]
    for a, b in zip(found, want, strict=True):
        assert a[5:] == pytest.approx(b[5:], rel=1e-9)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_equals_brute_force(sf_docs, order):
    settings = lm_score.Settings(order=order, strength=5.0, block_bytes=60_000, range_keys=9_000)
    rows = [tuple(r) for r in sf_docs.select("doc_id", "text").collect()]
    same(lm_score.scores(sf_docs, settings).collect(), brute(rows, order, 5.0))


def test_odd_rows(odd_docs, odd_rows):
    settings = lm_score.Settings(block_bytes=20_000, range_keys=500)
    same(lm_score.scores(odd_docs, settings).collect(), brute([r[:2] for r in odd_rows], 2, settings.strength))


def test_held_out_texts_are_likelier_than_under_single_words(sf_docs):
    found = [r for r in lm_score.scores(sf_docs).collect() if r.held_out]
    assert sum(r.score for r in found) > sum(r.base_score for r in found)


def test_empty(no_docs):
    assert lm_score.scores(no_docs).count() == 0


def test_sums_beyond_four_bytes():
    import numpy as np

    keys, counts = np.array([4, 9, 12], np.uint64), np.array([3_000_000_000, 1, (1 << 53) - 1])
    runs = [row for number in (0, 1) for row in lm_score._runs(number, keys, counts, 1)]
    found = lm_score._sum_range(lm_score._table(runs, lm_score._RUN_NAMES, lm_score._RUN_KINDS)).to_pylist()
    totals = {r["block"]: r["counts"] for r in found}
    for block in (0, 1):
        assert lm_score._counts_unpacked(totals[block]).tolist() == (2 * counts).tolist()
    assert int.from_bytes(totals[lm_score.TOTALS], "big") == 6_000_000_000 + 2 * ((1 << 53) - 1)


def test_packed_runs_round_trip():
    import numpy as np

    keys = np.array([0, 1, 7, 1 << 40, (1 << 64) - 1], np.uint64)
    assert (lm_score._unpacked(lm_score._packed(keys)) == keys).all()
    counts = np.array([0, 1, 255, 256, 1 << 31])
    assert (lm_score._counts_unpacked(lm_score._counts_packed(counts)) == counts).all()
