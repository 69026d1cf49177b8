"""Collocations against counts of all phrases."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from typeaudit.llm import collocations, queries


def brute(rows, words=4, least=30, top=2000):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            found = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(found)
            for m in range(1, words + 1):
                counts[lang].update(" ".join(found[i : i + m]) for i in range(len(found) - m + 1))
    out = []
    for lang, f in counts.items():
        chosen = {p: n for p, n in f.items() if " " in p and n >= least}
        longer = Counter()
        for p, n in chosen.items():
            w = p.split(" ")
            for size in range(2, len(w)):
                for at in range(len(w) - size + 1):
                    inner = " ".join(w[at : at + size])
                    longer[inner] = max(longer[inner], n)
        rated = []
        for p, a in chosen.items():
            w = p.split(" ")
            cuts = [(2000000 * a // (f[" ".join(w[:k])] + f[" ".join(w[k:])]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            if 100 * longer[p] < 80 * a or p not in longer:
                rated.append((-score, -a, p.encode(), f[" ".join(w[:k])], f[" ".join(w[k:])]))
        for rank, (score, a, p, left, right) in enumerate(sorted(rated)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def result(found):
    return sorted(tuple(r) for r in found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.fixture(scope="module")
def rows(odd_rows):
    pick = random.Random(5)
    vocabulary = ["a", "B", "the", "é", "人", "x-y", "of", "\x00z", "q r"]
    ends = [" ", " ", " ", "  ", "\t", ", ", ". ", "\n", "!", "\r\n", "\x0b"]
    prose = lambda n: "".join(pick.choice(vocabulary) + pick.choice(ends) for _ in range(n))
    found = [(r[1], r[2]) for r in odd_rows]
    found += [(prose(pick.randrange(1, 200)), pick.choice(["en", None, "und", "e n\n+x", "", "fr"])) for _ in range(60)]
    found += [("new york city hall", "en")] * 40 + [("of " * 3000, "fr"), ("a b " * 20, "en")]
    return found


SETTINGS = [
    {"least": 3}, {"least": 3, "modulus": 2}, {"least": 5, "longest": 7, "modulus": 1 << 30}, {"words": 2, "least": 2},
    {"words": 6, "least": 4, "block_bytes": 500, "bucket_pairs": 40}, {"least": 2, "top": 5}, {},
]


@pytest.mark.parametrize("settings", SETTINGS, ids=str)
def test_against_all_phrases(spark, rows, settings):
    docs = spark.createDataFrame([(*r, "x") for r in rows], "text string, lang string, phrase string").repartition(3)
    found = result(collocations.collocations(docs, collocations.Settings(**settings)))
    shown = {k: v for k, v in settings.items() if k in ("words", "least", "top")}
    assert found and found == brute(rows, **shown)


def test_every_place_is_owned_once():
    pick = np.random.default_rng(2)
    for _ in range(200):
        count = int(pick.integers(1, 60))
        hashes = pick.integers(0, 4, count).astype(np.uint64)
        piece = np.unique(np.concatenate(([0], pick.integers(0, count, 4))))
        settings = collocations.Settings(modulus=int(pick.integers(1, 4)), longest=int(pick.integers(1, 9)))
        found = collocations.parse(hashes, piece, settings)
        ends = np.concatenate((piece[1:], [count]))
        assert np.array_equal(np.concatenate([np.arange(b, b + n) for b, n in zip(found.begin, found.own)]), np.arange(count))
        for begin, end, own in zip(*found, strict=True):
            stop = ends[np.searchsorted(piece, begin, side="right") - 1]
            assert end == min(begin + own + settings.words - 1, stop) and own <= settings.longest


def test_equal_passages_give_equal_chunks(spark):
    passage = " ".join(f"w{i % 61}" for i in range(400))
    docs = spark.createDataFrame([(f"one two {i} {passage} tail {i}", "en") for i in range(50)], "text string, lang string")
    found = collocations.dictionary(docs, collocations.Settings(modulus=8))
    total, distinct = found.groupBy().sum("freq").first()[0], found.count()
    assert distinct < total / 5


def test_sums_beyond_64_bits(spark):
    big = 1 << 62
    rows = [("en", "a b", 2, big), ("en", "a", 1, big), ("en", "b", 1, big + big // 2)]
    counts = spark.createDataFrame(rows, "lang string, phrase string, size int, f long")
    [found] = collocations.scored(counts).collect()
    assert found.score == 2_000_000 * big // (2 * big + big // 2)


def test_no_rows(spark, no_docs):
    assert collocations.collocations(no_docs).count() == 0


def test_query(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang")
    found = result(queries.REGISTRY["op13_collocations"](spark, sf_dir))
    assert found == brute([tuple(r) for r in docs.collect()])
