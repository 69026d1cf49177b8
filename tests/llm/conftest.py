"""Small tables that hold the odd cases every operator must define."""

import os
import random

import pytest

LONG = 30_000


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text, lang, source, n_chars): nulls, blanks, copies, near copies, ties, one very long text."""
    pick = random.Random(7)
    vocabulary = ["w%03d" % i for i in range(400)] + ["Ärger", "naïve", "état", "人名", "X"]
    prose = lambda n: " ".join(pick.choice(vocabulary) for _ in range(n))
    base = prose(120)
    words = base.split()
    texts = [None, "", " \t\n ", "one", "One", "one two three", base, base, base.upper(), f"  {base}\n"]
    for k in (1, 3, 6, 12, 30):
        near = list(words)
        for at in pick.sample(range(len(near)), k):
            near[at] = "edit"
        texts.append(" ".join(near))
    passage = prose(60)
    texts += [f"{prose(40)} {passage} {prose(30)}" for _ in range(6)]
    texts += ["aaaa" * 100, "aaaa" * 100 + "b", "é" * 300, "line one\nline one\nline two\n\nline one"]
    texts += [prose(pick.randrange(1, 300)) for _ in range(30)]
    texts.append(prose(LONG))
    rows = [(i, t, "en", f"s{i % 4}" if i % 5 else "hot", len(t or "")) for i, t in enumerate(texts)]
    # A row without id, a repeated row, and a row without source.
    return rows + [(None, base, "en", "hot", len(base)), rows[12], (900, prose(50), None, None, None), (None, None, None, None, None)]


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """The odd rows, with columns whose names the operators use themselves."""
    rows = [(*row, "r", 1, [1], True) for row in odd_rows]
    return spark.createDataFrame(rows, COLUMNS + ", row string, n_words int, spans array<int>, kept boolean").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)


SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(SF_DIR):
        pytest.skip("driver tables are not here")
    return SF_DIR


@pytest.fixture(scope="session")
def sf_docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
