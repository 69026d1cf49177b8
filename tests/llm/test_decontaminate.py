import re

import pytest
from pyspark.sql import functions as F

from typeaudit.llm import decontaminate

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(docs, items, width=10):
    windows = {}
    for i, t in items:
        words = WORD.findall((t or "").encode().lower())
        for at in range(max(len(words) - width, 0) + 1) if words else ():
            windows.setdefault(tuple(words[at : at + width]), set()).add(i)
    found = []
    for i, t in docs:
        words = WORD.findall((t or "").encode().lower())
        hit, held = [0] * len(words), set()
        for size in {len(w) for w in windows}:
            for at in range(len(words) - size + 1):
                if tuple(words[at : at + size]) in windows:
                    held |= windows[tuple(words[at : at + size])]
                    hit[at : at + size] = [1] * size
        found.append((i, len(words), sum(hit), ",".join(sorted(str(x) for x in held - {None}))))
    return found


def digest(docs, benchmark, **options):
    found = decontaminate.passages(docs, benchmark, **options)
    return found.select("row.doc_id", "n_words", decontaminate.n_hit(), F.array_join(F.array_sort("items"), ",")).collect()


def in_order(rows):
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("block", [decontaminate.BLOCK_WINDOWS, 200])
def test_equals_brute_force(spark, sf_docs, sf_dir, block):
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    docs, items = (df.select(df.columns[0], "text").collect() for df in (sf_docs, benchmark))
    found = digest(sf_docs, benchmark, block_windows=block)
    assert in_order(found) == in_order(brute(docs, items))
    assert any(r[2] for r in found)


def test_odd_rows(spark, odd_docs, odd_rows):
    words = odd_rows[6][1].split()
    items = [
        (1, " ".join(words[5:30])), (2, " ".join(words[20:24])), (3, "ONE, two; THREE"), (4, None), (5, ""), (6, "... !"),
        (None, " ".join(words[40:60])), (1, " ".join(words[70:90])), (7, "line one line one line two line one"), (10, "aaaa" * 100),
    ]
    benchmark = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, row string")
    assert in_order(digest(odd_docs, benchmark)) == in_order(brute([r[:2] for r in odd_rows], items))


def test_empty_tables(spark, odd_docs, odd_rows, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    found = decontaminate.passages(odd_docs, none).collect()
    assert len(found) == len(odd_rows) and not any(r.spans or r["items"] for r in found)
    some = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert decontaminate.passages(no_docs, some).count() == 0
