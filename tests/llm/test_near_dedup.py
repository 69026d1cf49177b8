import re
from collections import Counter, defaultdict

import pytest

from typeaudit.llm import near_dedup
from typeaudit.llm.components import smallest_reachable

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(rows, width, percent=80):
    """Every pair by an inverted index of shingles, then union and find."""
    sets = {}
    for key, text in rows:
        words = WORD.findall((text or "").encode().lower())
        sets[key] = {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()
    parent = {key: key for key in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for key in sorted(sets):
        shared = Counter(other for s in sets[key] for other in holders[s])
        for s in sets[key]:
            holders[s].append(key)
        for other, n in shared.items():
            if 100 * n >= percent * (len(sets[key]) + len(sets[other]) - n):
                a, b = root(key), root(other)
                parent[max(a, b)] = min(a, b)
    return {key: (len(sets[key]), root(key), root(key) == key) for key in sets}


@pytest.mark.parametrize("width", [4, 5])
def test_equals_brute_force(sf_docs, width):
    rows = sf_docs.select("doc_id", "text").collect()
    found = near_dedup.near_duplicates(sf_docs, near_dedup.Settings(shingle=width)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found} == brute([tuple(r) for r in rows], width)


def test_odd_rows(odd_docs, odd_rows):
    found = near_dedup.near_duplicates(odd_docs, near_dedup.Settings(shingle=4)).collect()
    assert len(found) == len(odd_rows)
    want = brute([(r[0], r[1]) for r in odd_rows if r[0] is not None], 4)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found if r.doc_id is not None} == want
    # The row without id has the text of row 6 and its component; the empty one has none.
    assert sorted((r.n_shingles, r.component_id, r.kept) for r in found if r.doc_id is None) == [(0, None, False), (117, 6, False)]


def test_large_group_of_near_copies(spark):
    """A hub that links to all, whose spokes hardly link to one another, and copies of each."""
    base = [f"b{i}" for i in range(400)]
    texts = [" ".join(base)]
    for k in range(60):
        spoke = list(base)
        for j in range(9):
            spoke[(k * 6 + j * 44) % 400] = f"x{k}-{j}"
        texts += [" ".join(spoke)] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = near_dedup.near_duplicates(docs, near_dedup.Settings(shingle=4)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found} == brute(list(enumerate(texts)), 4)


def test_an_id_with_several_texts_in_any_order(spark):
    """Rows 2 and 4 are copies of the two texts of id 7; each row of 7 is judged by its own text."""
    one, two = (" ".join(f"{mark}{i}" for i in range(60)) for mark in "ab")
    rows = [(7, one), (7, two), (2, one + " more"), (4, two + " more"), (9, None), (7, ""), (None, two)]
    want = sorted([(7, 2, False), (7, 4, False), (2, 2, True), (4, 4, True), (9, 9, True), (7, 7, True), (-1, 4, False)])
    for order in (rows, rows[::-1], rows[3:] + rows[:3]):
        docs = spark.createDataFrame(order, "doc_id long, text string").repartition(3)
        found = near_dedup.near_duplicates(docs, near_dedup.Settings(shingle=4)).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.component_id, r.kept) for r in found) == want


def test_row_keys_leave_columns_alone(spark):
    rows = [(1, "a b", "mine", 5), (1, "a c", "mine", 6), (None, "a b", "mine", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Near_key string, several int")
    key = near_dedup.free_name(docs, "near_key")
    keyed = near_dedup.with_row_key(docs, key)
    assert keyed.columns == [*docs.columns, key] and key not in docs.columns
    assert {tuple(r)[:4] for r in keyed.collect()} == set(rows) and keyed.select(key).distinct().count() == 3


def test_empty(no_docs):
    assert near_dedup.near_duplicates(no_docs).count() == 0


def test_components_of_a_chain_and_a_loop(spark):
    links = [(i, i + 1) for i in range(2, 60)] + [(100, 100), (71, 70), (70, 71)]
    found = smallest_reachable(spark.createDataFrame(links, "a long, b long"))
    assert {r.node: r.component for r in found.collect()} == {i: 2 for i in range(2, 61)} | {70: 70, 71: 70}


def test_steps_leave_no_folders(spark, sf_docs):
    """Buckets, pairs, open rows and all but the last links are deleted after their last reader."""
    from pathlib import Path

    from typeaudit import session

    folder = Path(session.shared_dir(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    near_dedup.near_duplicates(sf_docs).count()
    left = [path.name.split("-")[0] for path in set(folder.iterdir()) - before]
    assert not {"buckets", "pairs", "open"} & set(left)
    assert left.count("stars") == near_dedup.Settings().star_rounds + 1
