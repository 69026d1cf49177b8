"""Merkle manifest against trees built in Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from typeaudit.llm import merkle, queries


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels_of(leaves, fanout):
    found = [leaves]
    while len(found[-1]) > 1:
        last = found[-1]
        found.append([sha(*last[i : i + fanout]) for i in range(0, len(last), fanout)])
    return found


def path_of(levels, at, fanout):
    found = []
    for level in levels[:-1]:
        begin = at // fanout * fanout
        found.append(("".join(level[begin:at]), "".join(level[at + 1 : begin + fanout])))
        at //= fanout
    return found


def leaf_of(row, text):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], text)])


def brute(rows, fanout=8):
    """The query's rows, as a sorted list."""
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf_of(row, row[1]), row))
    names = sorted(groups, key=lambda lang: (lang is not None, (lang or "").encode()))
    trees = {lang: levels_of([g[2] for g in sorted(groups[lang], key=lambda g: g[:3])], fanout) for lang in names}
    over = levels_of([trees[lang][-1][0] for lang in names], fanout)
    found = []
    for place, lang in enumerate(names):
        for at, (_, _, leaf, row) in enumerate(sorted(groups[lang], key=lambda g: g[:3])):
            path = path_of(trees[lang], at, fanout) + path_of(over, place, fanout)
            node = leaf
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0:
                node = leaf_of(row, row[1] if row[1] is None else row[1].translate(lower))
            for left, right in path:
                node = sha(left, node, right)
            proof = sha(*[left + right for left, right in path])
            found.append((row[0], leaf, trees[lang][-1][0], over[-1][0], proof, node, node == over[-1][0]))
    return sorted(found, key=str)


def result(spark, tmp_path, rows, columns="doc_id long, text string, lang string, source string, n_chars long"):
    spark.createDataFrame(rows, columns).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.REGISTRY["op11_merkle_manifest"](spark, str(tmp_path))
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in found.collect()), key=str)


def test_odd_rows(spark, tmp_path, odd_rows):
    pick = random.Random(3)
    langs = [None, "", "en", "é", "zz", "EN"]
    rows = [(r[0], r[1], pick.choice(langs), *r[3:]) for r in odd_rows]
    # A lone row of a language, a row of nulls, and repeated rows.
    rows += [(7, "Lone", "only", "s", 4), (None, None, None, None, None), *rows[:9], *rows[:2]]
    want = brute(rows)
    assert result(spark, tmp_path, rows) == want
    assert {r[-1] for r in want} == {True, False}


def test_many_rows_and_languages(spark, tmp_path):
    """More rows than a block holds, runs of one, and more languages than a run."""
    rows = [(i * 7919 % 5000, f"Text {i}", "en" if i < 1100 else f"l{i % 70}", "s", i) for i in range(1300)]
    assert result(spark, tmp_path, rows) == brute(rows)


@pytest.mark.parametrize("count", [1, 2, 3, 4, 5, 9, 16, 17, 28])
def test_other_shapes(spark, count):
    """Blocks of four nodes over several rounds."""
    rows = spark.range(count).withColumn("row", F.lit("x"))
    settings = merkle.Settings(fanout=2, levels=2)
    found = merkle.manifest(rows, F.sha2(F.col("id").cast("string"), 256), F.lit("g"), F.col("id"), {"id": F.col("id")}, settings)
    levels = levels_of([sha(str(i)) for i in range(count)], 2)
    for r in found.proofs.collect():
        assert r.leaf == levels[0][r.row.id] and r.root == r.subroot == levels[-1][0]
        assert [tuple(s) for s in r.path] == path_of(levels, r.row.id, 2)
    assert [tuple(r) for r in found.subroots.collect()] == [("g", levels[-1][0], levels[-1][0])]


def test_no_rows(spark, tmp_path):
    assert result(spark, tmp_path, []) == []


def test_fields_are_told_apart(spark):
    found = spark.range(1).select(*[merkle.field(c) for c in (F.lit("-"), F.lit(None), F.lit(""), F.lit("é"), F.lit(12))]).first()
    assert tuple(found) == ("1:-", "-", "0:", "2:é", "2:12")
