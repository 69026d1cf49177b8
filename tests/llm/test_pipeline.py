"""The stages one after another, and the registered queries, on small tables."""

import os
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
import corpus_pipeline
from typeaudit.llm import packing, quality_rules, queries

from test_decontaminate import brute as windows_in
from test_near_dedup import brute as components_of
from test_quality_rules import brute as counts_of
from test_repeats import brute as repeats_in

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def tables(spark, folder, docs, labels, benchmark):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def staged(spark, folder):
    docs, found = spark.read.parquet(f"{folder}/documents.parquet"), []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{folder}/stage-{number}"
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        found.append(docs)
    return found


def test_each_stage_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels, benchmark = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("labels", "benchmark"))
    rows = {r.doc_id: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)

    rules = quality_rules.learn(docs, labels)
    verdict = {r.row.doc_id: r.ok for r in quality_rules.measure(docs, rules.marked).withColumn("ok", rules.verdict()).collect()}
    failed = {i for i, r in rows.items() for n in [counts_of(r.text)] if n[0] < 10 or n[4] * 100 > n[0] * 20}
    good = stages["quality rules"](spark, docs, sf_dir)
    assert {r.doc_id for r in good.collect()} == {i for i in rows if verdict[i] and i not in failed}

    left = stages["MinHash near-dedup"](spark, docs, sf_dir)
    assert left.columns == COLUMNS
    assert {r.doc_id for r in left.collect()} == {i for i, (_, _, kept) in components_of([(i, r.text) for i, r in rows.items()], 5).items() if kept}

    cut = {r.doc_id: r for r in stages["suffix-array dedup"](spark, docs, sf_dir).collect()}
    for i, n_bytes, n_removed, _, _ in repeats_in([(i, r.text) for i, r in rows.items()], 200):
        if not n_removed:
            assert cut[i] == rows[i]
        elif i in cut:
            assert len(cut[i].text.encode()) <= n_bytes - n_removed and cut[i].n_chars == len(cut[i].text)

    clean = stages["benchmark decontamination"](spark, docs, sf_dir)
    hits = windows_in([(i, r.text) for i, r in rows.items()], [tuple(r) for r in benchmark.select("item_id", "text").collect()])
    assert {r.doc_id for r in clean.collect()} == {i for i, _, n_hit, _ in hits if not n_hit}

    packed = stages["best-fit packing"](spark, docs, sf_dir)
    assert {r.doc_id for r in packed.collect()} == set(rows)


def test_odd_rows_through_all_stages(spark, tmp_path, odd_docs, odd_rows):
    labels = [(i, i % 3, 0) for i in range(30)] + [(None, None, 1)]
    folder = tables(spark, tmp_path, odd_docs, labels, [(1, "w001 w002 w003"), (None, None)])
    stages = staged(spark, folder)
    for docs in stages[:-1]:
        assert docs.columns == odd_docs.columns
    ids = [r.doc_id for r in stages[1].where("doc_id is not null").collect()]
    assert len(ids) == len(set(ids))
    assert stages[-1].count() > 0


def test_near_dedup_judges_rows_by_id_and_text(spark, tmp_path):
    words = [f"w{i:03d}" for i in range(120)]
    near = " ".join([*words[:-1], "edit"])
    rows = [
        # Two texts under one id: a near copy of document 1, and one of its own that must stay.
        (1, " ".join(words)), (2, near), (2, "a text of its own"), (2, "a text of its own"), (3, "and another one"),
        # Copies without id, of document 1 and of each other.
        (None, near), (None, "copy without id"), (None, "Copy without id"), (None, "copy without id"),
        # Near copies under repeated ids: the smaller id stays.
        (9, "first of nine"), (9, "shared words"), (5, "Shared words"), (5, "second of five"),
    ]
    full = [(i, t, "en", "s", len(t)) for i, t in rows]
    docs = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.distinct(spark, docs, str(tmp_path))
    assert left.columns == COLUMNS
    found = sorted((r.doc_id or 0, r.text.lower()) for r in left.collect())
    assert found == [
        (0, "copy without id"), (1, " ".join(words)), (2, "a text of its own"), (3, "and another one"),
        (5, "second of five"), (5, "shared words"), (9, "first of nine"),
    ]


def test_near_dedup_and_packing_leave_columns_alone(spark, tmp_path):
    """Columns may have the names the steps use themselves; ids with several texts take the longer way."""
    rows = [(1, "a b c d e f", "s", "mine", 3), (1, "another text here", "s", "mine", 4), (2, "A b c d e f", "t", None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, near_key string, Several int")
    left = corpus_pipeline.distinct(spark, docs, str(tmp_path))
    assert left.columns == docs.columns and {tuple(r) for r in left.collect()} == set(rows[:2])
    placed = packing.pack_apart(docs)
    assert placed.select("row.*").columns == [c for c in docs.columns if c != "text"]
    found = {tuple(r.row): r.bin for r in placed.collect()}
    assert set(found) == {(r[0], *r[2:]) for r in rows}
    # The copies are a cluster, so they are not in one sequence.
    assert found[(1, "s", "mine", 3)] != found[(2, "t", None, 5)]


def test_empty_tables(spark, tmp_path, no_docs):
    folder = tables(spark, tmp_path, no_docs, [], [])
    assert [docs.count() for docs in staged(spark, folder)] == [0] * 5


def test_names_and_registration():
    assert [n for n in queries.REGISTRY if re.match(r"op\d+_", n)].__len__() == 13
    assert set(queries.REGISTRY) | {"pipeline"} <= set(entry_point.queries())
    assert set(queries.SQL) <= set(entry_point.oracle_sql()) and "pipeline" not in entry_point.oracle_sql()


def test_nothing_else_imports_the_package():
    root = os.path.dirname(os.path.abspath(entry_point.__file__))
    for folder, _, names in os.walk(os.path.join(root, "typeaudit")):
        if os.path.basename(folder) != "llm":
            for name in names:
                if name.endswith(".py"):
                    with open(os.path.join(folder, name)) as file:
                        assert "typeaudit.llm" not in file.read()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, sf_dir, name):
    duckdb = pytest.importorskip("duckdb")
    database = duckdb.connect()
    for table in ("pages", "documents"):
        database.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    want = database.execute(queries.SQL[name]).df()
    found = queries.REGISTRY[name](spark, sf_dir).toPandas()[list(want.columns)]
    as_rows = lambda df: sorted(tuple("-" if v is None or v != v else str(v) for v in r) for r in df.itertuples(index=False))
    assert as_rows(found) == as_rows(want)


@pytest.mark.parametrize("name", [n for n in queries.REGISTRY if n not in ("op4_token_output", "op13_collocations")])
def test_queries_cover_their_tables(spark, sf_dir, name):
    """A row for each document or page, but for the histogram and the pieces of packing."""
    found = queries.REGISTRY[name](spark, sf_dir)
    if name == "op8_token_counts":
        count = found.agg(F.sum("n_docs")).first()[0]
    elif name == "op5_best_fit_packing":
        count = found.where("piece = 0").count()
    else:
        count = found.count()
    table = "pages" if name in ("op7_url_filter", "op12_warc") else "documents"
    assert count == spark.read.parquet(f"{sf_dir}/{table}.parquet").count()
