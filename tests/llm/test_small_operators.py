"""Packing, sharding, token counts, token output and URL filters."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import tiktoken

from typeaudit.llm import packing, queries, sharding, token_counts, token_output, tokens, url_filter


@pytest.fixture(scope="module")
def encode():
    return tokens.encoder(tokens.VOCABULARY).encode_ordinary


def test_no_bin_holds_a_conflict(odd_docs, odd_rows, encode):
    found = packing.pack(odd_docs, packing.Settings(capacity=512)).collect()
    assert sum(r.piece_tokens for r in found) == sum(len(encode(r[1] or "")) + 1 for r in odd_rows)
    bins = {}
    for r in found:
        bins.setdefault(r.bin, []).append(r)
    for held in bins.values():
        sources = Counter(r.row.source for r in held if r.row.source is not None)
        assert max(sources.values(), default=1) == 1
        spans = sorted((r.bin_offset, r.bin_offset + r.piece_tokens) for r in held)
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and spans[0][0] == 0 and spans[-1][1] <= 512


def test_near_copies_of_different_sources_share_no_bin(spark, tmp_path):
    words = [f"w{i:03d}" for i in range(120)]
    edited = lambda i: " ".join("edit" if at == i else w for at, w in enumerate(words))
    rows = [(i if i % 4 else None, edited(9 * i), f"s{i}") for i in range(12)]
    # One id with two texts, of which one is a near copy, and texts without a word, which are copies of each other.
    rows += [(1, "something else", "t0"), (20, "", "t1"), (21, None, "t2"), (None, " \n", "t3")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    found = packing.pack_apart(docs).collect()
    bin_of = {r.row.source: r.bin for r in found}
    assert len(found) == len(rows)
    assert len({bin_of[f"s{i}"] for i in range(12)}) == 12
    assert len({bin_of[f"t{i}"] for i in range(1, 4)}) == 3
    assert bin_of["t0"] in {bin_of[f"s{i}"] for i in range(12)}
    assert len({r.bin for r in queries.REGISTRY["op5_best_fit_packing"](spark, str(tmp_path)).collect()}) == 12


def brute_best_fit(lengths, sources, clusters, capacity):
    bins, chosen = [], [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fits = [
            (capacity - sum(lengths[j] for j in held), number)
            for number, held in enumerate(bins)
            if sum(lengths[j] for j in held) + lengths[i] <= capacity
            and all(sources[j] != sources[i] and clusters[j] != clusters[i] for j in held)
        ]
        if not fits:
            bins.append([])
            fits = [(0, len(bins) - 1)]
        chosen[i] = min(fits)[1]
        bins[chosen[i]].append(i)
    return chosen


def test_tightest_compatible_bin():
    random = np.random.default_rng(1)
    for _ in range(60):
        n = int(random.integers(1, 60))
        lengths = random.integers(1, 40, n).tolist()
        sources, clusters = random.integers(0, 9, n).tolist(), random.integers(0, 20, n).tolist()
        found, _ = packing.best_fit(lengths, sources, clusters, 40)
        assert found == brute_best_fit(lengths, sources, clusters, 40)


def test_lookup_table_takes_turns_and_moves_little():
    weights = {f"n{i}": 1 + i % 2 for i in range(9)}
    full = sharding.lookup_table(weights, 1009)
    share = Counter(full.tolist())
    assert all(abs(share[i] - 1009 * weights[f"n{i}"] / 13) <= 2 for i in range(9))
    names = sorted(weights)
    left = dict(weights)
    del left["n4"]
    fewer = sharding.lookup_table(left, 1009)
    stay = sum(names[a] == sorted(left)[b] for a, b in zip(full, fewer, strict=True) if names[a] != "n4")
    assert stay > 0.7 * sum(names[a] != "n4" for a in full)
    with pytest.raises(ValueError):
        sharding.lookup_table(weights, 1000)


def test_sharding_of_odd_rows(odd_docs, odd_rows, no_docs):
    weights = {"a": 1, "b": 1}
    found = sharding.place(odd_docs, weights, ["source", "n_chars"], 101).collect()
    owner = sharding.lookup_table(weights, 101)
    assert len(found) == len(odd_rows) and all("ab"[owner[r.slot]] == r.shard for r in found)
    assert sharding.place(no_docs, weights, ["source"], 101).count() == 0


def test_counts_for_every_limit(odd_docs, odd_rows, encode, no_docs):
    size = [len(encode(r[1] or "")) for r in odd_rows]
    limits = token_counts.by_limit(token_counts.histogram(odd_docs))
    found = {r.context_limit: r for r in limits.collect()}
    assert set(found) == set(size)
    for limit, r in found.items():
        assert r.n_docs == size.count(limit) and r.n_tokens == limit * r.n_docs
        assert r.docs_from == sum(s >= limit for s in size) and r.tokens_from == sum(s for s in size if s >= limit)
        assert r.tokens_cut == sum(min(s, limit) for s in size)
        assert r.rank == pytest.approx(sum(s <= limit for s in size) / len(size))
    middle = {r.share: r.length for r in token_counts.quantiles(limits, [0.5, 1.0]).collect()}
    assert middle == {0.5: sorted(size)[-(-len(size) // 2) - 1], 1.0: max(size)}
    assert token_counts.by_limit(token_counts.histogram(no_docs)).count() == 0


@pytest.mark.parametrize("count", [1, 2, 3, 5, 64, 65, 1000])
def test_slots_are_a_permutation(count):
    found = token_output.slots(np.arange(count), count, 99)
    assert sorted(found) == list(range(count))
    if count > 100:
        assert np.corrcoef(found, np.arange(count))[0, 1] < 0.2


def test_shards_read_back(odd_docs, odd_rows, encode, tmp_path, no_docs):
    settings = token_output.Settings(length=64, per_shard=50)
    found = token_output.materialize_order(odd_docs, str(tmp_path / "out"), settings).collect()
    assert sorted(r.slot for r in found) == list(range(len(found)))
    read = token_output.read_slots(str(tmp_path / "out"), 0, len(found) + 9, settings)
    for r in found:
        assert hashlib.sha256(read[r.slot].tobytes()).hexdigest() == r.sha256
        assert (r.shard, r.byte_offset) == (r.slot // 50, r.slot % 50 * 128)
    assert (token_output.read_slots(str(tmp_path / "out"), 47, 10, settings) == read[47:57]).all()
    end = tokens.end_id(tokens.VOCABULARY)
    got = Counter(int(i) for r in found for i in read[r.slot][: r.n_tokens])
    assert got == Counter(i for r in odd_rows for i in [*encode(r[1] or ""), end])
    assert not [f for f in (tmp_path / "out").iterdir() if f.name.startswith(".shard")]
    assert token_output.materialize_order(no_docs, str(tmp_path / "none"), settings).count() == 0


URLS = [
    ("http://Foo.NET/x", "foo.net", "/x", "net/", "block"),
    ("https://a.example.net/en/1?q#f", "a.example.net", "/en/1", "example.net/en/", "allow"),
    ("x://example.com/de/", "example.com", "/de/", "example.com/de/", "block"),
    ("x://notexample.com/de/", "notexample.com", "/de/", None, "allow"),
    ("http://m.listed.com/a.html", "m.listed.com", "/a.html", None, "block"),
    ("http://LISTED.com/a//#top", "listed.com", "/a//", None, "block"),
    ("http://net", "net", "", None, "allow"),
    ("http://É.org/fr/x\ny", "É.org", "/fr/x\ny", "org/fr/", "allow"),
    ("a://b.com?x://c.net/", "b.com", "", None, "allow"),
    ("", "", "", None, "allow"),
    ("nothing", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("://", "", "", None, "allow"),
]


def test_urls(spark):
    rows = [(i, row[0], "h", "r") for i, row in enumerate(URLS)] + [(0, URLS[0][0], "h", "r")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    listed = spark.createDataFrame([("listed.com/a",), ("listed.com/a",), (None,)], "canonical string")
    found = url_filter.judge(pages, listed, queries.RULES).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r.row.url, r.host, r.path, r.rule, r.verdict) == URLS[r.row.page_id]
    none = listed.limit(0)
    assert url_filter.judge(pages, none, queries.RULES).where("rule is null and verdict = 'block'").count() == 0
    assert url_filter.judge(pages.limit(0), listed, queries.RULES).count() == 0


def test_full_filter_stays_exact(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "MAX_WORDS", 1)
    pages = spark.createDataFrame([(i, f"http://h{i}.com/p") for i in range(200)], "page_id long, url string")
    listed = spark.createDataFrame([(f"h{i}.com/p",) for i in range(0, 200, 2)], "canonical string")
    found = url_filter.judge(pages, listed, []).collect()
    assert all((r.verdict == "block") == (r.row.page_id % 2 == 0) for r in found) and len(found) == 200


def test_main_path_is_native(spark, sf_dir):
    plan = queries.REGISTRY["op7_url_filter"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert "ReadSchema: struct<page_id:bigint,url:string>" in plan


def test_the_pattern_cuts_as_the_published_one_and_never_goes_back(encode):
    published = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    coder = tokens.encoder(tokens.VOCABULARY)
    plain = tiktoken.Encoding("published", pat_str=published, mergeable_ranks=coder._mergeable_ranks, special_tokens={})
    pieces = np.array(["'s", "'ll", "'", "'d", " ", "  ", "\n", "\t", " ", "　", "\r\n", "é", "ab", "Z", "7", "½", "٣", "漢", "!", "#$", "́", "😀", "\x00"])
    random = np.random.default_rng(5)
    for size in (0, 1, 2, 3, 5, 8, 40):
        for _ in range(300):
            text = "".join(random.choice(pieces, size))
            assert encode(text) == plain.encode_ordinary(text)
    assert all(f"{run}++" in tokens.PATTERN for run in (r"\p{L}", r"\p{N}", r"[^\s\p{L}\p{N}]"))


def test_lengths_are_those_of_whole_texts(encode, monkeypatch):
    monkeypatch.setattr(tokens, "KNOWN", 16)
    tokens._known.cache_clear()
    pieces = np.array([
        "'s", "'ll", "'", " '", "d", " ", " ", "  ", "\n", "\t", "\r\n", "\x1c", "\x00", "\x85", "\xa0", " ", " ", " ", " ",
        " ", "　", "​", "é", "à", "漢", "一", "ab", "Z", "7", "½", "!", "#$", "́", "😀", " of", " of\x00", " fifteen-bytes.", " sixteen--bytes.", " w" * 9,
    ])
    random = np.random.default_rng(5)
    texts = ["".join(random.choice(pieces, size)) for size in (0, 1, 2, 3, 5, 8, 40) for _ in range(400)]
    texts += [None, "", " ", "\n", "word", " word", "word ", "漢" * 3000, "x" * 3000, " " * 3000]
    random.shuffle(texts)
    wanted = [len(encode(text or "")) for text in texts]
    for kind in (pa.string(), pa.large_string()):
        array = pa.array(texts, kind)
        assert tokens.lengths(array, tokens.VOCABULARY).tolist() == wanted
        assert tokens.lengths(array.slice(7, 900), tokens.VOCABULARY).tolist() == wanted[7:907]
    assert tokens.lengths(pa.array([], pa.string()), tokens.VOCABULARY).tolist() == []
    assert tokens.lengths(pa.array([None, ""], pa.string()), tokens.VOCABULARY).tolist() == [0, 0]
    tokens._known.cache_clear()


def test_repeated_words_are_encoded_once(encode, monkeypatch):
    real, seen = tokens.encoder(tokens.VOCABULARY), []

    class Counting:
        def __getattr__(self, name):
            return getattr(real, name)

        def encode_ordinary(self, text):
            seen.append(len(text))
            return real.encode_ordinary(text)

    monkeypatch.setattr(tokens, "encoder", lambda path: Counting())
    random = np.random.default_rng(6)
    vocabulary = np.array([f"invented{i}" for i in range(500)])
    texts = [" ".join(random.choice(vocabulary, 100)) for _ in range(400)]
    for begin in range(0, 400, 100):
        found = tokens.lengths(pa.array(texts[begin : begin + 100]), tokens.VOCABULARY)
        assert found.tolist() == [len(encode(t)) for t in texts[begin : begin + 100]]
    assert sum(seen) < sum(map(len, texts)) / 10
