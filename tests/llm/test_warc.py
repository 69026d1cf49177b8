"""WARC archives: read back, rolled, equal from run to run, and broken ones."""

import base64
import gzip
import hashlib
import os

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from typeaudit.llm import queries, warc

PAGES = "page_id long, url string, html string"
SMALL = warc.Settings(shard_bytes=3000, file_bytes=900)


def brute(rows, least=0):
    groups = {}
    for page_id, _, html in rows:
        groups.setdefault((html or "").encode(), []).append(page_id)
    found = []
    for payload, ids in groups.items():
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        ids = sorted(ids, key=lambda i: (i is not None, i or 0))
        for at, page_id in enumerate(ids):
            first = at == len(ids) - 1 or len(payload) < least
            found.append((page_id, len(payload), digest, "response" if first else "revisit", None if first else ids[-1]))
    return sorted(found, key=str)


@pytest.fixture(scope="module")
def rows():
    found = [(i, f"http://h{i % 5}.example.com/p/{i}", f"<p>Ünï {i % 23}</p>" * (i % 11 + 1)) for i in range(150)]
    # Copies of one page, repeated rows, nulls, empty and long pages, urls with blanks and line ends.
    found += [(500 + i, f"http://copy.example.com/{i}", "<html>copy</html>") for i in range(120)]
    found += [found[3]] * 4 + [(None, "http://x.example.com/", "no id"), (None, None, None), (None, None, None)]
    found += [(901, None, ""), (902, "http://a.example.com/x y\r\nWARC-Type: metadata", None), (903, "u", "\r\n\r\nWARC/1.1\r\n" * 3)]
    found += [(904, "v", "x" * 300_000), (-5, "w", "negative")]
    return found


def read(spark, folder):
    found = warc.read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return sorted((tuple(r) for r in found.collect()), key=str)


def files(folder):
    return {name: hashlib.sha256(open(f"{folder}/{name}", "rb").read()).hexdigest() for name in os.listdir(folder) if name.endswith(".gz")}


@pytest.fixture(scope="module")
def archives(spark, rows, tmp_path_factory):
    """The same rows written twice, from other partitions."""
    found = []
    for parts in (1, 5):
        folder = str(tmp_path_factory.mktemp("warc") / "out")
        pages = spark.createDataFrame([(*r, 1) for r in rows], PAGES + ", shard int").repartition(parts)
        assert warc.write(pages, folder, SMALL) == folder
        found.append(folder)
    return found


def test_read_back(spark, rows, archives):
    assert read(spark, archives[0]) == brute(rows)
    urls = {r.url for r in warc.read(spark, archives[0]).where("page_id = 902").collect()}
    assert urls == {"http://a.example.com/x%20y%0D%0AWARC-Type:%20metadata"}


def test_equal_files_from_other_partitions(archives):
    first, second = map(files, archives)
    assert first == second and len(first) > 10


def test_manifest_is_what_lies_there(spark, archives):
    listed = warc.read_manifest(spark, archives[0]).collect()
    assert {r.name: r.sha256 for r in listed} == files(archives[0])
    assert {name for name in os.listdir(archives[0]) if not name.endswith((".gz", ".crc"))} == {"manifest"}
    by_shard = {}
    for r in listed:
        by_shard.setdefault(r.shard, []).append(r.file)
    assert len(by_shard) > 5 and max(map(len, by_shard.values())) > 1
    assert all(sorted(numbers) == list(range(len(numbers))) for numbers in by_shard.values())


def test_files_are_gzip_of_records(archives):
    name = sorted(files(archives[0]))[0]
    data = gzip.open(f"{archives[0]}/{name}").read()
    assert data.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
    ids = [line for line in data.split(b"\r\n") if line.startswith(b"WARC-Record-ID: ")]
    assert len(ids) == len(set(ids)) > 1


def test_revisits_name_a_record_that_is_there(archives):
    ids, referred = set(), set()
    for name in files(archives[0]):
        with open(f"{archives[0]}/{name}", "rb") as stream:
            for data in warc.members(stream, name):
                headers, _ = warc.parse(data, name)
                ids.add(headers[b"warc-record-id"])
                if b"warc-refers-to" in headers:
                    referred.add(headers[b"warc-refers-to"])
    assert referred and referred <= ids


def test_small_payloads_are_responses(spark, rows, tmp_path):
    pages = spark.createDataFrame(rows, PAGES)
    folder = warc.write(pages, str(tmp_path / "out"), warc.Settings(min_bytes=18))
    assert read(spark, folder) == brute(rows, 18)


@pytest.mark.parametrize("damage", ["flip", "cut", "lose"])
def test_damage_is_found(spark, tmp_path, damage):
    pages = spark.createDataFrame([(i, "u", f"page {i}") for i in range(20)], PAGES)
    folder = warc.write(pages, str(tmp_path / "out"))
    [name] = files(folder)
    raw = open(f"{folder}/{name}", "rb").read()
    if damage == "flip":
        raw = b"".join(gzip.compress(m.replace(b"page 7", b"page 8")) for m in warc.members(open(f"{folder}/{name}", "rb"), name))
    elif damage == "cut":
        raw = raw[:-9]
    else:
        raw = b"".join(gzip.compress(m) for m in list(warc.members(open(f"{folder}/{name}", "rb"), name))[:-1])
    open(f"{folder}/{name}", "wb").write(raw)
    with pytest.raises(PythonException, match="Broken"):
        warc.read(spark, folder).collect()


def test_no_pages(spark, tmp_path):
    folder = warc.write(spark.createDataFrame([], PAGES), str(tmp_path / "out"))
    assert warc.read(spark, folder).count() == 0 and not files(folder)


def test_query(spark, rows, tmp_path):
    spark.createDataFrame(rows, PAGES).write.parquet(f"{tmp_path}/pages.parquet")
    found = queries.REGISTRY["op12_warc"](spark, str(tmp_path))
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(rows)
    assert found.where(F.col("record_type") == "revisit").count() > 100
