"""Archives read back, revisits and the merged index."""

import base64
import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from panel360.llm import warc
from panel360.llm.common import scratch
from panel360.llm.queries import op5_warc_index

SCHEMA = "page_id long, url string, html string"


def test_loser_tree():
    rng = random.Random(1)
    for _ in range(300):
        runs = [sorted((rng.randint(0, 9),) for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(0, 9))]
        got = [(runs[r][i], r, i) for r, i in warc.LoserTree(runs)]
        assert got == sorted((x, r, i) for r, run in enumerate(runs) for i, x in enumerate(run))


def written(spark, pages, per_file=3, **options):
    df = spark.createDataFrame(pages, SCHEMA)
    path = scratch(spark, "test-warc")
    records = warc.records(df, "page_id", "url", "html", F.timestamp_seconds(F.coalesce("page_id", F.lit(0))),
                           **options)
    warc.write_archives(records, path, per_file)
    return path, warc.read_captures(spark, path)


PAGES = [(3, "http://A.example.org/x?q=1#f", "same"), (1, "http://a.example.org/x", "same"),
         (2, "http://b.example.org/\r\nWARC-Type: x", "WARC/1.1\r\n\r\n\r\n"), (4, None, None), (5, "", ""),
         (None, "u", "same"), (6, "http://[bad/", "é😀\x00\r\n\r\n"), (1, "http://a.example.org/x", "same"),
         (7, "x" * 3000, "long " * 50000), (8, "http://c.org", "same")]


def test_round_trip(spark):
    path, captures = written(spark, PAGES)
    rows = captures.collect()
    assert len(rows) == len(PAGES)
    first = {}
    for key, _, html in PAGES:
        if key is not None:
            first[html or ""] = min(key, first.get(html or "", key))
    want = []
    for key, _, html in PAGES:
        data = (html or "").encode()
        again = key is not None and first[html or ""] < key
        want.append((repr(key and str(key)), len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
                     "revisit" if again else "response", repr(str(first[html or ""]) if again else None)))
    assert sorted((repr(r.key), r.payload_bytes, r.payload_digest, r.record_type, repr(r.refers_to))
                  for r in rows) == sorted(want)
    urls = {r.key: r.url for r in rows}
    assert urls["2"] == "http://b.example.org/%0D%0AWARC-Type:%20x" and urls["4"] is urls["5"] is None
    files = {f.path.rpartition("/")[2]: bytes(f.content)
             for f in spark.read.format("binaryFile").load(path).collect()}
    assert len(files) > 1
    for r in rows:  # offsets point at records
        data = gzip.decompress(files[r.file])[r.offset:r.offset + r.length]
        assert data.startswith(b"WARC/1.1\r\n") and data.endswith(b"\r\n\r\n")


def test_small_payloads_are_responses(spark):
    _, captures = written(spark, [(1, "a", "xy"), (2, "b", "xy"), (3, "c", "long"), (4, "d", "long")], min_bytes=3)
    assert sorted((r.key, r.record_type, r.refers_to) for r in captures.collect()) == [
        ("1", "response", None), ("2", "response", None), ("3", "response", None), ("4", "revisit", "3")]


def test_damaged_archive(spark):
    path, _ = written(spark, PAGES[:1])
    content = spark.read.format("binaryFile").load(path).first().content
    broken = gzip.compress(gzip.decompress(content).replace(b"\r\n\r\nsame", b"\r\n\r\nsamE"))
    with pytest.raises(ValueError, match="digest"):
        list(warc.parse_archive("f", broken))


def test_index_is_in_global_order(spark):
    rng = random.Random(2)
    pages = [(i, f"http://{rng.choice('abc')}.example.org/{rng.choice('xy')}" if i % 3 else "http://hot.org/",
              f"p{i % 7}") for i in range(400)]
    _, captures = written(spark, pages, per_file=40)
    rows = warc.merge_runs(captures, 5).orderBy("part", "place").collect()
    keys = [(r.url_key, r.date, r.file, r.offset) for r in rows]
    assert keys == sorted(keys) and len(keys) == 400
    hot = {r.part for r in rows if r.url_key.startswith("org,hot")}
    assert len(hot) > 1  # one URL may fill several partitions


def test_url_key():
    assert warc.url_key("https://User@WWW.Example.org:80/A?b=C#d") == "org:80,example,www)/a?b=c"
    assert warc.url_key(None) == ")/"


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/pages.parquet")
    assert op5_warc_index(spark, str(tmp_path)).collect() == []
