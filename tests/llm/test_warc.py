"""Archives written and read back through the capture index, against a plain grouping of payloads."""

import base64
import gzip
import hashlib
import random
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from corvane.llm import common, warc

SCHEMA = "page_id long, url string, html string"


def plain(rows, least=0):
    first = {}
    for i, _, t in rows:
        t = t or ""
        first[t] = max(first.get(t, -1), -1 if i is None else i)
    out = []
    for i, _, t in rows:
        raw = (t or "").encode()
        top = first[t or ""] if first[t or ""] >= 0 else None
        response = len(raw) < least or i == top
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if response else "revisit", None if response else top))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


URLS = [None, "", "no scheme", "http://a.example/x?q=1", "http://a.example/x?q=1", "HTTP://A.example:80/É ü", "http://b.a.example/", "http://[bad", "http://a.example:no/", "https://zzz.test/a\r\nInjected: 1", "http://hot.example/same"]


def made_up(seed, n):
    rng = random.Random(seed)
    texts = [None, "", "<p>same</p>", "\r\n\r\nWARC/1.1\r\n", *("é" * rng.randrange(50) + str(rng.random()) for _ in range(n // 3))]
    rows = [(k if k % 11 else None, rng.choice(URLS) if k % 3 else "http://hot.example/same", rng.choice(texts)) for k in range(1, n)]
    return [*rows, *rows[:4], (n, "http://long.example/", "long " * 200_000), (None, None, "alone"), (None, "x", "alone")]


@pytest.mark.parametrize("least", [0, 12])
def test_round_trip(spark, monkeypatch, least):
    monkeypatch.setattr(common, "HOT_SHARE", 8)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 3000)  # so that tasks write several files
    rows = made_up(1, 150)
    pages = spark.createDataFrame([(*r, 1, "k", "f") for r in rows], f"{SCHEMA}, offset int, key string, file string")
    assert got(warc.round_trip(pages, least=least)) == plain(rows, least)


def test_files_are_plain_gzip_members_and_the_index_finds_single_urls(spark):
    rows = [(k, f"http://h{k % 7}.example/{k % 50}", f"page {k % 40}") for k in range(200)]
    archive = warc.write(spark.createDataFrame(rows, SCHEMA))
    folder = urlparse(archive.base).path
    whole = b""
    for name in {r.file for r in archive.captures.select("file").distinct().collect()}:
        whole += gzip.open(f"{folder}/{name}").read()
    assert whole.count(b"WARC/1.1\r\n") == 200 and whole.count(b"WARC-Type: response\r\n") == 40
    index = warc.build_index(archive, block=3)
    assert sum(f[1] for f in index.files) == 200
    for url in ("http://h3.example/3", "http://h6.example/48", "http://none.example/"):
        asked = spark.createDataFrame([(warc.url_key(url),)] * 2, "key string")
        found = warc.read(archive, warc.lookup(index, asked), payloads=True).collect()
        assert sorted(r.page_id for r in found) == [i for i, u, _ in rows if u == url]
        assert all(r.payload is None if r.record_type == "revisit" else bytes(r.payload).decode() == f"page {r.page_id % 40}" for r in found)
        assert all(r.url == url for r in found)


def test_revisits_are_resolved_by_the_index(spark):
    rows = [(k, f"http://h.example/{k} é", f"page {k % 5}") for k in range(40)]
    archive = warc.write(spark.createDataFrame(rows, SCHEMA))
    index = warc.build_index(archive, block=4)
    every = warc.read(archive, archive.captures)
    full = warc.resolved(archive, index, every.where("record_type = 'revisit'")).collect()
    assert sorted((r.page_id, bytes(r.payload).decode()) for r in full) == [(k, f"page {k % 5}") for k in range(35, 40)]


def test_damage_is_an_error(spark):
    raw = warc.record(1, "http://a.example/", b"payload", None)
    assert warc.parsed(raw)[1] == b"payload"
    with pytest.raises(ValueError, match="isn't what"):
        warc._read(gzip.compress(raw.replace(b"payload\r\n\r\n", b"pAyload\r\n\r\n")))
    with pytest.raises(ValueError, match="no WARC"):
        warc.parsed(b"HTTP/1.1 200 OK\r\n\r\n")


def test_keys_stand_by_domain():
    assert warc.url_key("https://www.Example.com:8080/A?b=C#d") == "com,example,www:8080)/a?b=c"
    assert warc.url_key("http://example.com") == "com,example)/"
    assert all(warc.url_key(u) == warc.url_key(warc.target_uri(u)) for u in URLS)
    assert all(c > " " and c < "\x7f" for u in URLS for c in warc.url_key(u))


def test_empty_table(spark):
    assert got(warc.round_trip(spark.createDataFrame([], SCHEMA))) == []
    archive = warc.write(spark.createDataFrame([], SCHEMA))
    assert warc.lookup(warc.build_index(archive), spark.range(3).select(F.col("id").cast("string").alias("key"))).count() == 0
