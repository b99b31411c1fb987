"""Streams that are stopped at bad moments."""

import base64
import json
import os

import pytest
from pyspark.sql import functions as F

from corvane.operators import store
from corvane.operators.store import Tables
from corvane.plans.corpus import ingest
from corvane.schemas import CHUNKS, DOCUMENTS, POSTINGS, PROVISIONS, TERMS, TOTALS
from corvane.sources import markup
from corvane.streaming import incremental

FILE = "content binary, source_id string, language string, short_title string, url string, sha256 string, seen_at timestamp"


def act(words):
    return f"<html xmlns='http://www.w3.org/1999/xhtml'><body>{''.join(f'<div id=\"art_{k}\"><p class=\"oj-ti-art\">Article</p><p>{w}</p></div>' for k, w in enumerate(words, 1))}</body></html>"


VERSIONS = [("a", ["providers", "systems and risk"], "s1"), ("b", ["records are kept"], "s2"), ("a", ["providers only"], "s3"), ("b", ["records are kept"], "s2")]


def put(folder, k, name, words, digest):
    row = {"content": base64.b64encode(act(words).encode()).decode(), "source_id": name, "language": "en", "short_title": name, "url": "u", "sha256": digest, "seen_at": f"2026-01-0{k + 1}T00:00:00Z"}
    (folder / f"{k}.json").write_text(json.dumps(row))
    os.utime(folder / f"{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))


def contents(tables):
    names = (("documents", DOCUMENTS), ("provisions", PROVISIONS), ("chunks", CHUNKS), ("postings", POSTINGS), ("terms", TERMS), ("totals", TOTALS))
    return {name: sorted(map(repr, tables.read(name, schema).collect())) for name, schema in names}


@pytest.mark.parametrize("moment", ["before the commit", "after the commit"])
def test_a_replayed_batch_changes_nothing(spark, tmp_path, monkeypatch, moment):
    monkeypatch.setattr(store, "BUCKETS", 2)
    source = tmp_path / "in"
    source.mkdir()
    for k, v in enumerate(VERSIONS):
        put(source, k, *v)
    tables = Tables(spark, str(tmp_path / "t"))
    stream = spark.readStream.schema(FILE).option("maxFilesPerTrigger", 1).json(str(source))
    commit, calls = Tables._commit, []

    def failing(self, *args):
        calls.append(1)
        if moment == "after the commit":
            commit(self, *args)
        if len(calls) == 2:
            raise RuntimeError("the driver is lost")
        if moment == "before the commit":
            commit(self, *args)

    monkeypatch.setattr(Tables, "_commit", failing)
    with pytest.raises(Exception, match="the driver is lost"):
        incremental.ingest_files(stream, tables, "acts", str(tmp_path / "c")).awaitTermination()
    monkeypatch.setattr(Tables, "_commit", commit)
    assert tables.done("acts") == (1 if moment == "after the commit" else 0)
    incremental.ingest_files(stream, tables, "acts", str(tmp_path / "c")).awaitTermination()
    whole = Tables(spark, str(tmp_path / "whole"))
    for k in (1, 2):  # the last version of each document
        name, words, digest = VERSIONS[k]
        documents = spark.createDataFrame([(f"{name}:en", name, "en", name, "u", digest)], "document_id string, source_id string, language string, title string, url string, sha256 string").withColumn("fetched_at", F.lit(f"2026-01-0{k + 1}T00:00:00Z").cast("timestamp"))
        ingest(whole, documents, markup.parse_acts(spark.createDataFrame([(bytearray(act(words).encode()), name, "en", name)], "content binary, source_id string, language string, short_title string")))
    assert contents(tables) == contents(whole)
    assert len(tables._versions()) == 3  # three batches that brought something new
    assert tables.vacuum() > 0 and contents(tables) == contents(whole) and tables.done("acts") >= 2
