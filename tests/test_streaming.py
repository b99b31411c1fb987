"""Streams over files."""

import json
import os

from pyspark.sql import functions as F

from corvane.functions.vectors import hashing_embedding
from corvane.operators.store import Tables
from corvane.schemas import EMBEDDING_CACHE
from corvane.streaming.incremental import embed_new, new_files, thread_states


def test_only_new_texts_are_embedded(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    tables = Tables(spark, str(tmp_path / "tables"))
    for k, texts in enumerate((["a b", "c"], ["c", "d", "d"])):
        (source / f"{k}.json").write_text("\n".join(json.dumps({"text": t}) for t in texts))
        stream = spark.readStream.schema("text string").json(str(source)).withColumn("text_sha256", F.sha2("text", 256))
        embed_new(stream, tables, hashing_embedding, "m", 64, str(tmp_path / "checkpoint")).awaitTermination()
    rows = tables.read("embedding_cache", EMBEDDING_CACHE).collect()
    assert len(rows) == 3 and all(len(r.vector) == 64 for r in rows)


def test_thread_state_appends(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    early = [("t", 0, "assistant", "first of all", None)]  # arrives last
    for k, rows in enumerate(([("t", 2, "assistant", "yes", ["p"]), ("t", 1, "user", "hi", [])], [("t", 3, "user", "more", ["p", "q"]), ("u", 1, "user", "x", [])], early)):
        (source / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(("thread_id", "turn", "role", "text", "provisions"), r, strict=True))) for r in rows))
        os.utime(source / f"{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema("thread_id string, turn long, role string, text string, provisions array<string>").option("maxFilesPerTrigger", 1).json(str(source))
    seen = {}
    query = thread_states(stream).writeStream.outputMode("update").foreachBatch(lambda df, _: seen.update({r.thread_id: r for r in df.collect()})).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    t = seen["t"]
    assert (t.turns, t.messages, t.provisions, t.last_answer) == (4, ["first of all", "hi", "yes", "more"], ["p", "q"], "yes")
    assert (seen["u"].turns, seen["u"].last_answer) == (1, None)


def test_a_file_seen_again_is_not_new(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for k, digest in enumerate(("a", "b", "a")):
        (source / f"{k}.json").write_text(json.dumps({"filename": f"{k}", "sha256": digest, "seen_at": f"2026-01-0{k + 1}T00:00:00Z"}))
    stream = spark.readStream.schema("filename string, sha256 string, seen_at timestamp").json(str(source))
    rows = []
    new_files(stream).writeStream.foreachBatch(lambda df, _: rows.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.sha256 for r in rows) == ["a", "b"]
