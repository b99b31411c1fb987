"""Streams: idempotent ingest, incremental embedding, resumable thread state."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import Settings
from ..operators.store import Tables, embedded, pending
from ..plans.corpus import ingest
from ..schemas import EMBEDDING_CACHE, THREAD_STATE
from ..sources.markup import parse_acts


def new_files(stream: DataFrame, watermark: str = "7 days") -> DataFrame:
    """Files (filename, sha256, seen_at, ...) whose content wasn't seen within the watermark."""
    return stream.withWatermark("seen_at", watermark).dropDuplicatesWithinWatermark(["sha256"])


def ingest_files(stream: DataFrame, tables: Tables, name: str, checkpoint: str, settings: Settings | None = None):
    """A query that parses, chunks and indexes the acts of a stream of files (content, source_id, language, short_title, url, sha256, seen_at), each
    content once, and stores them exactly once.

    A batch's number is committed with its rows under the query's ``name``. A batch that comes again, as its checkpoint wasn't
    written, is recognised and left out; one whose commit didn't happen left nothing that is seen and is done anew. Of files of one
    document in a batch the last seen counts.
    """

    def batch(df: DataFrame, number: int) -> None:
        own = df.persist()
        try:
            # All of it is read, also of a batch that is left out, as the state of what was seen is written by that.
            if not own.count() or number <= tables.done(name):
                return
            files = own.withColumn("document_id", F.concat_ws(":", "source_id", "language"))
            last = files.groupBy("document_id").agg(F.max_by(F.struct(*files.columns), F.struct("seen_at", "sha256")).alias("f")).select("f.*")
            documents = last.select("document_id", "source_id", "language", F.col("short_title").alias("title"), "url", "sha256", F.col("seen_at").alias("fetched_at"))
            ingest(tables, documents, parse_acts(last), settings, batch=(name, number))
        finally:
            own.unpersist()

    return new_files(stream).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def embed_new(stream: DataFrame, tables: Tables, embed, model: str, dimensions: int, checkpoint: str):
    """A query that adds vectors of texts (text_sha256, text) the cache doesn't have; a repeated batch adds nothing."""

    def batch(df: DataFrame, _: int) -> None:
        fresh = pending(df, tables.read("embedding_cache", EMBEDDING_CACHE), model)
        tables.append("embedding_cache", embedded(fresh, embed, model, dimensions))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


_STATE = "turns array<long>, roles array<string>, texts array<string>, provisions array<string>"


def thread_states(stream: DataFrame) -> DataFrame:
    """Running state of each thread of messages (thread_id, turn, role, text, provisions): lists in order of turn whatever the
    order of arrival (equal turns: of arrival), provisions by their first mention, the last answer that of the assistant's latest turn.

    A thread's messages are its state, as they are what a model call sends at once; a null list of provisions is empty.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [list(x) for x in state.get] if state.exists else [[], [], [], []]
        for r in pd.concat(list(frames)).itertuples():
            own = [] if r.provisions is None else [str(p) for p in r.provisions]
            for values, x in zip(held, (int(r.turn), r.role, r.text, json.dumps(own)), strict=True):
                values.append(x)
        order = sorted(range(len(held[0])), key=held[0].__getitem__)
        held = [[values[k] for k in order] for values in held]
        state.update(tuple(held))
        turns, roles, texts, provisions = held
        said = [t for role, t in zip(roles, texts, strict=True) if role == "assistant"]
        seen = list(dict.fromkeys(p for own in provisions for p in json.loads(own)))
        yield pd.DataFrame([{"thread_id": key[0], "turns": len(turns), "messages": texts, "provisions": seen, "last_answer": said[-1] if said else None}])

    return stream.groupBy("thread_id").applyInPandasWithState(update, THREAD_STATE, _STATE, "update", GroupStateTimeout.NoTimeout)


def recent_activity(stream: DataFrame, gap: str = "30 minutes", watermark: str = "1 hour") -> DataFrame:
    """Sessions of threads by silence between messages (thread_id, at): an analytic view; the true key is the thread."""
    return stream.withWatermark("at", watermark).groupBy("thread_id", F.session_window("at", gap)).agg(F.count("*").alias("messages"))
