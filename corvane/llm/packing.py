"""Best-fit packing planned on a length histogram.

Texts are tokenised once; each document is its ids and an end id, cut into pieces only if longer than a sequence. The
planner sees counts of piece lengths, at most ``capacity`` of them: lengths in falling order go to the fullest open
sequences that still hold them, whole ranges of sequences at a time. A placement is a run (length, first rank, count,
first sequence, offset). Pieces then take planned slots by joining on their rank within their length. Ranks are counted in
salted groups, so a length that many pieces share is spread over tasks.

Defined cases: null text is empty; an empty text is the single end id; repeated rows are packed one by one; a very long text
is cut, never shortened; further columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_slices, written

CAPACITY = 2048
END_ID = 0
#: Ranks of a length in one block of the plan's join key, and pieces ranked in one salted group.
RANK_BLOCK = 1024
RANKED = 50_000
#: Only these characters, in runs of no more than this, go to the quick encoder; any other text goes to the tokenizer itself.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xac\xae-ɏ]*\Z")
_LONGEST = 400
_WHITE_RUN = re.compile(rf"\s{{{_LONGEST}}}")


def _long_run(text: str) -> bool:
    """Whether a word or a stretch of white space has _LONGEST characters."""
    if max(map(len, text.split()), default=0) >= _LONGEST:
        return True
    return any(two in text for two in ("  ", "\n\n", " \n", "\n ", "\t", "\r")) and bool(_WHITE_RUN.search(text))


@lru_cache(maxsize=4)
def encoder(path: str):
    """A function from a list of texts to lists of ids, equal to the tokenizer's own.

    ``path`` is a byte-level BPE ``.json``. Beside it lies the same vocabulary as ranks, which a faster encoder reads; where
    that file is missing, or for texts with characters on whose class the two libraries could differ, the tokenizer encodes.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    exact = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    try:
        import public_tokenizers
        import tiktoken

        with open(path.removesuffix(".json") + ".tiktoken", "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        special = {"<|endoftext|>": len(ranks)}
        quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    except (ImportError, OSError):
        return lambda texts: [exact(t) for t in texts]

    def ids(text: str) -> list[int]:
        if "<|" in text or not _PLAIN.match(text) or _long_run(text):
            return exact(text)
        return quick.encode_ordinary(text)

    return lambda texts: [ids(t) for t in texts]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        for batch in in_slices(batches, "text", 2_000_000):
            rows: list[tuple[int, int, int, int, int]] = []
            for doc, found in zip(batch.column(0).to_pylist(), encode([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                found.append(END_ID)
                ids = np.array(found, "<u4")
                first = (len(ids) - 1) % capacity + 1
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                rows += [(doc, k, a, b - a, zlib.crc32(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
            columns = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, count, first sequence, offset): pieces of the length with ranks from the first take the
    sequences from the first, one each, at the offset."""
    runs: list[tuple[int, int, int, int, int]] = []
    rooms: list[int] = []  # free lengths that some open sequences have, sorted
    opened: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free length -> (first sequence, count)
    fresh = 0

    def put(room: int, first: int, count: int) -> None:
        if room:
            if not opened[room]:
                insort(rooms, room)
            opened[room].append((first, count))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):  # none holds it: open sequences that take as many of this length as they can
                per = min(capacity // length, left)
                full = left // per
                for k in range(per):
                    runs.append((length, rank, full, fresh, k * length))
                    rank += full
                put(capacity - per * length, fresh, full)
                left, fresh = left - per * full, fresh + full
                continue
            room = rooms[at]
            first, count = opened[room].pop()
            if not opened[room]:
                rooms.pop(at)
            take = min(count, left)
            runs.append((length, rank, take, first, capacity - room))
            rank, left = rank + take, left - take
            if take < count:
                put(room, first + take, count - take)
            put(room - length, first, take)
    return runs


def ranked(cut: DataFrame, largest: int) -> DataFrame:
    """``cut`` with rank (from 0, without gaps) within length."""
    salts = max(8, -(-largest // RANKED))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    starts = sizes.select("length", "salt", before.alias("before"))
    return salted.withColumn("own", own).join(starts, ["length", "salt"]).withColumn("rank", F.col("own") + F.col("before")).drop("own", "before", "salt")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    cut = written(pieces(docs, tokenizer_path, capacity, id_col, text_col), "pieces")
    # At most ``capacity`` rows.
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = plan(histogram, capacity)
    slots = spark.createDataFrame(runs, "r_length long, r_rank long, r_count long, r_sequence long, r_offset long")
    blocks = F.sequence(F.expr(f"r_rank div {RANK_BLOCK}"), F.expr(f"(r_rank + r_count - 1) div {RANK_BLOCK}"))
    slots = slots.withColumn("r_block", F.explode(blocks))
    placed = ranked(cut, max(histogram.values(), default=0)).withColumn("block", F.expr(f"rank div {RANK_BLOCK}"))
    on = (F.col("length") == F.col("r_length")) & (F.col("block") == F.col("r_block")) & (F.col("rank") >= F.col("r_rank")) & (F.col("rank") < F.col("r_rank") + F.col("r_count"))
    sequence = F.col("r_sequence") + F.col("rank") - F.col("r_rank")
    return placed.join(slots, on).select("doc_id", "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), F.col("r_offset").alias("offset"))
