"""Filter interaction audit: what each filter removes in each order of the filters, from packed bitmaps.

Rows fail filters by a bit mask. A bitmap index has, for each part and run of rows, a packed bit plane of each filter and label.
Survivors of a set of filters are the AND-NOT of its planes, counted by popcount; counts of all 2^n sets add up over runs and
tasks, and every figure of every order follows from them: step by step a filter removes kept(before) - kept(before and filter).

Defined cases: a null text is empty; a null part is the empty string; null ids have no labels and are no copies; of label rows
with one id any 1 counts; repeated rows (same id, same text) aren't copies of each other, as neither id is smaller; an empty table
has no parts and gives no rows; other columns are not looked at. Texts are told apart by SHA-256.
"""

from __future__ import annotations

import hashlib
import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_slices, join_groups, text_buffer, written

FILTERS = "ABCDE"
COPY = FILTERS.index("E")
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SIGNS = 100, 80, 10, "#$%&*|"
#: Rows of one part in a run of the index at most, and rows that a task holds before it writes runs of all parts.
RUN, HELD = 1 << 16, 1 << 20

_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_SIGN = np.zeros(256, bool)
_SIGN[list(SIGNS.encode())] = True
_FIRST_BYTE = np.ones(256, bool)  # of a code point
_FIRST_BYTE[0x80:0xC0] = False


def failures(column: pa.Array) -> np.ndarray:
    """Bit mask of the filters A to D that each text fails."""
    data, offsets = text_buffer(column)

    def count(kind: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(kind[data], out=total[1:])
        return np.diff(total[offsets])

    raw = data.tobytes()
    words = np.zeros((2, len(offsets) - 1), np.int64)
    for i, (a, b) in enumerate(itertools.pairwise(offsets.tolist())):
        own = raw[a:b].split()  # of bytes, at exactly [\x20\x09-\x0D]
        words[:, i] = len(own), len(set(own))
    fails = [words[0] < LEAST_WORDS, 100 * words[1] < DISTINCT_PERCENT * words[0], 100 * count(_CAPITAL) > CAPITAL_PERCENT * count(_FIRST_BYTE), count(_SIGN) > 0]
    return sum(f.astype(np.int32) << k for k, f in enumerate(fails))


def marked(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, fails, good, toxic) of each row: the mask of failed filters, and whether the labels say so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text", 8_000_000):
            data, offsets = text_buffer(batch.column(2))
            raw = data.tobytes()
            same = [hashlib.sha256(raw[a:b]).digest() for a, b in itertools.pairwise(offsets.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(same, pa.binary()), pa.array(failures(batch.column(2)))], ["doc_id", "part", "same", "fails"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).cast("string").alias("text"))
    rows = written(texts.mapInArrow(run, "doc_id long, part string, same binary, fails int"), "failures")
    groups = rows.groupBy("same").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("last > first")
    copies = join_groups(rows, written(groups.select("same", "n", "first"), "copies"), "same", rows.count())
    copies = copies.select("doc_id", "part", F.col("fails").bitwiseOR(F.when(F.col("doc_id") > F.col("first"), 1 << COPY).otherwise(0)).alias("fails"))
    said = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias("good" if c == "quality" else c)
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(said("quality"), said("toxic"))
    told = copies.where("doc_id is not null").join(known, "doc_id", "left").select("part", "fails", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))
    return told.unionByName(copies.where("doc_id is null").select("part", "fails", F.lit(False).alias("good"), F.lit(False).alias("toxic")))


def _packed(bits: np.ndarray) -> bytes:
    """A bit a row, in whole words of 64."""
    out = np.zeros(-(-len(bits) // 64) * 8, np.uint8)
    part = np.packbits(bits, bitorder="little")
    out[: len(part)] = part
    return out.tobytes()


def bitmap_index(rows: DataFrame, filters: int = len(FILTERS)) -> DataFrame:
    """(part, planes) of (part, fails, good, toxic): for each run of at most RUN rows of a part a packed plane of each filter,
    of good, of toxic, and of the rows that are there."""

    def runs(part: str, fails: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> Iterator[tuple[str, list[bytes]]]:
        for at in range(0, len(fails), RUN):
            f = fails[at : at + RUN]
            planes = [(f >> k) & 1 for k in range(filters)] + [good[at : at + RUN], toxic[at : at + RUN], np.ones(len(f), bool)]
            yield part, [_packed(x) for x in planes]

    def flushed(held: dict[str, list[tuple]]) -> Iterator[pa.RecordBatch]:
        found = [x for part, own in held.items() for x in runs(part, *(np.concatenate(c) for c in zip(*own, strict=True)))]
        for at in range(0, len(found), 64):
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found[at : at + 64]], pa.string()), pa.array([x for _, x in found[at : at + 64]], pa.list_(pa.binary()))], ["part", "planes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple]] = defaultdict(list)
        n = 0
        for batch in batches:
            part = batch.column(0).dictionary_encode()
            code = part.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(code, kind="stable")
            cut = np.searchsorted(code[order], np.arange(len(part.dictionary) + 1))
            columns = [batch.column(k).to_numpy(zero_copy_only=False)[order] for k in (1, 2, 3)]
            for name, (a, b) in zip(part.dictionary.to_pylist(), itertools.pairwise(cut.tolist()), strict=True):
                held[name].append(tuple(c[a:b] for c in columns))
            n += batch.num_rows
            if n >= HELD:
                yield from flushed(held)
                held.clear()
                n = 0
        yield from flushed(held)

    return rows.select("part", "fails", "good", "toxic").mapInArrow(run, "part string, planes array<binary>")


def survivors(index: DataFrame, filters: int = len(FILTERS)) -> DataFrame:
    """(part, gone, kept, good, toxic): for each part and set ``gone`` of filters (a mask) the rows that fail none of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            planes = batch.column(1).to_pylist()
            starts = np.concatenate([[0], np.cumsum([len(p[0]) // 8 for p in planes])])[:-1]
            words = [np.frombuffer(b"".join(p[k] for p in planes), np.uint64) for k in range(filters + 3)]
            alive = [words[-1]]
            for gone in range(1, 1 << filters):
                last = gone.bit_length() - 1
                alive.append(alive[gone ^ (1 << last)] & ~words[last])
            count = lambda x: np.add.reduceat(np.bitwise_count(x), starts, dtype=np.int64)
            found = [[count(x & y) for x in alive] for y in (words[-1], words[-3], words[-2])]
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(batch.column(0).to_pylist() * (1 << filters), pa.string()), pa.array(np.repeat(np.arange(1 << filters, dtype=np.int32), n)), *(pa.array(np.concatenate(c)) for c in found)],
                ["part", "gone", "kept", "good", "toxic"],
            )

    counts = index.mapInArrow(run, "part string, gone int, kept long, good long, toxic long")
    return counts.groupBy("part", "gone").agg(*(F.sum(c).alias(c) for c in ("kept", "good", "toxic")))


def interactions(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row for each part, order of the filters and step, from the survivors of all sets of filters."""
    n = len(filters)
    full = (1 << n) - 1
    orders = list(itertools.permutations(range(n)))
    names = np.repeat(["".join(filters[f] for f in order) for order in orders], n)
    f = np.array(orders).ravel()
    before = np.array([[sum(1 << x for x in order[:k]) for k in range(n)] for order in orders]).ravel()
    after = before | 1 << f
    step = np.tile(np.arange(1, n + 1, dtype=np.int32), len(orders))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sets in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                kept, good, toxic = (np.array([x[c] for x in sets]) for c in ("kept", "good", "toxic"))
                removed = kept[before] - kept[after]
                shapley = np.zeros(n, np.int64)
                np.add.at(shapley, f, removed)
                alone = np.array([kept[full ^ 1 << k] - kept[full] for k in range(n)])
                columns = [[part] * len(f), names, step, kept[after], removed, (kept[0] - kept[1 << f]) - removed, alone[f], good[before] - good[after], toxic[before] - toxic[after], shapley[f]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], kind.names)

    kind = T.StructType.fromDDL("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long")
    # One array of 2^n sums a part, in order of the sets.
    return counts.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("gone", "kept", "good", "toxic"))).alias("sets")).mapInArrow(run, kind)


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """The audit of filters A to E: per part, order and step the rows kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return interactions(survivors(bitmap_index(marked(docs, labels, id_col, text_col, part_col))))
