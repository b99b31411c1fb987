"""Helpers shared by the corpus operators: tables, the shared folder, Arrow text buffers and word hashes."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Odd multiplier of the polynomial hashes; its inverse modulo 2**64 undoes the shift of a start offset.
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_MIX1, _MIX2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_base(spark: SparkSession) -> str:
    """URI of the folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``. Only where that is unset and Spark runs inside this one
    process (tests) a temporary folder takes its place; a cluster without the setting is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_folder()


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="corvane-")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh URI below the shared folder."""
    return f"{shared_base(spark)}/corvane-{name}-{uuid.uuid4().hex}"


def shared_local_dir(spark: SparkSession, name: str) -> str:
    """A fresh shared folder as a path that workers can memory-map.

    Memory mapping needs a mounted file system, so the shared folder must be a ``file:`` URI or a plain path.
    """
    uri = urlparse(shared_path(spark, name))
    scheme = uri.scheme or urlparse(spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "").scheme
    if scheme not in ("", "file"):
        raise ValueError(f"memory-mapped indexes need a mounted shared folder, not {scheme}://")
    os.makedirs(uri.path, exist_ok=True)
    return uri.path


_SCRATCH: list[list[str]] = []


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """``df`` written once as Parquet into the shared folder and read back: cuts lineage, survives lost executors. Within ``scratch`` it is
    deleted at the end, unless told to ``keep`` it."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    if _SCRATCH and not keep:
        _SCRATCH[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables written inside when it is left. What comes out of it must be written with ``keep``, and so not read them any more."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


#: Bytes of text for each range of an index's keys.
RANGE_BYTES = 32_000_000


def ranges_for(texts: DataFrame, text_col: str, size: int | None = None, least: int | None = None) -> int:
    """Ranges of an index over the texts: one for each ``size`` bytes of them (RANGE_BYTES unless given), and no fewer than ``least`` (the
    shuffle's partitions unless given), so a range is as large whatever the input."""
    volume = texts.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col).cast("string"))), F.lit(0))).first()[0]
    return max(1, least or int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(volume) // (size or RANGE_BYTES)))


def range_of(h: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each 64-bit key: by order of the keys."""
    return (((h >> U64(32)) * U64(ranges)) >> U64(32)).astype(np.int64)


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n+1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
    column = column.fill_null("").cast(pa.large_string()) if column.null_count else column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; all other bytes stay."""
    return _LOWER[data]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (byte positions) and row of each word, a maximal run without space, tab, LF, VT, FF and CR."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    word = ~_SPACE[data]
    first = np.zeros(n + 1, bool)
    first[offsets[:-1]] = True  # words don't cross rows
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | first[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:]
    last = np.zeros(n + 1, bool)
    last[offsets[1:]] = True
    ends = np.flatnonzero(word & (~after | last[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


@lru_cache(maxsize=8)
def _byte_values(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)


_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, U64), "down": np.ones(1, U64)}


def powers(which: str, n: int) -> np.ndarray:
    """Powers of the multiplier ("up") or of its inverse ("down"), kept and grown by doubling."""
    have = _POWERS[which]
    if len(have) < n:
        step = _P if which == "up" else _P_INV
        while len(have) < n:
            have = np.concatenate([have, have * U64(pow(step, len(have), 1 << 64))])
        _POWERS[which] = have
    return have[:n]


def prefix_hash(data: np.ndarray, seed: int = 1) -> np.ndarray:
    """Running polynomial sums; ``span_hash`` takes the hash of any span from them in constant time."""
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(_byte_values(seed)[data] * powers("up", len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mixed((prefix[ends] - prefix[starts]) * powers("down", len(prefix))[starts])


def mixed(x: np.ndarray) -> np.ndarray:
    """Bit finaliser, a bijection of 64-bit values."""
    x = (x ^ (x >> U64(30))) * _MIX1
    x = (x ^ (x >> U64(27))) * _MIX2
    return x ^ (x >> U64(31))


_X1, _X2, _X3, _X4, _X5 = map(U64, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))  # fixed values of XXH64
#: Spans from this many bytes on are few; they are hashed one by one.
_ONE_BY_ONE = 512


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << U64(by)) | (x >> U64(64 - by))


def xx64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """XXH64 of the bytes of each span, worked side by side: 32 bytes, 8, 4 and 1 at a step for all spans that have them."""
    size = (ends - starts).astype(np.int64)
    out = np.empty(len(size), U64)
    if not len(size):
        return out
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    out[:] = U64((seed + int(_X5)) & 0xFFFFFFFFFFFFFFFF)
    at = np.array(starts, np.int64)
    wide = np.flatnonzero((size >= 32) & (size < _ONE_BY_ONE))
    if len(wide):
        lanes = [np.full(len(wide), (seed + int(x) * plus + int(_X2) * two) & 0xFFFFFFFFFFFFFFFF, U64) for x, plus, two in ((_X1, 1, 1), (_X1, 0, 1), (_X1, 0, 0), (_X1, -1, 0))]
        left = size[wide] // 32
        for step in range(int(left.max())):
            who = np.flatnonzero(left > step)
            for k, lane in enumerate(lanes):
                lane[who] = _turned(lane[who] + eight[at[wide[who]] + 32 * step + 8 * k] * _X2, 31) * _X1
        at[wide] += 32 * left
        h = sum((_turned(lane, by) for lane, by in zip(lanes, (1, 7, 12, 18), strict=True)), np.zeros(len(wide), U64))
        for lane in lanes:
            h = (h ^ (_turned(lane * _X2, 31) * _X1)) * _X1 + _X4
        out[wide] = h
    out += size.astype(U64)
    rest = np.where(size < _ONE_BY_ONE, size & 31, 0)
    for _ in range(3):
        who = np.flatnonzero(rest >= 8)
        if not len(who):
            break
        out[who] = _turned(out[who] ^ (_turned(eight[at[who]] * _X2, 31) * _X1), 27) * _X1 + _X4
        at[who] += 8
        rest[who] -= 8
    who = np.flatnonzero(rest >= 4)
    out[who] = _turned(out[who] ^ ((eight[at[who]] & U64(0xFFFFFFFF)) * _X1), 23) * _X2 + _X3
    at[who] += 4
    rest[who] -= 4
    for _ in range(3):
        who = np.flatnonzero(rest > 0)
        out[who] = _turned(out[who] ^ (padded[at[who]].astype(U64) * _X5), 11) * _X1
        at[who] += 1
        rest[who] -= 1
    out = (out ^ (out >> U64(33))) * _X2
    out = (out ^ (out >> U64(29))) * _X3
    out ^= out >> U64(32)
    for i in np.flatnonzero(size >= _ONE_BY_ONE).tolist():
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes(), seed)
    return out


def hashed_words(column: pa.Array, seed: int = 1, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """XXH64 and row of each word of a text column, and the number of words of each row."""
    data, offsets = text_buffer(column)
    if lower:
        data = lowered(data)
    starts, ends, rows = word_spans(data, offsets)
    return xx64(data, starts, ends, seed), rows, np.bincount(rows, minlength=len(offsets) - 1)


def in_slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 24_000_000) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each has about ``most`` bytes of text, or one row: bounds a worker's memory."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        _, offsets = text_buffer(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


#: A key that holds more than one of so many of all rows is hot; there are fewer such keys than this, so they are broadcast.
HOT_SHARE = 256


def join_groups(rows: DataFrame, groups: DataFrame, key: str, total: int, count: str = "n") -> DataFrame:
    """``rows`` left-joined with ``groups`` (key, count, ...), one row a key; ``count`` names the number of rows of a key among all ``total``.

    Rows of hot keys meet them by a broadcast of fewer than HOT_SHARE rows and stay where they are, so no task gathers a hot group.
    """
    hot = groups.where(F.col(count) * HOT_SHARE > total)
    stay = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return stay.unionByName(rest.join(groups.where(F.col(count) * HOT_SHARE <= total), key, "left"))
