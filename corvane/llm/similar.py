"""All pairs of texts whose sets of 5-word shingles have a Jaccard similarity of at least 0.8, by prefix filtering.

Shingles are put in one order for all texts: those that a bounded sample doesn't show to be common come first, by hash. Two sets
of that similarity share a shingle among the first n - ceil(0.8 n) + 1 of each, so texts are filed under those and no pair is
missed whatever the sample says; it only keeps lines that stand in many texts out of the keys. Sizes and the places of the shared
shingle turn most others away, and what is left is compared set by set.

Keys that have the same texts count once, under the first of them, so copies that share a thousand keys meet once; a list of texts
gives BUCKET * (BUCKET - 1) / 2 pairs at most. Folded parity bitmaps turn most pairs away before sets are joined.

Links join into components, so pairs that are in one component already needn't be compared. Of a bucket of more than
BUCKET texts a round compares stars only. Keys whose buckets hold several components after that are put last in the order, and the
texts under them are filed anew by what then comes first: a pair that only met there shares one of those keys. After ROUNDS such
rounds, texts that still meet under a large key are compared all with all in pieces of at most 4 * PIECE^2 pairs, each by parity
bitmaps: bits that differ are no more than shingles that differ, so no similar pair is turned away.

Shingles are 64-bit hashes of words in lower case (A-Z); texts of fewer words than a shingle are one shingle; empty texts have none;
texts are told apart by XXH64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, hashed_words, in_slices, mixed, written

SHINGLE = 5
#: Similarity as a fraction: sets of n and m shingles with i in common are similar if i * (4 + 5) >= 4 * (n + m).
PART, WHOLE = 4, 5
#: Texts in the sample, how often a common shingle stands in it at least, and how many of those are sent to all tasks.
SAMPLE, SEEN, COMMON = 20_000, 4, 100_000
BUCKET = 64
#: Times that texts of large buckets are filed anew, and texts of a key in a share (about), and shingles, when they are then compared.
ROUNDS, PIECE, VOLUME = 2, 1024, 1_000_000
#: Bits of a parity bitmap, and of its fold that is compared first.
BITS, FOLD = 4096, 512
#: Texts to compare that are sent to all tasks (8 bytes each); more are joined by a shuffle.
SENT = 200_000
_ROWS = 1 << 20  # pairs tried at a time
_PLACES = U64(0x9E3779B97F4A7C15) * np.arange(3, 2 * SHINGLE + 3, 2, dtype=U64) | U64(1)


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and hash of each distinct shingle of a row, by row and hash, and the number of them in each row."""
    h, _, words = hashed_words(column, 5)
    number = np.where(words > 0, np.maximum(words - SHINGLE + 1, 1), 0)
    row = np.repeat(np.arange(len(words)), number)
    start = np.repeat(np.cumsum(words) - words - np.cumsum(number) + number, number) + np.arange(len(row))
    length = np.minimum(words, SHINGLE)[row]
    total = length.astype(U64)
    for k in range(SHINGLE):
        total += np.where(k < length, h[np.minimum(start + k, len(h) - 1)] * _PLACES[k], U64(0)) if len(row) else total
    total = mixed(total).view(np.int64)
    order = np.lexsort((total, row))
    row, total = row[order], total[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (total[1:] != total[:-1])
    return row[new], total[new], np.bincount(row[new], minlength=len(words))


def common_shingles(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Common shingles of a sample of (h, text), sorted, and how often each is in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text", 3_000_000):
            yield pa.RecordBatch.from_arrays([pa.array(shingles(batch.column(0))[1])], ["key"])

    share = int(1_000_000 * min(1.0, SAMPLE / max(1, texts.count())))
    sample = texts.where(F.pmod(F.xxhash64("h"), F.lit(1_000_000)) < share).select("text")
    found = sample.mapInArrow(run, "key long").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= SEEN).orderBy(F.desc("n"), "key").limit(COMMON).toArrow()
    key, n = (found.column(k).to_numpy() for k in ("key", "n"))
    order = np.argsort(key)
    return key[order], n[order]


def put_last(common: tuple[np.ndarray, np.ndarray], keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order with ``keys`` behind all others, by their counts; others stay in the order they had."""
    stays = ~np.isin(common[0], keys)
    key, rank = np.concatenate([common[0][stays], keys]), np.concatenate([common[1][stays], (1 << 40) + counts])
    order = np.argsort(key)
    return key[order], rank[order]


def prefixes(column: pa.Array, common: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, pa.Array]:
    """Shingles of each row, and those that it is filed under, in order."""
    row, h, n = shingles(column)
    rank = np.zeros(len(h), np.int64)
    if len(common[0]):
        at = np.minimum(np.searchsorted(common[0], h), len(common[0]) - 1)
        rank = np.where(common[0][at] == h, common[1][at], 0)
    h = h[np.lexsort((h, rank, row))]
    own = np.where(n > 0, n - -(-n * PART // WHOLE) + 1, 0)
    place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
    keys = h[place < np.repeat(own, n)]
    return n, pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(own)]), pa.int32()), pa.array(keys))


def _may_be(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether sets can be similar whose first shared shingle this is: x and y are size << 32 | place."""
    n, m = x >> 32, y >> 32
    return (PART + WHOLE) * np.minimum(n - (x & 0xFFFFFFFF), m - (y & 0xFFFFFFFF)) >= PART * (n + m)


def _pairs(text: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct pairs of each row i with the rows from first[i] to before last[i] that may be similar."""
    todo = last - first
    cut = np.cumsum(todo)
    i = 0
    while i < len(todo):
        to = max(i + 1, int(np.searchsorted(cut, (cut[i - 1] if i else 0) + _ROWS, side="right")))
        t = todo[i:to]
        a = np.repeat(np.arange(i, to), t)
        b = first[a] + np.arange(len(a)) - np.repeat(np.cumsum(t) - t, t)
        ok = _may_be(at[a], at[b]) & (text[a] != text[b])
        u, v = text[a[ok]], text[b[ok]]
        if len(u):
            yield tuple(np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], axis=1), axis=0).T)
        i = to


def _whole_buckets(work):
    """Calls ``work`` with the columns of batches sorted by the first of them, cut so that equal values stay together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[list[np.ndarray]] = []
        for batch in batches:
            now = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(batch.num_columns)]
            if not len(now[0]):
                continue
            cut = int(np.searchsorted(now[0], now[0][-1], side="left"))  # the last bucket may go on in the next batch
            if cut or rest and rest[-1][0][-1] != now[0][-1]:
                rest.append([x[:cut] for x in now])
                yield from work(*(np.concatenate(c) for c in zip(*rest, strict=True)))
                rest = []
            rest.append([x[cut:] for x in now])
        if rest:
            yield from work(*(np.concatenate(c) for c in zip(*rest, strict=True)))

    return run


def _first_round(key: np.ndarray, at: np.ndarray, text: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (texts, at, key): the texts of small buckets, by text, and stars of large ones, two by two; then each row of a large bucket with its key."""
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
    key, at, text = key[new], at[new], text[new]
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(begin, len(key)))
    none = lambda n: pa.nulls(n, pa.int64())

    def batch(text: np.ndarray, at: np.ndarray, number: np.ndarray, key: pa.Array) -> pa.RecordBatch:
        cuts = pa.array(np.concatenate([[0], np.cumsum(number)]), pa.int32())
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(cuts, pa.array(text)), pa.ListArray.from_arrays(cuts, pa.array(at)), key], ["texts", "at", "key"])

    few = size[(size > 1) & (size <= BUCKET)]
    own = np.flatnonzero(np.repeat((size > 1) & (size <= BUCKET), size))
    own = own[np.lexsort((text[own], np.repeat(np.arange(len(few)), few)))]
    yield batch(text[own], at[own], few, none(len(few)))
    large = np.repeat(size > BUCKET, size)
    if large.any():
        # A large bucket's rows meet their neighbour, and the first row all.
        first, i = np.repeat(begin, size), np.flatnonzero(large)
        a, b = np.concatenate([first[i], i - 1]), np.concatenate([i, i])
        ok = (np.tile(i, 2) != np.tile(first[i], 2)) & _may_be(at[a], at[b])
        a, b = a[ok], b[ok]
        a, b = np.where(text[a] < text[b], a, b), np.where(text[a] < text[b], b, a)
        two = np.stack([a, b], axis=1).ravel()
        yield batch(text[two], at[two], np.full(len(a), 2), none(len(a)))
        yield batch(text[large], at[large], np.ones(len(i), np.int64), pa.array(key[large]))


def _of_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (u, v) of the texts of each row (texts, at) that may be similar."""
    for batch in batches:
        number = batch.column(0).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        text, at = (batch.column(k).flatten().to_numpy(zero_copy_only=False) for k in (0, 1))
        for u, v in _pairs(text, at, np.arange(len(text)) + 1, np.repeat(np.cumsum(number), number)):
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def bitmaps(row: np.ndarray, h: np.ndarray, rows: int) -> np.ndarray:
    """For each row the parity of its shingles at each of BITS places, packed."""
    odd = np.zeros(rows * BITS, bool)
    place, times = np.unique(row * BITS + (h.view(np.uint64) % U64(BITS)).astype(np.int64), return_counts=True)
    odd[place] = times % 2 == 1
    return np.packbits(odd.reshape(rows, BITS), axis=1)


def _runs(row: np.ndarray, rows: int) -> list[tuple[int, int, int, int]]:
    """Runs of 512 rows, whose bitmaps are made at a time: their first row, the one after them, and the places of their shingles."""
    return [(k, min(k + 512, rows), *np.searchsorted(row, [k, min(k + 512, rows)])) for k in range(0, rows, 512)]


def _apart(key: np.ndarray, side: np.ndarray, root: np.ndarray, at: np.ndarray, text: np.ndarray, bits: np.ndarray, sets: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Similar pairs of a piece that join different roots, as few as do so; a piece has one side, or two that meet each other only.

    Pairs that the bitmaps let through are compared set by set, the closest first, and those of one component by then not at all."""
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    for a, b in zip(begin, np.append(begin[1:], len(key)), strict=True):
        words = np.frombuffer(b"".join(bits[a:b]), np.uint64).reshape(b - a, -1)
        fold = np.bitwise_xor.reduce(words.reshape(b - a, -1, FOLD // 64), axis=1)
        own, number, sides = at[a:b], text[a:b], side[a:b]
        size = own >> 32
        names, now = np.unique(root[a:b], return_inverse=True)
        parent = list(range(len(names)))

        def find(x: int, parent: list[int] = parent) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        two = sides.min() != sides.max()
        left, right = (np.flatnonzero(sides == sides.min()), np.flatnonzero(sides == sides.max())) if two else (np.arange(b - a),) * 2
        step = max(1, _ROWS // max(1, len(right)))
        found = []
        for i in range(0, len(left), step):
            x, y = left[i : i + step, None], right[None, :]
            joined = np.array([find(r) for r in range(len(names))])[now]
            ok = _may_be(own[x], own[y]) & (joined[x] != joined[y]) & (two | (x < y))
            u, v = (z[ok] for z in np.broadcast_arrays(x, y))
            apart = np.zeros(len(u), np.int64)
            for planes in (fold, words):
                most = (size[u] + size[v]) * (WHOLE - PART) // (PART + WHOLE)
                apart = np.concatenate([np.bitwise_count(planes[u[k : k + 65536]] ^ planes[v[k : k + 65536]]).sum(axis=1, dtype=np.int64) for k in range(0, len(u), 65536)] or [np.zeros(0, np.int64)])
                u, v, apart = (z[apart <= most] for z in (u, v, apart))
            for k in np.argsort(apart, kind="stable").tolist():
                p, q = int(u[k]), int(v[k])
                one, other = find(int(now[p])), find(int(now[q]))
                if one != other:
                    both = len(np.intersect1d(sets[a + p], sets[a + q], assume_unique=True))
                    if both * (PART + WHOLE) >= PART * (size[p] + size[q]):
                        parent[other] = one
                        found.append((min(number[p], number[q]), max(number[p], number[q])))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], ["u", "v"])


def filed(texts: DataFrame, asked: DataFrame, order: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(h, n, keys) of the distinct texts asked for (h), under another order."""
    held = texts.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text", 3_000_000):
            n, keys = prefixes(batch.column(1), held.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), keys], ["h", "n", "keys"])

    return texts.select("h", "text").join(asked, "h", "left_semi").dropDuplicates(["h"]).mapInArrow(run, "h long, n int, keys array<long>")


def candidates(marked: DataFrame) -> DataFrame:
    """Rows of the first round of (h, n, keys), written."""
    rows = marked.select("h", "n", F.posexplode("keys").alias("place", "key")).select("key", (F.shiftleft(F.col("n").cast("long"), 32) + F.col("place")).alias("at"), "h")
    return written(rows.repartition("key").sortWithinPartitions("key", "at", "h").mapInArrow(_whole_buckets(_first_round), "texts array<long>, at array<long>, key long"), "candidates")


def met(found: DataFrame) -> DataFrame:
    """Pairs (u, v) of the texts that met under a key. Many keys have the same texts, which meet once, under the first of those keys: the order
    of keys is one for all texts, so it is the first in each."""
    lists = found.where("key is null").select("texts", "at").groupBy("texts").agg(F.min("at").alias("at"))
    return lists.mapInArrow(_of_lists, "u long, v long")


def similar(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those distinct pairs (u, v) whose texts in (h, text) are similar. Folded parity bitmaps turn most others away before sets are joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text", 3_000_000):
            row, h, n = shingles(batch.column(1))
            fold = np.bitwise_xor.reduce(np.concatenate([bitmaps(row[x:y] - k, h[x:y], to - k) for k, to, x, y in _runs(row, len(n))]).view(np.int64).reshape(len(n), -1, FOLD // 64), axis=1)
            fold = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * (FOLD // 64), pa.int32()), pa.array(fold.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), fold, pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(h))], ["h", "n", "fold", "own"])

    pairs = written(pairs.select("u", "v").distinct(), "pairs")
    asked = written(pairs.select(F.col("u").alias("h")).union(pairs.select("v")).distinct(), "asked")
    few = asked.count() <= SENT
    held = written(texts.join(F.broadcast(asked) if few else asked, "h", "left_semi").dropDuplicates(["h"]).mapInArrow(run, "h long, n int, fold array<long>, own array<long>"), "sets")

    def both(pairs: DataFrame, *columns: str) -> DataFrame:
        u, v = (held.select(F.col("h").alias(c), *(F.col(x).alias(f"{c}_{x}") for x in columns)) for c in "uv")
        return pairs.join(u, "u").join(v, "v")

    apart = sum((F.bit_count(F.col("u_fold")[k].bitwiseXOR(F.col("v_fold")[k])) for k in range(FOLD // 64)), F.lit(0))
    near = written(both(pairs, "n", "fold").where(apart * (PART + WHOLE) <= (F.col("u_n") + F.col("v_n")) * (WHOLE - PART)).select("u", "v"), "near")
    return both(near, "own").where(F.size(F.array_intersect("u_own", "v_own")) * (PART + WHOLE) >= PART * (F.size("u_own") + F.size("v_own"))).select("u", "v")


def large(found: DataFrame, named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (key, at, h, root) of large buckets of which some have different roots, by (h, root), written; and (key, n) of those."""
    rows = found.where("key is not null").select("key", F.col("at")[0].alias("at"), F.col("texts")[0].alias("h")).join(named, "h").select("key", "at", "h", "root")
    rows = written(rows, "large")
    counts = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("key", "n")
    counts = written(counts, "large-keys")
    return rows.join(counts.select("key"), "key", "left_semi"), counts


def still_apart(rows: DataFrame, counts: DataFrame, texts: DataFrame) -> DataFrame:
    """Similar pairs (u, v) of rows (key, at, h, root) of one key that join different roots; counts: (key, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text", 3_000_000):
            row, h, n = shingles(batch.column(1))
            bits = np.concatenate([bitmaps(row[x:y] - k, h[x:y], to - k) for k, to, x, y in _runs(row, len(n))])
            own = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(h))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in bits], pa.binary()), own], ["h", "bits", "own"])

    asked = rows.select("h").distinct()
    held = texts.select("h", "text").join(asked, "h", "left_semi").dropDuplicates(["h"]).mapInArrow(run, "h long, bits binary, own array<long>")
    # So many shares that one has about PIECE texts, and no more than VOLUME shingles.
    size = F.shiftright("at", 32)
    volume = rows.groupBy("key").agg(F.sum(size).alias("volume"))
    shares = F.greatest(F.ceil(F.col("n") / PIECE), F.ceil(F.col("volume") / VOLUME)).cast("int")
    dealt = rows.join(counts.join(volume, "key").select("key", shares.alias("shares")), "key").withColumn("share", F.pmod(F.xxhash64("h"), F.col("shares")).cast("int"))
    # A row goes to the pieces of its own share with every share; the same two shares meet in one piece.
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, shares - 1)"))).join(held, "h")
    piece = F.xxhash64("key", F.least("share", "other"), F.greatest("share", "other"))
    both = dealt.select(piece.alias("piece"), F.col("share").cast("long").alias("share"), "root", "at", "h", "bits", "own")
    return both.repartition("piece").sortWithinPartitions("piece").mapInArrow(_whole_buckets(_apart), "u long, v long")
