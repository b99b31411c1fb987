"""Interpolated modified Kneser-Ney language model over word triples.

Counting runs in Spark, in two passes over the texts. The first counts words by ranges of their hash; a range's owner stores them
as a sorted hash array, and a word's number is its place in all ranges. The second counts triples (u, v, w) of numbers: a task folds its own
and sends them to the owner of the middle word v, who therefore has all contexts (u, v) with their followers, and all pairs (v, w)
with the number of different words u before them, which is the lower order's count. A middle word with more than an owner's share of all
tokens is dealt to as many owners as it needs, by u; its pairs are then summed by owners of (v, w). Nothing is pruned.

An owner stores a trie of sorted arrays: v, under it u, under that w with counts of one byte (larger ones beside them);
and v with its w and their lower counts. Totals and numbers of followers seen once, twice, and three times or more are taken from the arrays
themselves, and stored for contexts of more than WIDE followers. Workers memory-map the arrays and look up a batch's distinct contexts side
by side. Owners and ranges are as many as the volume of the texts asks for, so each is as large whatever the input.

p(w | u v) = max(c(uvw) - D(c), 0) / c(uv) + g(uv) p(w | v); p(w | v) likewise from the numbers of different words before (v, w), and p(w)
from the number of different words before w, on top of 1 / (V + 1) for each of the V known words and one class of unknown ones.
Each order has its own three discounts, from counts of counts. A text begins with two start marks, which are only context, and ends with an end
token, which is scored. Words are told apart by XXH64.

Defined cases: null text is empty (its only token is the end); texts are whole, of any length; repeated rows count each time, rows with
null ids or texts like any other; without any training row all probabilities are 1 / (0 + 1); further columns are not read, whatever their
names; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, hashed_words, in_slices, mixed, range_of, ranges_for, shared_local_dir, written

_END = U64(0xE7037ED1A0B428DB)
FLUSH = 2_000_000  # tokens that a counting task holds
SLICE = 4_000_000  # bytes of text looked up at a time
RANGE = 12_000_000  # bytes of text for each owner
WIDE = 32  # followers from which on a context's sums are stored
_MANY = 255  # counts from here on stand beside the array


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each token, offsets): all rows' words, each row with its end, and the n + 1 bounds of rows."""
    words, rows, counts = hashed_words(column)
    bounds = np.concatenate([[0], np.cumsum(counts + 1)])
    token = np.full(int(bounds[-1]), _END)
    token[np.arange(len(words)) + rows] = words
    return token, bounds


def _before(token: np.ndarray, bounds: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The word two before each token, and the one before it; ``start`` outside the row."""
    v = np.empty_like(token)
    v[1:] = token[:-1]
    v[bounds[:-1]] = start
    u = np.empty_like(token)
    u[1:] = v[:-1]
    u[bounds[:-1]] = start
    return u, v


def _heads(*keys: np.ndarray) -> np.ndarray:
    """First places of runs of equal keys."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.ones(len(keys[0]), bool)
    new[1:] = keys[0][1:] != keys[0][:-1]
    for k in keys[1:]:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _order(small: np.ndarray, large: np.ndarray) -> np.ndarray:
    """Order by ``large``, then ``small``: one sort where both fit one number."""
    if len(small) and max(int(small.max()), int(large.max())) < 1 << 32:
        return np.argsort((large.astype(U64) << U64(32)) | small.astype(U64), kind="stable")
    return np.lexsort((small, large))


def _sums(n: np.ndarray, head: np.ndarray) -> np.ndarray:
    return np.add.reduceat(n.astype(np.int64), head) if len(head) else np.zeros(0, np.int64)


def _runs(head: np.ndarray, size: int) -> np.ndarray:
    return np.diff(np.append(head, size))


def _store(folder: str, kind: str, r: int, **arrays: np.ndarray) -> None:
    """Each array under its final name at once, so a retried or doubled task does no harm."""
    for name, x in arrays.items():
        own = f"{folder}/.{kind}-{r}-{name}-{os.getpid()}-{os.urandom(4).hex()}"
        x.tofile(own)
        os.replace(own, f"{folder}/{kind}-{r:06d}.{name}")


def _counts_of_counts(n: np.ndarray) -> list[int]:
    return [int(x) for x in np.bincount(np.minimum(n, 5), minlength=6)[1:5]]


def _packed(x: np.ndarray) -> bytes:
    """An array on its way to an owner: byte planes, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes())


def _blob(table: pa.Table, name: str, kind: type) -> np.ndarray:
    out = [np.zeros(0, kind)]
    for x in table.column(name).to_pylist():
        planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8).reshape(np.dtype(kind).itemsize, -1)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
    return np.concatenate(out)


def _dealt(owner: np.ndarray, **arrays: np.ndarray) -> tuple[list[int], dict[str, list[bytes]]]:
    """Owners in order, and each array's part for each of them; all come sorted by owner."""
    edge = _heads(owner)
    cut = [*edge.tolist(), len(owner)]
    return owner[edge].tolist(), {name: [_packed(x[a:b]) for a, b in zip(cut, cut[1:], strict=False)] for name, x in arrays.items()}


# ------------------------------------------------------------------------------------------------ words


def _count_words(ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def folded() -> tuple[np.ndarray, np.ndarray]:
            h, n = (np.concatenate([x[k] for x in held]) for k in (0, 1))
            order = np.argsort(h, kind="stable")
            head = _heads(h[order])
            return h[order][head], _sums(n[order], head)

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                h, n = folded()
                held.clear()
                keep, parts = _dealt(range_of(h, ranges), h=h, n=n)
                yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int32()), pa.array(parts["h"], pa.binary()), pa.array(parts["n"], pa.binary())], ["r", "h", "n"])

        for batch in in_slices(batches, "text", SLICE):
            token, _ = _tokens(batch.column(0))
            held.append(np.unique(token, return_counts=True))
            if len(held) > 8:
                held[:] = [folded()]
                if len(held[0][0]) > FLUSH:
                    yield from flush()
        yield from flush()

    return run


def _keep_words(folder: str):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        h, n = _blob(table, "h", U64), _blob(table, "n", np.int64)
        order = np.argsort(h, kind="stable")
        head = _heads(h[order])
        raw = _sums(n[order], head)
        _store(folder, "word", key[0].as_py(), key=h[order][head], raw=raw)
        return pa.table({"r": pa.array([key[0].as_py()], pa.int32()), "size": pa.array([len(head)], pa.int64()), "n": pa.array([int(raw.sum())], pa.int64())})

    return run


class _Arrays:
    """Memory-mapped arrays of a folder; the last MAPS of them stay mapped."""

    MAPS = 8192

    def __init__(self, folder: str) -> None:
        self.folder, self.maps = folder, {}
        with open(f"{folder}/meta.json") as f:
            self.meta = json.load(f)
        self.ranges, self.V, self.N, self.rows = (self.meta[k] for k in ("ranges", "V", "N", "rows"))
        self.number = np.dtype(self.meta["number"])
        #: The first number of each range's words.
        self.base = np.fromfile(f"{folder}/base", np.int64)
        self.start, self.unknown = self.V, self.V + 1

    def get(self, kind: str, r: int, name: str, dtype=np.int64) -> np.ndarray:
        if (kind, r, name) not in self.maps:
            if len(self.maps) >= self.MAPS:
                self.maps.pop(next(iter(self.maps)))
            path = f"{self.folder}/{kind}-{r:06d}.{name}"
            there = os.path.exists(path) and os.path.getsize(path)
            self.maps[kind, r, name] = np.memmap(path, dtype, "r") if there else np.zeros(0, dtype)
        return self.maps[kind, r, name]

    def words(self, token: np.ndarray, names: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """(number of each token, distinct numbers' place of each token, values of each distinct one): unknown words have one number."""
        words, of = np.unique(token, return_inverse=True)
        ids = np.full(len(words), self.unknown, np.int64)
        values = [np.zeros(len(words), np.int64) for _ in names]
        owner = range_of(words, self.ranges)
        edge = _heads(owner)
        for r, a, b in zip(owner[edge].tolist(), edge.tolist(), [*edge[1:].tolist(), len(words)], strict=False):
            keys = self.get("word", r, "key", U64)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, words[a:b]), len(keys) - 1)
                same = keys[at] == words[a:b]
                ids[a:b][same] = self.base[r] + at[same]
                for x, name in zip(values, names, strict=True):
                    x[a:b][same] = self.get("word", r, name)[at[same]]
        return ids[of], of, [ids, *values]

    def owner(self, v: np.ndarray, raw: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Who has v (``raw``: its count) with ``other`` beside it: one owner, or as many as its share of all tokens asks for."""
        share = self.shares(raw)
        shift = np.where(share > 1, (mixed(other.astype(U64) + U64(77)) >> U64(8)).astype(np.int64) % share, 0)
        return ((mixed(v.astype(U64)) >> U64(8)).astype(np.int64) + shift) % self.ranges

    def shares(self, raw: np.ndarray) -> np.ndarray:
        return np.maximum(-(-raw * self.ranges // max(self.N, 1)), 1)


# ------------------------------------------------------------------------------------------------ triples


@lru_cache(maxsize=2)
def _opened_words(folder: str) -> _Arrays:
    return _Arrays(folder)


def _count_triples(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _opened_words(folder)
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            p, u, v, w = (np.concatenate([x[k] for x in held]) for k in range(4))
            held.clear()
            order = _order(w, u)
            order = order[_order(v[order], p[order])]
            p, u, v, w = p[order], u[order], v[order], w[order]
            head = _heads(p, v, u, w)
            n = _runs(head, len(w)).astype(np.uint32)
            p, u, v, w = p[head], u[head], v[head], w[head]
            pair = _heads(p, v, u)
            word = _heads(p[pair], v[pair])
            keep, parts = _dealt(p, w=w.astype(known.number), n=n)
            _, pairs = _dealt(p[pair], u=u[pair].astype(known.number), u_runs=_runs(pair, len(w)).astype(np.uint32))
            _, tops = _dealt(p[pair][word], v=v[pair][word].astype(known.number), v_runs=_runs(word, len(pair)).astype(np.uint32))
            blobs = {**tops, **pairs, **parts}
            yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int32()), *(pa.array(x, pa.binary()) for x in blobs.values())], ["r", *blobs])

        for batch in in_slices(batches, "text", SLICE):
            token, bounds = _tokens(batch.column(0))
            number, of, (_, raw) = known.words(token, ("raw",))
            count = raw[of]
            u, v = _before(number, bounds, known.start)
            _, of_v = _before(count, bounds, known.rows)
            held.append((known.owner(v, of_v, u).astype(np.int32), u.astype(known.number), v.astype(known.number), number.astype(known.number)))
            if sum(len(x[0]) for x in held) > FLUSH:
                yield from flush()
        yield from flush()

    return run


_TRIPLES = "r int, v binary, v_runs binary, u binary, u_runs binary, w binary, n binary"
#: What an owner sends on: pairs of words that have several owners, counts of the words that follow, and its counts of counts.
_SENT = "kind string, r int, v binary, w binary, k binary, cc array<bigint>"


def _small(n: np.ndarray) -> dict[str, np.ndarray]:
    """Counts in a byte each, and those from _MANY on with their places."""
    at = np.flatnonzero(n >= _MANY)
    return {"": np.minimum(n, _MANY).astype(np.uint8), "_at": at.astype(np.int64), "_n": n[at].astype(np.int64)}


def _stats(n: np.ndarray, head: np.ndarray) -> list[np.ndarray]:
    """Total and numbers of ones, twos and more of each run."""
    return [_sums(n, head), _sums(n == 1, head), _sums(n == 2, head), _sums(n > 2, head)]


def _keep_pairs(known: _Arrays, folder: str, kind: str, r: int, v: np.ndarray, w: np.ndarray, k: np.ndarray) -> list[tuple]:
    """Stores sorted pairs with their lower counts; gives the rows to send on."""
    word = _heads(v)
    _store(folder, kind, r, v=v[word].astype(known.number), b=np.append(word, len(v)).astype(np.uint32), w=w.astype(known.number), **{f"k{x}": y for x, y in _small(k).items()}, stat=np.stack(_stats(k, word)).astype(np.int64).ravel())
    order = np.argsort(w, kind="stable")
    head = _heads(w[order])
    after, kinds = w[order][head], _runs(head, len(w))
    owner = np.searchsorted(known.base, after, side="right") - 1
    keep, parts = _dealt(owner, w=after.astype(np.int64), k=kinds.astype(np.int64))
    rows = [("word", x, None, a, b, None) for x, a, b in zip(keep, parts["w"], parts["k"], strict=True)]
    return rows


def _table(rows: list[tuple]) -> pa.Table:
    types = [pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
    return pa.Table.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate(types)], [x.split()[0] for x in _SENT.split(", ")])


def _merge_triples(folder: str):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        known, r = _opened_words(folder), key[0].as_py()
        u_runs, w, n = _blob(table, "u_runs", np.uint32), _blob(table, "w", known.number), _blob(table, "n", np.uint32)
        u = np.repeat(_blob(table, "u", known.number), u_runs)
        v = np.repeat(np.repeat(_blob(table, "v", known.number), _blob(table, "v_runs", np.uint32)), u_runs)
        del table, u_runs
        order = np.argsort(w, kind="stable")
        order = order[_order(u[order], v[order])]
        u, v, w, n = u[order], v[order], w[order], n[order]
        head = _heads(v, u, w)
        u, v, w, n = u[head], v[head], w[head], _sums(n, head)
        pair = _heads(v, u)
        word = _heads(v[pair])
        # Totals of wide contexts, by the pair's place.
        wide = np.flatnonzero(_runs(pair, len(w)) > WIDE)
        _store(folder, "triple", r, v=v[pair][word], vb=np.append(word, len(pair)).astype(np.uint32), u=u[pair], ub=np.append(pair, len(w)).astype(np.uint32), w=w, **{f"n{x}": y for x, y in _small(n).items()}, wide=wide.astype(np.int64), stat=np.stack(_stats(n, pair))[:, wide].ravel())
        cc = _counts_of_counts(n)
        # Lower counts: the different u of each (v, w).
        order = _order(w, v)
        v, w = v[order], w[order]
        head = _heads(v, w)
        v, w, k = v[head], w[head], _runs(head, len(w))
        words, of = np.unique(v, return_inverse=True)
        raw = np.full(len(words), known.rows, np.int64)
        at = np.searchsorted(known.base, words, side="right") - 1
        for x in range(len(words)):
            if words[x] != known.start:
                raw[x] = known.get("word", int(at[x]), "raw")[words[x] - known.base[at[x]]]
        shared = (known.shares(raw) > 1)[of]
        rows = [("cc", 0, None, None, None, cc)]
        if shared.any():
            a, b, c = v[shared], w[shared], k[shared]
            owner = known.owner(a, raw[of][shared], b)
            order = np.argsort(owner, kind="stable")
            keep, parts = _dealt(owner[order], v=a[order], w=b[order], k=c[order].astype(np.uint32))
            rows += [("pair", x, p, q, s, None) for x, p, q, s in zip(keep, parts["v"], parts["w"], parts["k"], strict=True)]
        own = ~shared
        rows += _keep_pairs(known, folder, "pair", r, v[own], w[own], k[own])
        return _table([*rows, ("cc2", 0, None, None, None, _counts_of_counts(k[own]))])

    return run


def _merge_shared(folder: str):
    """Sums the pairs of words that have several owners; their totals go on to the word's first owner."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        known, r = _opened_words(folder), key[0].as_py()
        v, w, k = _blob(table, "v", known.number), _blob(table, "w", known.number), _blob(table, "k", np.uint32)
        order = _order(w, v)
        v, w, k = v[order], w[order], k[order]
        head = _heads(v, w)
        v, w, k = v[head], w[head], _sums(k, head)
        rows = _keep_pairs(known, folder, "shared", r, v, w, k)
        word = _heads(v)
        stat = _stats(k, word)
        rows += [("total", 0, x.astype(np.int64).tobytes(), None, np.array(s, np.int64).tobytes(), None) for x, *s in zip(v[word], *stat, strict=True)]
        return _table([*rows, ("cc2", 0, None, None, None, _counts_of_counts(k))])

    return run


def _keep_kinds(folder: str):
    """Stores, beside a range's words, the number of different words before each."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        known, r = _opened_words(folder), key[0].as_py()
        kinds = np.zeros(len(known.get("word", r, "key", U64)), np.int64)
        np.add.at(kinds, _blob(table, "w", np.int64) - known.base[r], _blob(table, "k", np.int64))
        _store(folder, "word", r, kinds=kinds)
        return pa.table({"facts": pa.array([[int(kinds.sum()), int((kinds > 2).sum()), *_counts_of_counts(kinds)]], pa.list_(pa.int64()))})

    return run


def discounts(cc: list[int]) -> tuple[float, float, float]:
    """For counts of one, two, and three or more, from the numbers of entries counted 1 to 4 times."""
    n1, n2, n3, n4 = cc
    if not (n1 and n2 and n3):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    raw = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
    return tuple(min(max(x, 0.05), k - 0.05) for k, x in enumerate(raw, 1))


def train(texts: DataFrame, text_col: str = "text", ranges: int | None = None) -> str:
    """Folder of the model of all rows of ``texts``."""
    spark = texts.sparkSession
    chosen = texts.select(F.col(text_col).cast("string").alias("text"))
    ranges = ranges or ranges_for(chosen, "text", RANGE, spark.sparkContext.defaultParallelism)
    folder = shared_local_dir(spark, "lm")
    counted = chosen.mapInArrow(_count_words(ranges), "r int, h binary, n binary").repartition(ranges, "r").groupBy("r")
    sizes = counted.applyInArrow(_keep_words(folder), "r int, size long, n long").collect()  # three numbers for each owner
    size = np.zeros(ranges, np.int64)
    for x in sizes:
        size[x["r"]] = x["size"]
    (np.cumsum(size) - size).tofile(f"{folder}/base")
    V = int(size.sum())
    meta = {"ranges": ranges, "V": V, "N": sum(x["n"] for x in sizes), "rows": chosen.count(), "number": "uint32" if V < 2**32 - 2 else "uint64"}
    _write_meta(folder, meta)
    sent = written(chosen.mapInArrow(_count_triples(folder), _TRIPLES).repartition(ranges, "r").groupBy("r").applyInArrow(_merge_triples(folder), _SENT), "lm-sent")
    shared = written(sent.where("kind = 'pair'").repartition(ranges, "r").groupBy("r").applyInArrow(_merge_shared(folder), _SENT), "lm-shared")
    both = sent.unionByName(shared)
    # One row for each owner of a word that has several; there are at most two for each owner.
    totals: dict[int, np.ndarray] = {}
    for x in shared.where("kind = 'total'").select("v", "k").toLocalIterator():
        word = int(np.frombuffer(x["v"], np.int64)[0])
        totals[word] = totals.get(word, 0) + np.frombuffer(x["k"], np.int64)
    words = sorted(totals)
    _store(folder, "total", 0, v=np.array(words, np.int64), stat=np.stack([totals[x] for x in words], axis=1).ravel() if words else np.zeros(0, np.int64))
    facts = both.where("kind = 'word'").repartition(ranges, "r").groupBy("r").applyInArrow(_keep_kinds(folder), "facts array<bigint>")
    row = facts.agg(*[F.coalesce(F.sum(F.col("facts")[k]), F.lit(0)) for k in range(6)]).first()
    cc = {x["kind"]: list(x)[1:] for x in both.where("cc is not null").groupBy("kind").agg(*[F.sum(F.col("cc")[k]) for k in range(4)]).collect()}
    d1 = discounts(row[2:6])
    meta |= {"kinds": row[0], "d3": discounts(cc.get("cc", [0] * 4)), "d2": discounts(cc.get("cc2", [0] * 4)), "d1": d1}
    meta["rest"] = (d1[0] * row[2] + d1[1] * row[3] + d1[2] * row[1]) / row[0] if row[0] else 1.0
    _write_meta(folder, meta, "model.json")
    return folder


def _write_meta(folder: str, meta: dict, name: str = "meta.json") -> None:
    with open(f"{folder}/.{name}", "w") as f:
        json.dump(meta, f)
    os.replace(f"{folder}/.{name}", f"{folder}/{name}")


def _within(values: np.ndarray, low: np.ndarray, high: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted value in the sorted values[low:high], or -1: a binary search for all side by side."""
    a, b = low.astype(np.int64), high.astype(np.int64)
    end = b.copy()
    todo = np.flatnonzero(a < b)
    while len(todo):
        mid = (a[todo] + b[todo]) >> 1
        less = values[mid] < wanted[todo]
        a[todo[less]] = mid[less] + 1
        b[todo[~less]] = mid[~less]
        todo = todo[a[todo] < b[todo]]
    found = np.flatnonzero(a < end)
    out = np.full(len(wanted), -1, np.int64)
    same = found[values[a[found]] == wanted[found]] if len(found) else found
    out[same] = a[same]
    return out


class Model(_Arrays):
    def __init__(self, folder: str) -> None:
        super().__init__(folder)
        with open(f"{folder}/model.json") as f:
            self.meta = json.load(f)
        self.discount = {k: np.array([0.0, *self.meta[k]]) for k in ("d1", "d2", "d3")}

    def _counts(self, kind: str, r: int, name: str, at: np.ndarray) -> np.ndarray:
        n = self.get(kind, r, name, np.uint8)[at].astype(np.int64)
        many = np.flatnonzero(n == _MANY)
        if len(many):
            n[many] = self.get(kind, r, f"{name}_n")[np.searchsorted(self.get(kind, r, f"{name}_at"), at[many])]
        return n

    def _words_of(self, kind: str, r: int, bound: str, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of each v in an owner's list, or -1, and the bounds of what is under it."""
        have, bounds = self.get(kind, r, "v", self.number), self.get(kind, r, bound, np.uint32)
        if not len(have):
            z = np.zeros(len(v), np.int64)
            return z - 1, z, z
        at = np.minimum(np.searchsorted(have, v), len(have) - 1)
        ok = have[at] == v
        return np.where(ok, at, -1), np.where(ok, bounds[at], 0).astype(np.int64), np.where(ok, bounds[at + 1], 0).astype(np.int64)

    @staticmethod
    def _weight(d: np.ndarray, stat: np.ndarray) -> np.ndarray:
        """What a context leaves to the lower order; all of it if it is unknown."""
        return np.where(stat[0] > 0, (d[1] * stat[1] + d[2] * stat[2] + d[3] * stat[3]) / np.maximum(stat[0], 1), 1.0)

    def _each_owner(self, owner: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        order = np.argsort(owner, kind="stable")
        edge = _heads(owner[order])
        for r, a, b in zip(owner[order][edge].tolist(), edge.tolist(), [*edge[1:].tolist(), len(order)], strict=False):
            yield r, order[a:b]

    def _lower(self, v: np.ndarray, raw: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For distinct pairs (v, w): the lower count of the pair, and the sums (4, n) of v."""
        k, stat = np.zeros(len(v), np.int64), np.zeros((4, len(v)), np.int64)
        shared = self.shares(raw) > 1
        for r, x in self._each_owner(np.where(v == self.unknown, -1, self.owner(v, raw, w))):
            if r < 0:
                continue
            for kind, own in (("pair", x[~shared[x]]), ("shared", x[shared[x]])):
                if not len(own):
                    continue
                at, low, high = self._words_of(kind, r, "b", v[own])
                place = _within(self.get(kind, r, "w", self.number), low, high, w[own])
                found = place >= 0
                k[own[found]] = self._counts(kind, r, "k", place[found])
                if kind == "pair":
                    table = self.get(kind, r, "stat").reshape(4, -1)
                    stat[:, own[at >= 0]] = table[:, at[at >= 0]]
        several = np.flatnonzero(shared)
        have = self.get("total", 0, "v")
        if len(several) and len(have):
            at = np.minimum(np.searchsorted(have, v[several]), len(have) - 1)
            ok = have[at] == v[several]
            stat[:, several[ok]] = self.get("total", 0, "stat").reshape(4, -1)[:, at[ok]]
        return k, stat

    def _upper(self, v: np.ndarray, raw: np.ndarray, u: np.ndarray, first: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For distinct contexts (u, v), whose tokens w are those from first[i] to before first[i + 1]: each token's count, and the sums (4, n)."""
        n, stat = np.zeros(len(w), np.int64), np.zeros((4, len(v)), np.int64)
        for r, x in self._each_owner(np.where((v == self.unknown) | (u == self.unknown), -1, self.owner(v, raw, u))):
            if r < 0:
                continue
            _, low, high = self._words_of("triple", r, "vb", v[x])
            at = _within(self.get("triple", r, "u", self.number), low, high, u[x])
            x, at = x[at >= 0], at[at >= 0]
            if not len(x):
                continue
            bounds = self.get("triple", r, "ub", np.uint32)
            low, high = bounds[at].astype(np.int64), bounds[at + 1].astype(np.int64)
            size = high - low
            narrow = np.flatnonzero(size <= WIDE)
            s = size[narrow]
            head = np.cumsum(s) - s
            followers = self._counts("triple", r, "n", np.repeat(low[narrow] - head, s) + np.arange(int(s.sum())))
            stat[:, x[narrow]] = _stats(followers, head)
            wide = np.flatnonzero(size > WIDE)
            if len(wide):
                place = np.searchsorted(self.get("triple", r, "wide"), at[wide])
                stat[:, x[wide]] = self.get("triple", r, "stat").reshape(4, -1)[:, place]
            m = first[x + 1] - first[x]
            token = np.repeat(first[x] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
            place = _within(self.get("triple", r, "w", self.number), np.repeat(low, m), np.repeat(high, m), w[token])
            found = place >= 0
            n[token[found]] = self._counts("triple", r, "n", place[found])
        return n, stat

    def score(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Tokens, known tokens, base score and score (log10) of each row."""
        m = self.meta
        token, bounds = _tokens(column)
        if not len(token):
            z = np.zeros(0)
            return z.astype(np.int64), z.astype(np.int64), z, z
        w, of, (_, raw, kinds) = self.words(token, ("raw", "kinds"))
        base = np.log10((raw + 1) / (m["N"] + m["V"] + 1))[of]
        known = (raw > 0)[of]
        d1, d2, d3 = (self.discount[k] for k in ("d1", "d2", "d3"))
        single = (np.maximum(kinds - d1[np.minimum(kinds, 3)], 0) / m["kinds"] if m["kinds"] else np.zeros(len(raw))) + m["rest"] / (m["V"] + 1)
        single, raw = single[of], raw[of]
        u, v = _before(w, bounds, self.start)
        _, raw_v = _before(raw, bounds, self.rows)
        # Pairs (v, w).
        order = _order(w, v)
        head = _heads(v[order], w[order])
        k, stat = self._lower(v[order][head], raw_v[order][head], w[order][head])
        left = self._weight(d2, stat)
        share = np.maximum(k - d2[np.minimum(k, 3)], 0) / np.maximum(stat[0], 1)
        runs = _runs(head, len(order))
        p = np.empty(len(token))
        p[order] = np.repeat(share, runs) + np.repeat(left, runs) * single[order]
        # Contexts (u, v).
        order = _order(u, v)
        head = _heads(v[order], u[order])
        n, stat = self._upper(v[order][head], raw_v[order][head], u[order][head], np.append(head, len(order)), w[order])
        runs = _runs(head, len(order))
        left, total = np.repeat(self._weight(d3, stat), runs), np.repeat(np.maximum(stat[0], 1), runs)
        p[order] = np.maximum(n - d3[np.minimum(n, 3)], 0) / total + left * p[order]
        at = bounds[:-1]
        return np.diff(bounds), np.add.reduceat(known.astype(np.int64), at), np.add.reduceat(base, at), np.add.reduceat(np.log10(p), at)


@lru_cache(maxsize=2)
def opened(folder: str) -> Model:
    return Model(folder)


def scored(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = opened(folder)
        for batch in in_slices(batches, "text", SLICE):
            n, known, base, score = model.score(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(known), pa.array(np.full(len(n), model.meta["N"])), pa.array(base), pa.array(score), pa.array(10 ** np.minimum(-score / n, 300))], ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
