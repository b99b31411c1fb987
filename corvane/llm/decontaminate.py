"""Benchmark decontamination by spaced seeds.

Fixed masks over up to SPAN words select the positions whose words are hashed; the ignored positions may differ. The hashes of
test items are joined with those of every position of every training text, and each hit is verified: on the hit's
diagonal the words of item and text are compared and the best stretch around the hit is kept. One rule holds for items of every
length: a text is contaminated if some stretch has at least MIN_WORDS words (the item's length if that is less) of which at
least MIN_SHARE are equal. Items of fewer than SPAN words have their own masks: they are cut into one piece more than may be
substituted words, so one piece is whole.

Runs of equal seeds (one word over and over) meet by their heads alone, and hits are folded to diagonals a bounded number at a
time, so a text has at most one entry for each of its own and an item's words in memory, however often it repeats itself.

Test sets are small beside a corpus: their sorted hashes are broadcast, and the size is checked (MAX_SENT entries);
beyond it the test set is split and the corpus is scanned once for each part, so nothing is dropped.

Words are runs of letters and digits (any byte over 0x7F counts as a letter), lower-cased for A-Z and Latin-1 letters, told
apart by XXH64.

Defined cases: null and empty texts are clean, and items without words match nothing; an item of one word contaminates every text that
has that word (``shortest`` leaves out items of fewer words; it is 1 unless set); repeated items and rows count one by one, null
ids stay null; of equal overlaps the smaller item_id is shown; further columns are not read; an empty table of either kind gives clean
texts or an empty result; texts are read whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, in_slices, mixed, text_buffer, xx64

#: Positions that count: of 12 words or more with any fifth of them substituted, one of the masks has a place with all its seven words whole.
MASKS = ("11101111", "1111010011", "110100101011", "110011001011", "101000111011", "1101110101", "1111100011")
SPAN = 12
MIN_WORDS = 13
MIN_SHARE = 0.8
#: Items of fewer words are left out: none.
SHORTEST = 1
MAX_SENT = 2_000_000
_HITS = 1 << 20  # hits folded to diagonals at a time

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[:128] = [not chr(c).isalnum() for c in range(128)]
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the offset of each row's first word (n + 1 values)."""
    data, offsets = text_buffer(column)
    if not len(data):
        return np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    folded = _FOLD[data]
    latin = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    folded[latin] += 32
    letter = ~_SEPARATOR[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.concatenate([[False], letter[:-1]])
    starts = np.flatnonzero(letter & (~before | first[:-1]))
    after = np.concatenate([letter[1:], [False]])
    ends = np.flatnonzero(letter & (~after | first[1:])) + 1
    return xx64(folded, starts, ends, 3), np.searchsorted(starts, offsets)


def seeds(h: np.ndarray, mask: str, number: int) -> np.ndarray:
    """The mask's hash at each position that has room for it (positions across rows included)."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, U64)
    total = np.full(n, number, U64)
    for k, used in enumerate(mask):
        if used == "1":
            total += h[k : k + n] * U64((2 * k + 3) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF | 1)
    return mixed(total)


class Items:
    """The sorted seed hashes of a test set, and its words for verification."""

    def __init__(self, ids: list[int], texts: pa.Array, shortest: int = SHORTEST) -> None:
        self.ids = ids
        self.h, self.at = words(texts)
        size = np.diff(self.at)
        self.item = np.repeat(np.arange(len(size)), size)
        room = self.at[1:][self.item] - np.arange(len(self.h)) if len(self.h) else np.zeros(0, np.int64)
        found, places, heads = [np.zeros(0, U64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
        for k, mask in enumerate(MASKS):
            s = seeds(self.h, mask, k)
            ok = np.flatnonzero(room[: len(s)] >= len(mask))
            ok = ok[size[self.item[ok]] >= SPAN]
            found.append(s[ok])
            places.append(ok)
            again = np.zeros(len(s), bool)
            again[1:] = (s[1:] == s[:-1]) & (np.diff(self.item[: len(s)]) == 0)
            heads.append(~again[ok])
        self.short = set()
        for i in np.flatnonzero((size >= max(1, shortest)) & (size < SPAN)):
            for piece in np.array_split(np.arange(self.at[i], self.at[i + 1]), int(size[i] * (1 - MIN_SHARE) + 1e-9) + 1):
                found.append(seeds(self.h[piece], "1" * len(piece), 100 + len(piece)))
                places.append(piece[:1])
                heads.append(np.ones(1, bool))
                self.short.add(len(piece))
        h, place, head = np.concatenate(found), np.concatenate(places), np.concatenate(heads)
        order = np.argsort(h, kind="stable")
        self.every = h[order], place[order]
        first = order[head[order]]
        self.heads = h[first], place[first]

    def hits(self, h: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(position in the texts, position in the items) of seed hits, up to about _HITS at a time. Of a run of hits on one
        diagonal that repeat one seed only the first is given."""
        if not len(self.every[0]):
            return
        row_head = np.zeros(len(h) + 1, bool)
        row_head[at] = True
        for mask, number in [*((m, k) for k, m in enumerate(MASKS)), *(("1" * n, 100 + n) for n in sorted(self.short))]:
            s = seeds(h, mask, number)
            if not len(s):
                continue
            p = np.flatnonzero(_lookup(self.every[0], s) >= 0)
            again = np.zeros(len(p), bool)
            inner = p > 0
            again[inner] = (s[p[inner]] == s[p[inner] - 1]) & ~row_head[p[inner]]
            if number >= 100:  # pieces of short items stand alone: each hit counts
                again[:] = False
            for which, (keys, places) in ((p[~again], self.every), (p[again], self.heads)):
                a, b = (np.searchsorted(keys, s[which], side=side) for side in ("left", "right"))
                cut = np.cumsum(b - a)
                i = 0
                while i < len(which):
                    to = max(i + 1, int(np.searchsorted(cut, (cut[i - 1] if i else 0) + _HITS, side="right")))
                    n = (b - a)[i:to]
                    yield np.repeat(which[i:to], n), places[np.repeat(a[i:to], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]
                    i = to


def _lookup(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Index of each wanted value's first place in sorted keys, else -1. A bitmap of 2**22 bits turns most away."""
    bitmap = np.zeros(1 << 22, bool)
    bitmap[(keys >> U64(42)).astype(np.int64)] = True
    out = np.full(len(wanted), -1, np.int64)
    maybe = np.flatnonzero(bitmap[(wanted >> U64(42)).astype(np.int64)])
    at = np.minimum(np.searchsorted(keys, wanted[maybe]), len(keys) - 1)
    same = keys[at] == wanted[maybe]
    out[maybe[same]] = at[same]
    return out


def overlaps(items: Items, h: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """Verified (row, item, first word in the row, words, equal words): the best stretch of each item in each row."""
    found = np.zeros(0, np.int64)
    rows, reach = np.int64(len(at)), np.int64(len(h) + len(items.h) + 1)  # a diagonal as one number: (item, row, start)
    for pos, place in items.hits(h, at):
        row = np.searchsorted(at, pos, side="right") - 1
        item = items.item[place]
        start = pos - (place - items.at[item])  # where the item's first word would stand
        may = _may_be_whole(items, h, at, row, item, start)
        found = np.union1d(found, (item[may] * rows + row[may]) * reach + start[may] + len(items.h))
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    own, start = np.divmod(found, reach)
    for r, i, s in zip((own % rows).tolist(), (own // rows).tolist(), (start - len(items.h)).tolist(), strict=True):
        size = int(items.at[i + 1] - items.at[i])
        have = best.get((r, i), (0, 0, 0))
        if have[1] == size:  # none is longer
            continue
        a, b = max(s, int(at[r])), min(s + size, int(at[r + 1]))
        if b - a <= have[1]:
            continue
        off = int(items.at[i]) - s
        n, x, same = _stretch(h[a:b] == items.h[a + off : b + off], min(MIN_WORDS, size), MIN_SHARE)
        if n and n > have[1]:
            best[r, i] = (a + x - int(at[r]), n, same)
    return [(r, i, *found) for (r, i), found in best.items()]


def _may_be_whole(items: Items, h: np.ndarray, at: np.ndarray, row: np.ndarray, item: np.ndarray, start: np.ndarray) -> np.ndarray:
    """False for hits of items of fewer than SPAN words that can't meet the rule: these must stand in the row as a whole."""
    size = items.at[item + 1] - items.at[item]
    ok = (size >= SPAN) | ((start >= at[row]) & (start + size <= at[row + 1]))
    short = np.flatnonzero(ok & (size < SPAN))
    same = np.zeros(len(short), np.int64)
    for k in range(SPAN):
        inside = np.flatnonzero(k < size[short])
        same[inside] += h[start[short[inside]] + k] == items.h[items.at[item[short[inside]]] + k]
    ok[short] = same >= MIN_SHARE * size[short] - 1e-9
    return ok


def _stretch(equal: np.ndarray, need: int, share: float) -> tuple[int, int, int]:
    """Length, start and equal words of the longest stretch of at least ``need`` words with at least the share equal."""
    n = len(equal)
    if n < need:
        return 0, 0, 0
    # A stretch [a, b) has the share if score[b] >= score[a]; for the longest, a is a new low and b a high from the right.
    score = np.concatenate([[0.0], np.cumsum(np.where(equal, 1 - share, -share))]) + 1e-9 * np.arange(n + 1)
    low = np.minimum.accumulate(score)
    high = np.maximum.accumulate(score[::-1])[::-1]
    first = np.searchsorted(-low, -high, side="left")  # the first a whose low is at most the high from b on
    length = np.arange(n + 1) - first
    b = int(np.argmax(np.where(score >= score[np.minimum(first, n)], length, -1)))
    a = int(first[b])
    return (b - a, a, int(equal[a:b].sum())) if b - a >= need else (0, 0, 0)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """One row for each document: doc_id, contaminated, n_items, item_id (of the longest overlap, then smallest; null if
    none), start_word, n_words, n_equal of that overlap. The parts of a test set are tried in turn as rows pass by."""
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = chosen.select("doc_id", "text", F.lit(0).alias("n_items"), F.lit(None).cast("long").alias("item_id"), *[F.lit(None).cast("int").alias(c) for c in ("start_word", "n_words", "n_equal")])
    for items in _held(docs.sparkSession, benchmark, item_col, item_text, shortest):
        found = found.mapInArrow(_scan(items), found.schema)
    return found.select("doc_id", (F.col("n_items") > 0).alias("contaminated"), "n_items", "item_id", "start_word", "n_words", "n_equal")


def _held(spark: SparkSession, benchmark: DataFrame, item_col: str = "item_id", item_text: str = "text", shortest: int = SHORTEST) -> Iterator[Broadcast]:
    """A test set's ids and texts, broadcast in parts of about MAX_SENT seeds: one for all but very large sets."""
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("t"))
    n_words = items.agg(F.coalesce(F.sum(F.size(F.split("t", r"[^0-9A-Za-z\x{80}-\x{10FFFF}]+"))), F.lit(0))).first()[0]
    parts = max(1, -(-int(n_words) * len(MASKS) // MAX_SENT))
    for part in range(parts):
        held = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == part).orderBy("i", "t").toArrow()
        yield spark.sparkContext.broadcast((uuid.uuid4().hex, held.column("i").to_pylist(), held.column("t").to_pylist(), shortest))


_OPENED: dict[str, Items] = {}


def _opened(sent: Broadcast) -> Items:
    """The items of a broadcast, built once in a worker; the last one built is kept."""
    name, ids, texts, shortest = sent.value
    if name not in _OPENED:
        _OPENED.clear()
        _OPENED[name] = Items(ids, pa.array(texts, pa.string()), shortest)
    return _OPENED[name]


def _rank(size: int, item: int | None, start: int, same: int) -> tuple:
    return size, -(2**63) if item is None else -item, item, start, same


def _scan(sent: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _opened(sent)
        for batch in in_slices(batches, "text", 2_000_000):
            h, at = words(batch.column(1))
            count = batch.column(2).to_numpy().copy()
            known = list(zip(*(batch.column(k).to_pylist() for k in (5, 3, 4, 6)), strict=True))
            best = [None if n is None else _rank(n, i, start, same) for n, i, start, same in known]
            for r, i, start, size, same in overlaps(items, h, at):
                count[r] += 1
                rank = _rank(size, items.ids[i], start, same)
                if best[r] is None or rank[:2] > best[r][:2]:
                    best[r] = rank
            pick = lambda k, kind: pa.array([None if b is None else b[k] for b in best], kind)
            columns = [batch.column(0), batch.column(1), pa.array(count, pa.int32()), pick(2, pa.int64()), pick(3, pa.int32()), pick(0, pa.int32()), pick(4, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "n_items", "item_id", "start_word", "n_words", "n_equal"])

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """The rows of ``docs`` without an overlap, in one scan for each part of the test set, with all their columns."""
    for items in _held(docs.sparkSession, benchmark, shortest=shortest):
        docs = docs.mapInArrow(_clean(items, text_col), docs.schema)
    return docs


def _clean(sent: Broadcast, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _opened(sent)
        for batch in in_slices(batches, text_col, 2_000_000):
            h, at = words(batch.column(batch.schema.get_field_index(text_col)))
            clean = np.ones(batch.num_rows, bool)
            clean[[r for r, *_ in overlaps(items, h, at)]] = False
            yield batch.filter(pa.array(clean))

    return run
