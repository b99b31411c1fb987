"""Removal of repeated 100-byte strings by bucket-pointer refinement.

Sorting all suffixes of a corpus to depth 100 would move every byte many times, so suffixes are first brought together by
content. Every 100-byte window has an anchor, its leftmost 40-gram of least hash; equal windows have equal anchors at equal
places. Neighbouring windows with one anchor form a stretch. Three passes:

1. anchor hashes that occur twice or more are found by ranges of the hash and kept as sorted arrays in the shared folder, with a
   mark on those whose stretches differ;
2. stretches of those anchors (workers memory-map the arrays) are folded within a task: of identical stretches only the first is
   sent on, with its text if the anchor is marked; the others are whole repeats already;
3. stretches meet by anchor. Later copies of a stretch are repeats; the texts of different stretches are refined: q-grams of 8
   bytes give the initial buckets, and a bucket is refined by sorting on the bucket pointers of a later offset (8, 16, 32, then
   36 on top of 64), with pointers updated in place and reused by the next step, down to classes of equal 100-byte strings.

Repeated spans are stored by ranges of a document hash; the last scan of the texts looks its own rows' spans up there, so no
text is shuffled. Identical stretches are told by two independent hashes of 64 bits, the anchor's and the XXH64 of all their
bytes. Arrays and spans are kept in ranges of their keys, and the number of ranges follows the volume of the texts.

The bucket of an anchor with more than HOT stretches (a short common phrase in many contexts) is refined before it is gathered: its
stretches are cut in two by the anchor's place, and all windows of a half share more bytes beside the anchor, which are the bucket
identifier of a later offset. Halves that meet in it form the new buckets; those that are still hot are cut again, down to
single places, where the identifier is the whole window. So buckets are compared as any others are, and in the last ones, whose windows are
all alike, the first is found by aggregation over their bytes.

Order is (doc_id, text hash, start). Defined cases: null text is empty; texts under 100 bytes lose nothing; rows that repeat both doc_id
and text are one document and get equal results; rows that repeat only doc_id are ordered by text hash; long texts are cut
into overlapping parts for scanning, which changes no result; further columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, in_slices, mixed, powers, prefix_hash, range_of, ranges_for, shared_local_dir, text_buffer, written, xx64

LENGTH = 100
GRAM = 40
_W = LENGTH - GRAM + 1
#: Bytes scanned at a time: a position fits 24 bits of a key.
PART = 1_000_000
HOT = 20_000
FLUSH = 1_000_000  # anchors that a task holds
KEPT = 300_000  # stretches that a task holds, those with a text counting thrice
MEET = 1_000_000  # bytes of stretches compared at a time


class Stretches:
    """Anchors of a text column: arrays over stretches in order of position."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, rows: np.ndarray, bases: np.ndarray) -> None:
        """``offsets`` bound parts of rows in ``data``; part i is of row rows[i] and begins at its byte bases[i]."""
        n = len(data)
        self.data, self.prefix = data, prefix_hash(data, 5)
        empty = np.zeros(0, np.int64)
        self.anchor = np.zeros(0, U64)
        self.row = self.first = self.count = self.place = self.start = empty
        if n < LENGTH:
            return
        grams = mixed((self.prefix[GRAM:] - self.prefix[:-GRAM]) * powers("down", n + 1)[: n - GRAM + 1])
        keys = (grams & U64(0xFFFFFFFFFF000000)) | np.arange(len(grams), dtype=U64)
        m = n - LENGTH + 1
        rows_of = -(-len(keys) // _W)
        padded = np.full(rows_of * _W, U64(0xFFFFFFFFFFFFFFFF))
        padded[: len(keys)] = keys
        grid = padded.reshape(rows_of, _W)
        ahead = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        behind = np.minimum.accumulate(grid, axis=1).reshape(-1)
        at = (np.minimum(ahead[:m], behind[_W - 1 : _W - 1 + m]) & U64(0xFFFFFF)).astype(np.int64)
        size = np.diff(offsets)
        inside = np.zeros(n + 1, np.int32)
        long = size >= LENGTH
        np.add.at(inside, offsets[:-1][long], 1)
        np.add.at(inside, offsets[1:][long] - LENGTH + 1, -1)
        ok = np.cumsum(inside)[:m] > 0
        change = np.ones(m, bool)
        change[1:] = (at[1:] != at[:-1]) | (ok[1:] != ok[:-1])
        begin = np.flatnonzero(change)
        count = np.diff(np.append(begin, m))
        begin, count = begin[ok[begin]], count[ok[begin]]
        self.first, self.count = begin, count
        self.place = at[begin] - begin
        # Least hashes are small ones; mixed once more they fill all ranges alike.
        self.anchor = mixed(grams[at[begin]] ^ U64(0x5851F42D4C957F2D))
        part = np.searchsorted(offsets, begin, side="right") - 1
        self.row = rows[part]
        self.start = begin - offsets[part] + bases[part]

    def content(self) -> np.ndarray:
        """A hash of each stretch's bytes, anchor place and size."""
        return _content(self.data, self.first, self.first + self.count + LENGTH - 1, self.place)


def _content(data: np.ndarray, begin: np.ndarray, end: np.ndarray, place: np.ndarray) -> np.ndarray:
    return mixed(xx64(data, begin, end, 11) + place.astype(U64))


def _parts(batch: pa.RecordBatch, text: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The batch's text in parts of at most PART bytes; neighbouring parts of a text share LENGTH - 1 bytes."""
    data, offsets = text_buffer(batch.column(batch.schema.get_field_index(text)))
    if len(data) <= PART:
        yield data, offsets, np.arange(len(offsets) - 1), np.zeros(len(offsets) - 1, np.int64)
        return
    for row in range(len(offsets) - 1):
        own = data[offsets[row] : offsets[row + 1]]
        for base in range(0, max(1, len(own) - LENGTH + 1), PART - LENGTH + 1):
            cut = own[base : base + PART]
            yield cut, np.array([0, len(cut)]), np.array([row]), np.array([base])


def _heads(*keys: np.ndarray) -> np.ndarray:
    """Whether each place of sorted keys differs from the one before."""
    head = np.ones(len(keys[0]), bool)
    head[1:] = keys[0][1:] != keys[0][:-1]
    for k in keys[1:]:
        head[1:] |= k[1:] != k[:-1]
    return head


def _count_anchors(ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if not sum(len(x[0]) for x in held):
                return
            h, v = (np.concatenate([x[k] for x in held]) for k in (0, 1))
            held.clear()
            order = np.lexsort((v, h))
            h, v = h[order], v[order]
            at = np.flatnonzero(_heads(h, v))
            many = np.diff(np.append(at, len(h))) > 1
            h, v = h[at], v[at]
            keep, edge = np.unique(range_of(h, ranges), return_index=True)
            cut = [*edge.tolist(), len(h)]
            blobs = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int32()), blobs(h), blobs(v), blobs(many)], ["r", "h", "v", "many"])

        for batch in in_slices(batches, "text", PART):
            for part in _parts(batch, "text"):
                found = Stretches(*part)
                held.append((found.anchor, found.content()))
            if sum(len(x[0]) for x in held) > FLUSH:
                yield from flush()
        yield from flush()

    return run


def _store(folder: str, r: int, **arrays: np.ndarray) -> None:
    """Each array under its final name at once: a retried or doubled task writes the same file again."""
    for name, x in arrays.items():
        own = f"{folder}/.{r}-{name}-{os.getpid()}-{os.urandom(4).hex()}"
        x.tofile(own)
        os.replace(own, f"{folder}/{r:06d}.{name}")


def _keep_repeated(folder: str):
    """Stores the range's repeated anchors, and whether their stretches differ."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        r = key[0].as_py()
        h, v, many = (np.concatenate([np.frombuffer(x, kind) for x in table.column(name).to_pylist()]) for name, kind in (("h", U64), ("v", U64), ("many", bool)))
        order = np.lexsort((v, h))
        h, v, many = h[order], v[order], many[order]
        at = np.flatnonzero(_heads(h))
        repeated = (np.diff(np.append(at, len(h))) > 1) | np.logical_or.reduceat(many, at)
        kinds = np.add.reduceat(_heads(h, v).astype(np.int64), at)
        _store(folder, r, key=h[at][repeated], differ=(kinds > 1)[repeated])
        return pa.table({"r": pa.array([r], pa.int32()), "n": pa.array([int(repeated.sum())], pa.int64())})

    return run


class Ranges:
    """Memory-mapped arrays by range; the last MAPS of them stay mapped."""

    MAPS = 4096

    def __init__(self, folder: str, ranges: int, **kinds: type) -> None:
        self.folder, self.ranges, self.kinds, self.maps = folder, ranges, kinds, {}

    def get(self, r: int, name: str) -> np.ndarray:
        if (r, name) not in self.maps:
            if len(self.maps) >= self.MAPS:
                self.maps.pop(next(iter(self.maps)))
            path = f"{self.folder}/{r:06d}.{name}"
            there = os.path.exists(path) and os.path.getsize(path)
            self.maps[r, name] = np.memmap(path, self.kinds[name], "r") if there else np.zeros(0, self.kinds[name])
        return self.maps[r, name]

    def repeated(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each anchor is repeated, and whether its stretches differ."""
        order = np.argsort(h)
        wanted = h[order]
        present, edge = np.unique(range_of(wanted, self.ranges), return_index=True)
        found, differ = np.zeros(len(h), bool), np.zeros(len(h), bool)
        for r, a, b in zip(present.tolist(), edge.tolist(), [*edge[1:].tolist(), len(h)], strict=False):
            if len(keys := self.get(r, "key")):
                at = np.minimum(np.searchsorted(keys, wanted[a:b]), len(keys) - 1)
                same = keys[at] == wanted[a:b]
                found[order[a:b]] = same
                differ[order[a:b]] = same & self.get(r, "differ")[at]
        return found, differ


_SENT = "repeat boolean, doc_id long, tag long, start long, stop long, anchor long, v long, place int, text binary"
_FIELDS = [x.split()[0] for x in _SENT.split(", ")]


def _runs(which: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merged spans of (which, start, stop): overlapping or touching ones of one document become one."""
    order = np.lexsort((start, which))
    which, start, stop = which[order], start[order], stop[order]
    if not len(which):
        return which, start, stop
    edge = np.int64(1) << 40
    reach = np.maximum.accumulate(which * edge + stop)  # documents come in order, so a greater one outreaches all before
    new = np.ones(len(which), bool)
    new[1:] = which[1:] * edge + start[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return which[at], start[at], reach[np.append(at[1:], len(which)) - 1] - which[at] * edge


def _send_stretches(folder: str, ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated = Ranges(folder, ranges, key=U64, differ=bool)
        held: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            doc, tag, start, stop, anchor, v, place = (np.concatenate([x[k] for x in held]) for k in range(7))
            texts = {}
            base = 0
            for x in held:
                texts |= {base + k: t for k, t in x[7].items()}
                base += len(x[0])
            held.clear()
            order = np.lexsort((start, tag, doc, v, anchor))
            first = _heads(anchor[order], v[order])
            lone, later = order[first], order[~first]
            # Of rows that are one document, none is the earlier: only strictly later places are repeats.
            lead = lone[np.cumsum(first) - 1][~first]
            later = later[(doc[later] != doc[lead]) | (tag[later] != tag[lead]) | (start[later] != start[lead])]
            for d, g, s, e in _spans(doc[later], tag[later], start[later], stop[later]):
                none = pa.nulls(len(d), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(d), bool)), pa.array(d), pa.array(g), pa.array(s), pa.array(e), none, none, pa.nulls(len(d), pa.int32()), pa.nulls(len(d), pa.binary())], _FIELDS)
            for at in range(0, len(lone), 20_000):
                x = lone[at : at + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(x), bool)), *(pa.array(y[x].view(np.int64)) for y in (doc, tag, start, stop, anchor, v)), pa.array(place[x], pa.int32()), pa.array([texts.get(i) for i in x.tolist()], pa.binary())], _FIELDS)

        size = 0
        for batch in in_slices(batches, "text", PART):
            doc, tag = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for part in _parts(batch, "text"):
                found = Stretches(*part)
                is_repeated, differ = repeated.repeated(found.anchor)
                which = np.flatnonzero(is_repeated)
                if not len(which):
                    continue
                a, n = found.first[which], found.count[which] + LENGTH - 1
                text = np.flatnonzero(differ[which])
                raw = found.data.tobytes()
                texts = {k: raw[x:y] for k, x, y in zip(text.tolist(), a[text].tolist(), (a + n)[text].tolist(), strict=True)}
                row, start = found.row[which], found.start[which]
                held.append((doc[row], tag[row], start, start + n, found.anchor[which], found.content()[which], found.place[which], texts))
                size += len(which) + 2 * len(text)
            if size > KEPT:
                yield from flush()
                size = 0
        yield from flush()

    return run


def _spans(doc: np.ndarray, tag: np.ndarray, start: np.ndarray, stop: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """The spans merged by document, as one set of arrays; none for no spans."""
    if len(doc):
        order = np.lexsort((tag, doc))
        ids = np.empty(len(doc), np.int64)
        head = _heads(doc[order], tag[order])
        ids[order] = np.cumsum(head) - 1
        lead = order[head]
        w, s, e = _runs(ids, start, stop)
        yield doc[lead][w], tag[lead][w], s, e


def refine(data: np.ndarray, begin: np.ndarray, end: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(positions, classes) of all positions whose ``length``-byte string lies in one text and occurs again.

    Texts are data[begin:end]. Bucket pointers are ranks of bucket heads among all positions sorted so far: refining a
    bucket only moves pointers within the bucket's own range, so pointers of finished buckets stay comparable.
    """
    n = len(data)
    room = np.zeros(n, np.int64)  # bytes from a position to the end of its text
    for_text = np.repeat(np.arange(len(begin)), end - begin)
    pos = np.arange(n) - np.repeat(np.cumsum(end - begin) - (end - begin), end - begin) + np.repeat(begin, end - begin) if len(begin) else np.zeros(0, np.int64)
    room[pos] = end[for_text] - pos
    q = 8
    active = pos[room[pos] >= q]
    grams = np.zeros(len(active), U64)
    for k in range(q):
        grams = (grams << U64(8)) | data[active + k].astype(U64)
    bucket = np.full(n, -1, np.int64)
    order = np.argsort(grams, kind="stable")
    active, grams = active[order], grams[order]
    head = np.ones(len(active), bool)
    head[1:] = grams[1:] != grams[:-1]
    bucket[active] = np.flatnonzero(head)[np.cumsum(head) - 1]
    depth = q
    while depth < length:
        step = min(depth, length - depth)
        active = active[room[active] >= depth + step]
        active = active[np.argsort(bucket[active], kind="stable")]
        active = _shared(active, bucket[active])
        if not len(active):
            return active, active
        mine, later = bucket[active], bucket[active + step]
        order = np.lexsort((later, mine))
        active, mine, later = active[order], mine[order], later[order]
        place = np.arange(len(active))
        group = np.ones(len(active), bool)
        group[1:] = mine[1:] != mine[:-1]
        head = group.copy()
        head[1:] |= later[1:] != later[:-1]
        # All pointers of this depth are written together, after all have been read.
        bucket[active] = mine + place[head][np.cumsum(head) - 1] - place[group][np.cumsum(group) - 1]
        depth += step
    active = _shared(active, bucket[active])
    return active, bucket[active]


def _shared(active: np.ndarray, pointer: np.ndarray) -> np.ndarray:
    """Positions, sorted by pointer, whose bucket has two or more."""
    same = np.zeros(len(active) + 1, bool)
    same[1:-1] = pointer[1:] == pointer[:-1]
    return active[same[1:] | same[:-1]]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated spans of stretches sorted by anchor, content and order."""

    def done(t: pa.Table) -> Iterator[pa.RecordBatch]:
        if not t.num_rows:
            return
        doc, tag, start, stop, anchor, v = (t.column(k).to_numpy() for k in ("doc_id", "tag", "start", "stop", "anchor", "v"))
        head = _heads(anchor, v)
        lead = np.flatnonzero(head)[np.cumsum(head) - 1]
        later = np.flatnonzero(~head & ((doc != doc[lead]) | (tag != tag[lead]) | (start != start[lead])))
        spans = [(doc[later], tag[later], start[later], stop[later])]
        # Different stretches of one anchor are compared byte by byte.
        first = np.flatnonzero(head)
        kinds = _shared(first, anchor[first])
        if len(kinds):
            texts = t.column("text").take(pa.array(kinds)).combine_chunks().cast(pa.large_binary())
            if texts.null_count:
                raise AssertionError("a stretch that differs from another has come without its text")
            bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2], np.uint8)
            where, classes = refine(data, bounds[:-1], bounds[1:])
            own = np.searchsorted(bounds, where, side="right") - 1
            k = kinds[own]
            at = start[k] + where - bounds[own]
            order = np.lexsort((at, tag[k], doc[k], classes))
            c, k, at = classes[order], k[order], at[order]
            lead = np.flatnonzero(_heads(c)) if len(c) else np.zeros(0, np.int64)
            least = np.repeat(lead, np.diff(np.append(lead, len(c))))
            again = (doc[k] != doc[k[least]]) | (tag[k] != tag[k[least]]) | (at != at[least])
            spans.append((doc[k[again]], tag[k[again]], at[again], at[again] + LENGTH))
        for d, g, s, e in _spans(*(np.concatenate([x[i] for x in spans]) for i in range(4))):
            yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(g), pa.array(s), pa.array(e)], ["doc_id", "tag", "start", "stop"])

    rest: list[pa.RecordBatch] = []
    for batch in batches:
        rest.append(batch)
        if sum(b.nbytes for b in rest) < MEET:
            continue
        t = pa.Table.from_batches(rest)
        anchor = t.column("anchor").to_numpy()
        other = np.flatnonzero(anchor != anchor[-1])
        cut = int(other[-1]) + 1 if len(other) else 0  # the last anchor may go on
        yield from done(t.slice(0, cut))
        rest = t.slice(cut).to_batches()
    if rest:
        yield from done(pa.Table.from_batches(rest))


_BUCKET = "anchor long, v long, doc_id long, tag long, start long, stop long, place int, lo int, hi int, text binary"


def _halved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of buckets of windows with the anchor at places lo to hi, cut in two by place. All windows of a half hold the
    bytes from its least place before the anchor to what its greatest leaves after it: with the old bucket they identify the new."""
    names = [x.split()[0] for x in _BUCKET.split(", ")]
    for batch in batches:
        for at in range(0, batch.num_rows, 5_000):
            b = batch.slice(at, 5_000)
            col = {k: b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in names[:-1]}
            texts = b.column(b.schema.get_field_index("text")).cast(pa.large_binary())
            bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
            bounds = bounds - bounds[0]
            count = np.diff(bounds) - LENGTH + 1
            mid = (col["lo"] + col["hi"]) // 2
            for lo, hi in ((col["lo"], mid), (mid + 1, col["hi"])):
                # Window k of a stretch has the anchor at place - k.
                first, last = np.maximum(col["place"] - hi, 0), np.minimum(col["place"] - lo, count - 1)
                own = np.flatnonzero((first <= last) & (lo <= hi))
                first, last, lo_, hi_ = first[own].astype(np.int64), last[own].astype(np.int64), lo[own], hi[own]
                begin = bounds[own] + first
                end = bounds[own] + last + LENGTH
                anchor = bounds[own] + col["place"][own]
                bucket = mixed(xx64(data, anchor - lo_, anchor + LENGTH - hi_, 13) ^ mixed(col["anchor"][own].view(U64) + (lo_ * 64 + hi_).astype(U64)))
                place = (col["place"][own] - first).astype(np.int32)
                raw = data.tobytes()
                start = col["start"][own] + first
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket.view(np.int64)), pa.array(_content(data, begin, end, place).view(np.int64)), pa.array(col["doc_id"][own]), pa.array(col["tag"][own]), pa.array(start), pa.array(start + end - begin),
                     pa.array(place), pa.array(lo_, pa.int32()), pa.array(hi_, pa.int32()), pa.array([raw[x:y] for x, y in zip(begin.tolist(), end.tolist(), strict=True)], pa.binary())], names)


def _gathered(rows: DataFrame) -> DataFrame:
    columns = ["anchor", "v", "doc_id", "tag", "start", "stop", "text"]
    return rows.select(*columns).repartition("anchor").sortWithinPartitions(*columns[:5]).mapInArrow(_meet, "doc_id long, tag long, start long, stop long")


def _split_hot(rows: DataFrame, hot: int) -> tuple[DataFrame, DataFrame]:
    """The rows of buckets of at most ``hot`` rows, and the others. There is at most one hot bucket for each ``hot`` rows."""
    many = written(rows.where("text is not null").groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("anchor"), "hot")
    if many.isEmpty():
        return rows, rows.limit(0)
    return rows.join(many, "anchor", "left_anti"), rows.join(many, "anchor", "left_semi")


def repeated_spans(docs: DataFrame, ranges: int | None = None, hot: int = HOT) -> DataFrame:
    """(doc_id, tag, start, stop) spans of repeated bytes of docs (doc_id, tag, text); spans may overlap."""
    spark = docs.sparkSession
    ranges = ranges or ranges_for(docs, "text")
    folder = shared_local_dir(spark, "anchors")
    counted = docs.select("text").mapInArrow(_count_anchors(ranges), "r int, h binary, v binary, many binary")
    counted.repartition(ranges, "r").groupBy("r").applyInArrow(_keep_repeated(folder), "r int, n long").agg(F.sum("n")).first()
    sent = written(docs.select("doc_id", "tag", "text").mapInArrow(_send_stretches(folder, ranges), _SENT), "stretches")
    spans = sent.where("repeat").select("doc_id", "tag", "start", "stop")
    rare, rest = _split_hot(sent.where("not repeat"), hot)
    spans = spans.unionByName(_gathered(rare))
    rest = rest.withColumns({"lo": F.lit(0), "hi": F.lit(_W - 1)})
    for _ in range((_W - 1).bit_length()):
        if rest.isEmpty():
            return spans
        rest = written(rest.mapInArrow(_halved, _BUCKET), "buckets")
        rare, rest = _split_hot(rest, hot)
        spans = spans.unionByName(_gathered(rare))
    if rest.isEmpty():
        return spans
    # One place each: a row is one window, and its bucket's windows are alike.
    first = rest.groupBy("anchor", "text").agg(F.min(F.struct("doc_id", "tag", "start")).alias("first"))
    again = rest.join(first, ["anchor", "text"]).where(F.struct("doc_id", "tag", "start") > F.col("first"))
    return spans.unionByName(again.select("doc_id", "tag", "start", "stop"))


def _keep_spans(folder: str):
    """Stores a range's merged spans by document."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        r = key[0].as_py()
        for d, g, s, e in _spans(*(table.column(k).to_numpy() for k in ("doc_id", "tag", "start", "stop"))):
            order = np.lexsort((s, g, d))
            d, g, s, e = d[order], g[order], s[order], e[order]
            at = np.flatnonzero(_heads(d, g))
            _store(folder, r, doc=d[at], tag=g[at], bound=np.append(at, len(d)).astype(np.int64), start=s, stop=e)
        return pa.table({"r": pa.array([r], pa.int32()), "n": pa.array([table.num_rows], pa.int64())})

    return run


def _cut(folder: str, ranges: int, with_bytes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stored = Ranges(folder, ranges, doc=np.int64, tag=np.int64, bound=np.int64, start=np.int64, stop=np.int64)
        for batch in in_slices(batches, "text", 2 * PART):
            data, offsets = text_buffer(batch.column(3))
            doc, tag, of = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            raw = data.tobytes()
            rows = []
            for i, r in enumerate(of.tolist()):
                own = raw[offsets[i] : offsets[i + 1]]
                a, b = (int(np.searchsorted(stored.get(r, "doc"), doc[i], side=side)) for side in ("left", "right"))
                tags = stored.get(r, "tag")[a:b]
                at = int(np.searchsorted(tags, tag[i]))
                if at < len(tags) and tags[at] == tag[i]:
                    a, b = stored.get(r, "bound")[a + at : a + at + 2]
                    edges = [0, *np.stack([stored.get(r, "start")[a:b], stored.get(r, "stop")[a:b]], axis=1).ravel().tolist(), len(own)]
                else:
                    edges = [0, len(own)]
                kept = b"".join(own[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                rows.append((len(own), len(own) - len(kept), len(edges) // 2 - 1, hashlib.sha256(kept).hexdigest(), kept if with_bytes else None))
            n_bytes, n_removed, n_spans, sha, kept = zip(*rows, strict=True)
            columns = [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sha)]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(kept, pa.binary())], [*names, "kept"]) if with_bytes else pa.RecordBatch.from_arrays(columns, names)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = True, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (the bytes that stay; a cut may split a character)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    ranges = ranges_for(docs.select(text.alias("text")), "text")
    keyed = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("doc_id"), F.xxhash64(text).alias("tag"), text.alias("text"))
    of = F.pmod(F.xxhash64("doc_id", "tag"), F.lit(ranges)).cast("int")
    folder = shared_local_dir(spark, "spans")
    repeated_spans(keyed, ranges, hot).withColumn("r", of).repartition(ranges, "r").groupBy("r").applyInArrow(_keep_spans(folder), "r int, n long").agg(F.sum("n")).first()
    kinds = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_bytes
    out = keyed.select("doc_id", "tag", of.alias("r"), "text").mapInArrow(_cut(folder, ranges, with_bytes), kinds)
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(-(2**63))))
