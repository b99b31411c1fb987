"""SimHash near-dedup with bit-sliced comparison.

A fingerprint has 64 majority bits of the XXH64 hashes of a text's word shingles. Fingerprints within RADIUS bits are
linked; links join into components.

Only distinct fingerprints are compared. Two that differ in at most 2 bits agree on at least two of four 16-bit blocks, so
each fingerprint is filed under six 32-bit keys and no pair is missed. A bucket of more than BUCKET fingerprints is filed
once more by pairs of 8-bit blocks of its remaining 32 bits: again no pair is missed, and with 48 bits fixed a bucket
holds at most 2**16 fingerprints whatever the corpus. Within a bucket bit planes are stored vertically, 64 fingerprints to a
word; a carry-save counter of two bits and a saturation flag adds one plane at a time to all distances, and every
CHECK_PLANES planes the 64-lane blocks whose distances all exceed the radius are abandoned. A bucket returns stars
(fingerprint, smallest fingerprint of its component there), so a group of copies costs rows in proportion to its size.
Components over all buckets come from alternating star contraction of those edges.

Defined cases: null and empty texts have fingerprint zero and link like any other; texts of fewer words than a shingle are
one shingle; repeated rows and doc_ids give repeated rows; further columns are not read; an empty table gives an empty
result; a null doc_id comes after all others; texts are whole, of any length.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import similar
from .common import in_slices, scratch, written

SHINGLE = 3
RADIUS = 2
BUCKET = 4096
CHECK_PLANES = 8
_NO_ID = 2**63 - 1  # stands for a null doc_id: after all others
_ROWS = 1 << 20  # (query, 64-lane block) rows compared at a time
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
_ONE = np.uint64(1)


def fingerprints_of(texts: list[str | None], shingle: int = SHINGLE) -> np.ndarray:
    """64-bit fingerprints as int64."""
    digest, hashes, counts = xxhash.xxh64_intdigest, [], []
    for text in texts:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if len(words) <= shingle:
            own = [digest(b" ".join(words), 42)] if words else []
        else:
            line = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            starts = np.concatenate([[0], ends[:-1]])
            own = [digest(line[a:b], 42) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)]
        hashes += own
        counts.append(len(own))
    out = np.zeros(len(texts), np.uint64)
    if not hashes:
        return out.view(np.int64)
    h = np.array(hashes, np.uint64)
    n = np.array(counts)
    first = np.cumsum(n) - n
    # Sums of at most 255 hashes fit one byte for each bit; pieces are then summed in full width.
    pieces = -(-n // 255)
    of = np.repeat(np.arange(len(n)), pieces)
    at = first[of] + 255 * (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    sums = np.add.reduceat(_SPREAD[h.view(np.uint8).reshape(-1, 8)], at, axis=0).view(np.uint8).reshape(len(of), 64)
    full = n > 0
    per = np.add.reduceat(sums, (np.cumsum(pieces) - pieces)[full], axis=0, dtype=np.int64)
    out[full] = np.packbits(2 * per > n[full][:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out.view(np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (64 bits as a long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text", 3_000_000):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints_of(batch.column(1).to_pylist(), shingle))], ["doc_id", "fp"])

    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def linked_within(fp: np.ndarray, bucket: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For distinct fingerprints grouped by equal neighbouring ``bucket`` values, the index of the smallest fingerprint of each one's component within its bucket."""
    n = len(fp)
    label = np.arange(n)
    if n < 2:
        return label
    begin = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    size = np.diff(np.append(begin, n))
    blocks = -(-size // 64)
    block0 = np.cumsum(blocks) - blocks
    group = np.repeat(np.arange(len(begin)), size)
    place = np.arange(n) - begin[group]
    word, lane = block0[group] + place // 64, (place % 64).astype(np.uint64)
    total = int(blocks.sum())
    bits = fp.view(np.uint64)
    planes = np.zeros((64, total), np.uint64)
    order = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    for b in range(64):
        planes[b, word[order]] = np.bitwise_or.reduceat(((bits >> np.uint64(b)) & _ONE) << lane, order)
    valid = np.zeros(total, np.uint64)
    valid[word[order]] = np.bitwise_or.reduceat(_ONE << lane, order)
    base = np.zeros(total, np.int64)
    base[word[order]] = order
    # Each query meets the blocks at and after its own in its bucket.
    todo = blocks[group] - place // 64
    cut = np.cumsum(todo)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(cut, (cut[at - 1] if at else 0) + _ROWS, side="right")))
        t = todo[at:to]
        query = np.repeat(np.arange(at, to), t)
        block = word[query] + np.arange(len(query)) - np.repeat(np.cumsum(t) - t, t)
        hits = _compare(bits, planes, valid, query, block, radius)
        at = to
        for i, j in hits:
            j = base[j[0]] + j[1]
            keep = i != j
            _union(label, i[keep], j[keep])
    return _roots(label)


def _compare(bits: np.ndarray, planes: np.ndarray, valid: np.ndarray, query: np.ndarray, block: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]]:
    if radius > 3:
        raise ValueError("the counter holds distances up to 3")
    one = np.zeros(len(query), np.uint64)
    two, over = one.copy(), one.copy()
    for b in range(64):
        differs = planes[b][block] ^ (np.uint64(0) - ((bits[query] >> np.uint64(b)) & _ONE))
        carry = one & differs
        one ^= differs
        over |= two & carry
        two ^= carry
        if b % CHECK_PLANES == CHECK_PLANES - 1:
            near = valid[block] & ~(over | _beyond(one, two, radius))
            alive = near != 0
            if not alive.all():
                query, block, one, two, over, near = (x[alive] for x in (query, block, one, two, over, near))
            if not len(query):
                return
    for at in range(0, len(query), 1 << 14):
        lanes = np.unpackbits(near[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        r, lane = np.nonzero(lanes)
        yield query[at + r], (block[at + r], lane)


def _beyond(one: np.ndarray, two: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose two-bit count is over the radius."""
    return {0: one | two, 1: two, 2: one & two, 3: np.zeros_like(one)}[radius]


def _union(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the sets of i and j; a label is a smaller index of the same set or the index itself."""
    while len(i):
        a, b = _find(label, i), _find(label, j)
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))


def _find(label: np.ndarray, x: np.ndarray) -> np.ndarray:
    x = label[x]
    while True:
        up = label[x]
        if (up == x).all():
            return x
        x = up


def _roots(label: np.ndarray) -> np.ndarray:
    while True:
        up = label[label]
        if (up == label).all():
            return label
        label = up


def _compare_buckets(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(key: np.ndarray, sub: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(fp):
                change = np.concatenate([[False], (key[1:] != key[:-1]) | (sub[1:] != sub[:-1])])
                root = linked_within(fp, np.cumsum(change), radius)
                own = root != np.arange(len(fp))
                yield pa.RecordBatch.from_arrays([pa.array(fp[own]), pa.array(fp[root[own]])], ["u", "v"])

        rest = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        for batch in batches:
            rest = [np.concatenate([r, batch.column(k).to_numpy(zero_copy_only=False)]) for k, r in enumerate(rest)]
            key, sub, fp = rest
            if len(key) < 2:
                continue
            other = np.flatnonzero((key != key[-1]) | (sub != sub[-1]))
            cut = int(other[-1]) + 1 if len(other) else 0  # the last bucket may go on in the next batch
            yield from done(key[:cut], sub[:cut], fp[:cut])
            rest = [x[cut:] for x in rest]
        yield from done(*rest)

    return run


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Star edges (u > v) of the distinct fingerprints in column fp."""
    if radius > 2:
        raise ValueError("four blocks find pairs within 2 bits")
    block = [F.shiftrightunsigned("fp", 16 * i).bitwiseAND(0xFFFF) for i in range(4)]
    keys = [F.lit(t).cast("long") * F.lit(1 << 32) + block[i] * F.lit(1 << 16) + block[j] for t, (i, j) in enumerate(combinations(range(4), 2))]
    filed = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))
    counts = filed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = filed.join(counts, "key")
    small = met.where(F.col("n") <= BUCKET).select("key", F.lit(0).cast("long").alias("sub"), "fp")
    # The 32 bits that the key leaves free, in 8-bit blocks.
    table_of = F.shiftright("key", 32)
    free = F.lit(None).cast("array<bigint>")
    for t, pair in enumerate(combinations(range(4), 2)):
        parts = [F.shiftrightunsigned(block[i], s).bitwiseAND(0xFF) for i in range(4) if i not in pair for s in (0, 8)]
        free = F.when(table_of == t, F.array(*parts)).otherwise(free)
    subs = [F.lit(1 + t).cast("long") * F.lit(1 << 16) + F.element_at("free", i + 1) * F.lit(256) + F.element_at("free", j + 1) for t, (i, j) in enumerate(combinations(range(4), 2))]
    large = met.where(F.col("n") > BUCKET).select("key", "fp", free.alias("free")).select("key", F.explode(F.array(*subs)).alias("sub"), "fp")
    dealt = small.unionByName(large).repartition("key", "sub").sortWithinPartitions("key", "sub", "fp")
    return dealt.mapInArrow(_compare_buckets(radius), "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for every node u that is not the smallest of its component, by alternating large and small stars."""
    edges = written(edges, "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u")
        small = hung.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = written(small.distinct(), "edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select("u", F.col("v").alias("root"))
        before = now


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    marked = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    roots = components(links(classes.select("fp"), radius)).withColumnRenamed("u", "fp")
    rooted = classes.join(roots, "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = rooted.join(names, "root").select("fp", "component_id")
    shown = lambda c: F.nullif(c, F.lit(_NO_ID)).alias(c)
    return marked.join(named, "fp").select(shown("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), shown("component_id"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of their component, with all their columns.

    Here texts are linked within RADIUS bits, and also at a 5-word similarity of 0.8 or more (see ``similar``), which differ
    in up to a dozen bits. Fingerprints are the nodes for both.

    Defined cases: null and empty texts are one text without shingles, linked by their fingerprint alone; a null id is larger than
    all others; of rows that share an id each is judged by its own text; rows that repeat the kept id and its text all stay;
    an empty table gives no rows; other columns pass through.
    """
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("h"), F.col(text_col).cast("string").alias("text"))
    spark = texts.sparkSession
    order = similar.common_shingles(texts.select("h", "text"))
    common = spark.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text", 3_000_000):
            n, keys = similar.prefixes(batch.column(2), common.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fingerprints_of(batch.column(2).to_pylist())), pa.array(n, pa.int32()), keys], ["doc_id", "h", "fp", "n", "keys"])

    marked = written(texts.mapInArrow(run, "doc_id long, h long, fp long, n int, keys array<long>"), "marked")
    classes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    prints = marked.select("h", "fp").distinct()

    def edges(pairs: DataFrame) -> DataFrame:
        u, v = (prints.select(F.col("h").alias(c), F.col("fp").alias(f"{c}_fp")) for c in "uv")
        return similar.similar(texts.select("h", "text"), pairs).join(u, "u").join(v, "v").where("u_fp <> v_fp").select(F.greatest("u_fp", "v_fp").alias("u"), F.least("u_fp", "v_fp").alias("v"))

    def joined(links: DataFrame, pairs: DataFrame) -> DataFrame:
        """(fp, root) of links and pairs; what was written on the way is deleted."""
        with scratch(spark):
            return written(components(links.unionByName(edges(pairs))).withColumnRenamed("u", "fp"), "roots", keep=True)

    def links_of(roots: DataFrame) -> DataFrame:
        return roots.select(F.col("fp").alias("u"), F.col("root").alias("v"))

    def named() -> DataFrame:
        return prints.join(roots, "fp", "left").select("h", F.coalesce("root", "fp").alias("root"))

    found = similar.candidates(marked)
    roots = joined(links(classes.select("fp")), similar.met(found))
    left = []
    for _ in range(similar.ROUNDS):
        rows, counts = similar.large(found, named())
        last = counts.orderBy(F.desc("n"), "key").limit(similar.COMMON).toArrow()
        if not last.num_rows:
            break
        if last.num_rows == similar.COMMON:  # more keys than are sent to all tasks: the others wait for the end
            sent = F.broadcast(spark.createDataFrame(last.select(["key"])))
            left.append((rows.join(sent, "key", "left_anti"), counts.join(sent, "key", "left_anti")))
            rows = rows.join(sent, "key", "left_semi")
        order = similar.put_last(order, *(last.column(c).to_numpy() for c in ("key", "n")))
        found = similar.candidates(written(similar.filed(texts, rows.select("h").distinct(), order), "filed"))
        roots = joined(links_of(roots), similar.met(found))
    else:
        left.append(similar.large(found, named()))
    for rows, counts in left:
        if not counts.isEmpty():
            roots = joined(links_of(roots), similar.still_apart(rows, counts, texts))
    rooted = classes.join(roots, "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    kept = rooted.groupBy("root").agg(F.min("rep").alias("__corvane_id"))
    # By id and text: another text of the same id may be in another component.
    kept = prints.join(rooted.select("fp", "root"), "fp").join(kept, "root").select("__corvane_id", F.col("h").alias("__corvane_h")).distinct()
    rows = docs.withColumns({"__corvane_id": F.coalesce(docs[id_col].cast("long"), F.lit(_NO_ID)), "__corvane_h": F.xxhash64(docs[text_col].cast("string"))})
    return rows.join(kept, ["__corvane_id", "__corvane_h"], "left_semi").select(*docs.columns)
