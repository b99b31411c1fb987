"""Exact dedup by an extendible-hash index on shared files, in DataFrame functions only.

Keys are 64-bit hashes of normalised texts. A directory maps hash prefixes to buckets: it begins at depth 0 and
doubles; each doubling splits the buckets that hold more keys than they may. The directory is grown from key counts of hash
cells, and the depth of the cells follows the number of keys: 2**LEAST_DEPTH cells serve up to BUCKET_KEYS * 2**(LEAST_DEPTH - SPARE)
keys, beyond that they double as the keys do. A directory of 2**LEAST_DEPTH entries is broadcast, a larger one is a joined table.

The first pass over the texts counts keys. The second groups rows by hash and the bytes of the text
itself; Spark's map-side aggregation folds copies before the shuffle, so a group that holds a third of all
rows is one row for each task, and picks the row that stays. Owner tasks then take ranges of buckets, chain the texts whose
hashes collide and write the index as Parquet into the shared folder. The third pass looks each row's entry up in the index, by
cell, bucket and hash.

Defined cases: null text is empty; empty texts form a group of their own; a null doc_id comes after all others; rows
that repeat a doc_id count one by one, and those that also repeat its text are marked alike; other columns of the input are not read, so clashing names do no harm; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Keys a bucket may hold before it splits, the depth of the smallest table of cells, and how many cells deep an average bucket is.
BUCKET_KEYS = 50_000
LEAST_DEPTH = 16
SPARE = 4
_NO_ID = 2**63 - 1  # stands for a null doc_id: after all others
_SPACE = r"[\x20\x09-\x0D]+"
#: Puts the longest text, then the smallest doc_id, first in one fixed-width value that map-side aggregation can update in place.
_RANK, _STEP = "decimal(38,0)", "100000000000000000000BD"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), _SPACE, "")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return (
        docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("doc_id"), normalised(F.col(text_col)).alias("norm"), F.length(text).cast("long").alias("n_code_points"))
        .withColumn("h", F.xxhash64("norm"))
    )


def _cell(h: Column, depth: int = LEAST_DEPTH) -> Column:
    """The hash's first ``depth`` bits."""
    return F.shiftrightunsigned(h, 64 - depth)


def depth_of(keys: int, bucket_keys: int = BUCKET_KEYS) -> int:
    """Bits of a cell for so many keys: buckets of an average fill have 2**SPARE cells at least."""
    return max(LEAST_DEPTH, (max(keys, 1) // bucket_keys).bit_length() + SPARE)


def directory(cells: DataFrame, bucket_keys: int = BUCKET_KEYS, cell_depth: int = LEAST_DEPTH) -> DataFrame:
    """(cell, bucket, depth) of counts (cell, n): from one bucket on, doubled until none splits any more.

    At each depth a bucket's prefix is the cell's first bits; a prefix of at most ``bucket_keys`` keys whose parent has more is a
    bucket. ``bucket`` is the first cell of the bucket's range, so buckets are numbered in key order.
    """
    cells = cells.select(F.col("cell").cast("long").alias("cell"), "n")
    # Sums fold within tasks, so a prefix is a row for each of them; a prefix then meets its twin alone.
    levels = cells.select("n", "cell", F.explode(F.sequence(F.lit(0), F.lit(cell_depth))).alias("depth")).groupBy("depth", F.expr(f"shiftright(cell, {cell_depth} - depth)").alias("prefix")).agg(F.sum("n").alias("keys"))
    twins = Window.partitionBy("depth", F.when(F.col("depth") > 0, F.shiftright("prefix", 1)))
    fits = (F.col("keys") <= bucket_keys) | (F.col("depth") == cell_depth)
    buckets = levels.withColumn("parent", F.sum("keys").over(twins)).where(fits & ((F.col("parent") > bucket_keys) | (F.col("depth") == 0)))
    width = f"shiftleft(1L, {cell_depth} - depth)"
    every = buckets.select(F.expr(f"prefix * {width}").alias("bucket"), "depth", F.explode(F.expr(f"sequence(prefix * {width}, prefix * {width} + {width} - 1)")).alias("cell"))
    return every.join(cells.select("cell"), "cell", "left_semi").select("cell", "bucket", "depth")


def _small(entries: DataFrame, depth: int) -> DataFrame:
    """At most 2**LEAST_DEPTH rows of three numbers are broadcast, under 2 MB."""
    return F.broadcast(entries) if depth == LEAST_DEPTH else entries


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_keys: int = BUCKET_KEYS) -> tuple[DataFrame, int]:
    """The index, one row per distinct text: bucket, depth, h, sha, link (place in the chain of its hash), n_texts
    (length of that chain by digest), keep_id, group_size; and the bits of a cell."""
    keyed = _keyed(docs, id_col, text_col)
    counted = lambda depth: written(keyed.groupBy("h").agg(F.lit(1).alias("one")).groupBy(_cell(F.col("h"), depth).alias("cell")).agg(F.count("*").alias("n")), "cells")
    counts = counted(LEAST_DEPTH)
    depth = depth_of(counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], bucket_keys)
    if depth > LEAST_DEPTH:
        counts = counted(depth)
    entries = directory(counts, bucket_keys, depth)
    best = F.expr(f"cast(n_code_points as {_RANK}) * {_STEP} + (9223372036854775807BD - doc_id)").cast(_RANK)
    texts = (
        keyed.groupBy("h", "norm")
        .agg(F.count("*").alias("group_size"), F.max(best).alias("best"))
        .select("h", F.sha2("norm", 256).alias("sha"), "group_size", F.expr(f"cast(9223372036854775807BD - best % {_STEP} as long)").alias("keep_id"), _cell(F.col("h"), depth).alias("cell"))
    )
    owned = texts.join(_small(entries, depth), "cell").drop("cell").repartitionByRange("bucket", "h")
    # Ranges of (bucket, h) keep equal values together, so both windows are worked where their buckets are.
    chain = Window.partitionBy("bucket", "h").orderBy("sha", "keep_id")
    return written(owned.withColumn("link", F.row_number().over(chain)).withColumn("n_texts", F.count("*").over(Window.partitionBy("bucket", "h", "sha"))), "index"), depth


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """Every row with its group: doc_id, keep_id, group_size, kept, text_sha256, bucket.

    Texts are equal when identical without ``[\\x20\\x09-\\x0D]``; the row of most code points, then of smallest doc_id, stays.
    """
    index, depth = build_index(docs, id_col, text_col, bucket_keys)
    keyed = _keyed(docs, id_col, text_col).withColumn("sha", F.sha2("norm", 256))
    if not index.where("n_texts > 1").isEmpty():
        raise ValueError("two different texts have the same SHA-256")
    # The directory again: a row goes from its cell to its bucket, and there to its hash.
    entries = index.select(_cell(F.col("h"), depth).alias("cell"), "bucket").distinct()
    routed = keyed.select("doc_id", "h", "sha", _cell(F.col("h"), depth).alias("cell")).join(_small(entries, depth), "cell").drop("cell")
    found = routed.join(index.select("bucket", "h", "sha", "keep_id", "group_size"), ["bucket", "h", "sha"])
    shown = lambda c: F.nullif(c, F.lit(_NO_ID))
    return found.select(shown("doc_id").alias("doc_id"), shown("keep_id").alias("keep_id"), F.col("group_size").cast("long").alias("group_size"), (F.col("doc_id") == F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"), "bucket")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Of rows that repeat a kept doc_id and its text one stays."""
    ids = exact_groups(docs, id_col, text_col).where("kept").select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("__corvane_id"), F.col("text_sha256").alias("__corvane_sha")).distinct()
    rows = docs.withColumns({"__corvane_id": F.coalesce(docs[id_col].cast("long"), F.lit(_NO_ID)), "__corvane_sha": F.sha2(normalised(docs[text_col]), 256)})
    keys = ["__corvane_id", "__corvane_sha"]
    return rows.join(ids, keys, "left_semi").dropDuplicates(keys).select(*docs.columns)
