"""Merkle dataset manifest: trees of SHA-256 over the rows of each source, and one over the sources, by superblocks.

A leaf is the hash of a row's fields; while several nodes remain, each run of FANOUT consecutive nodes becomes the hash of their
hexadecimal digests. Nodes of a tree are numbered in order. Superblocks of FANOUT^LEVELS numbers are collapsed by LEVELS levels at
a time in ``applyInPandas``, and their roots again, until each tree has one node. Proofs go down the same way: a superblock meets
the proof of its root (the upper part) and puts the siblings within it (the lower part) before it.

Numbers come from a range sort: a task numbers its rows of each tree, and one pair of numbers for each task tells what earlier
tasks hold of its first tree, so a tree of any size is split over tasks. A superblock has FANOUT^LEVELS nodes at most.

Defined cases: null fields hash as ``-``, a null source is a tree of its own that comes first; null ids come first in their tree;
rows with one id stand in order of their leaves, and equal rows are leaves of their own; a single row is its tree's root; an
empty table has no root and no proofs; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

FANOUT, LEVELS = 16, 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows for each range of the sort.
RANGE_ROWS = 500_000
_KIND = "name string, extra string, at long, digest string"


def digest(parts: Sequence[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


@dataclass(frozen=True)
class Manifest:
    """``tiers``: nodes (name, extra, at, digest) of all sources' trees at every LEVELS-th level, leaves first; ``top`` likewise of the
    tree of their roots, where extra is the source's name. A name is empty for a null source, else ``+`` and the source."""

    tiers: list[DataFrame]
    top: list[DataFrame]
    root: str | None
    fanout: int = FANOUT
    levels: int = LEVELS


def tower(nodes: list[str], fanout: int, levels: int, ends: bool) -> list[list[str]]:
    """The levels over ``nodes``: ``levels`` of them, or only until one node remains if the whole tree ``ends`` here."""
    out = [nodes]
    while len(out) <= levels and not (ends and len(out[-1]) == 1):
        out.append([digest(out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def _ends(bucket: int, size: int, whole: int) -> bool:
    """Whether a superblock is its whole tree: the first one, not filled. (A filled one has as many levels either way.)"""
    return bucket == 0 and size < whole


def numbered(rows: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """(name, extra, at, digest) of rows (name, extra, digest, ...): ``at`` counts the rows of a name from 0 in order of ``order`` and digest."""
    spark = rows.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // RANGE_ROWS))
    keys = ["name", *order, "digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        first = last = None
        have = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            code = batch.column(0).dictionary_encode()
            codes, names = code.indices.to_numpy(zero_copy_only=False), code.dictionary.to_pylist()
            begin = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
            runs = np.diff(np.append(begin, len(codes)))
            base = np.zeros(len(begin), np.int64)
            if names[codes[0]] == last:
                base[0] = have
            place = np.arange(len(codes)) - np.repeat(begin - base, runs)
            first = names[codes[0]] if first is None else first
            last, have = names[codes[-1]], int(place[-1]) + 1
            leads = np.array([n == first for n in names])[codes]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(place), batch.column(2), pa.array(np.full(len(codes), task, np.int32)), pa.array(leads)], ["name", "extra", "place", "digest", "task", "leads"])

    placed = rows.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).select("name", "extra", "digest").mapInArrow(run, "name string, extra string, place long, digest string, task int, leads boolean")
    placed = written(placed, "placed")
    # A row for each task: its first name, its last with the number of rows, and the rows of the first.
    ends = placed.groupBy("task").agg(F.min("name").alias("first"), F.max(F.struct("name", "place")).alias("end"), F.count_if("leads").alias("n")).orderBy("task").collect()
    held, last, have = [], None, 0
    for r in ends:
        before = have if r["first"] == last else 0
        last, have = r["end"]["name"], r["end"]["place"] + 1 + (before if r["end"]["name"] == r["first"] else 0)
        if before:
            held.append((r["task"], before))
    before = F.broadcast(spark.createDataFrame(held, "task int, before long"))  # two numbers a task
    return placed.join(before, "task", "left").select("name", "extra", (F.col("place") + F.when(F.col("leads"), F.coalesce("before", F.lit(0))).otherwise(0)).alias("at"), "digest")


def collapsed(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """The roots of all superblocks of numbered nodes, numbered."""
    whole = fanout**levels

    def run(key: tuple[str, int], own: pd.DataFrame) -> pd.DataFrame:
        name, bucket = key
        top = tower(own.sort_values("at")["digest"].tolist(), fanout, levels, _ends(bucket, len(own), whole))[-1]
        return pd.DataFrame({"name": [name], "extra": [None], "at": [bucket], "digest": top})

    return nodes.select("name", "at", "digest").groupBy("name", F.expr(f"at div {whole}").alias("bucket")).applyInPandas(run, _KIND)


def _tiers(leaves: DataFrame, fanout: int, levels: int) -> list[DataFrame]:
    tiers = [leaves]
    while len(tiers) == 1 or not tiers[-1].where("at > 0").isEmpty():
        tiers.append(written(collapsed(tiers[-1], fanout, levels), "nodes"))
    return tiers


def manifest(rows: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> Manifest:
    """The trees of rows (source, doc_id, leaf, extra): extra is a string that comes back with the row's proof."""
    if fanout < 2 or levels < 1:
        raise ValueError("a node has two children at least, and a superblock one level")
    name = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("+"), "source"))
    leaves = written(rows.select(name.alias("name"), "doc_id", F.to_json(F.struct("doc_id", "extra")).alias("extra"), F.col("leaf").alias("digest")), "leaves")
    tiers = _tiers(numbered(leaves, ["doc_id"]), fanout, levels)
    roots = tiers[-1].select(F.lit("").alias("name"), F.col("name").alias("extra"), "digest")
    top = _tiers(numbered(roots, ["extra"]), fanout, levels)
    root = top[-1].select("digest").first()
    return Manifest(tiers, top, root and root[0], fanout, levels)


def _siblings(nodes: list[str], fanout: int) -> list[bytes]:
    """For each node the digests of the others of its run, as bytes."""
    raw = [bytes.fromhex(x) for x in nodes]
    return [b"".join(raw[i - i % fanout : i]) + b"".join(raw[i + 1 : i - i % fanout + fanout]) for i in range(len(raw))]


def _down(nodes: DataFrame, uppers: DataFrame, fanout: int, levels: int) -> DataFrame:
    """(name, extra, at, digest, subroot, proof, places, runs) of nodes, from those of the superblocks' roots."""
    whole = fanout**levels

    def run(own: pd.DataFrame, upper: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("at")
        up = upper.iloc[0]
        rows = tower(own["digest"].tolist(), fanout, levels, _ends(int(own["at"].iloc[0]) // whole, len(own), whole))[:-1]
        beside = [_siblings(x, fanout) for x in rows]
        n = range(len(own))
        at = [[i // fanout**k for k in range(len(rows))] for i in n]
        return own.assign(
            subroot=up["subroot"], proof=[b"".join([b[j] for b, j in zip(beside, at[i], strict=True)]) + up["proof"] for i in n],
            places=[[j % fanout for j in at[i]] + list(up["places"]) for i in n], runs=[[min(fanout, len(x) - j + j % fanout) for x, j in zip(rows, at[i], strict=True)] + list(up["runs"]) for i in n],
        )[["name", "extra", "at", "digest", "subroot", "proof", "places", "runs"]]

    left = nodes.select("name", "extra", "at", "digest").groupBy("name", F.expr(f"at div {whole}").alias("bucket"))
    right = uppers.select("name", F.col("at").alias("bucket"), "subroot", "proof", "places", "runs").groupBy("name", "bucket")
    return left.cogroup(right).applyInPandas(run, f"{_KIND}, subroot string, proof binary, places array<int>, runs array<int>")


def proofs(made: Manifest) -> DataFrame:
    """(source, doc_id, leaf, extra, subroot, root, proof, places, runs) of every leaf.

    proof: the digests (32 bytes each) of the others of its run, level by level from the leaf to the root, each from left to right;
    places and runs: the node's own place in the run of each level, and the nodes of that run.
    """
    rows = made.top[-1].select("name", F.lit(0).cast("long").alias("at"), F.lit(None).cast("string").alias("subroot"), F.lit(b"").alias("proof"), *(F.array().cast("array<int>").alias(c) for c in ("places", "runs")))
    for nodes in made.top[-2::-1]:
        rows = _down(nodes, rows, made.fanout, made.levels)
    rows = rows.select(F.col("extra").alias("name"), F.lit(0).cast("long").alias("at"), F.col("digest").alias("subroot"), "proof", "places", "runs")
    for nodes in made.tiers[-2::-1]:
        rows = _down(nodes, rows, made.fanout, made.levels)
    source = F.when(F.col("name") != "", F.expr("substring(name, 2)"))
    extra = F.from_json("extra", "doc_id long, extra string")
    return rows.select(source.alias("source"), extra["doc_id"].alias("doc_id"), F.col("digest").alias("leaf"), extra["extra"].alias("extra"), "subroot", F.lit(made.root).alias("root"), "proof", "places", "runs")


@F.pandas_udf(T.StringType())
def folded(leaf: pd.Series, proof: pd.Series, places: pd.Series, runs: pd.Series) -> pd.Series:
    """The root that a leaf and a proof lead to."""

    def root(own: str, beside: bytes, places: list[int], runs: list[int]) -> str:
        beside, at = bytes(beside).hex(), 0
        for place, run in zip(places, runs, strict=True):
            middle, end = at + 64 * place, at + 64 * (run - 1)
            own = digest((beside[at:middle], own, beside[middle:end]))
            at = end
        return own

    return pd.Series([root(*x) for x in zip(leaf, proof, places, runs, strict=True)], dtype=object)


def proof_digest(proof: Column) -> Column:
    """The hash of all siblings in turn, as hexadecimal text."""
    return F.sha2(F.lower(F.hex(proof)), 256)


def lowered_text(text: Column) -> Column:
    """A-Z to a-z."""
    capitals = "".join(map(chr, range(65, 91)))
    return F.translate(text, capitals, capitals.lower())


def tamper_check(docs: DataFrame, tampered: Column, fields: Sequence[str] = FIELDS) -> DataFrame:
    """Every row's leaf, roots and proof, and the root that its proof gives after the text (the last of ``fields``) of rows with
    ``tampered`` was put into lower case: doc_id, leaf, subroot, root, proof, folded_root, verified."""
    values = [F.col(c) for c in fields]
    later = leaf([*values[:-1], lowered_text(F.col(fields[-1]).cast("string"))])
    rows = docs.select(F.col(fields[1]).cast("string").alias("source"), F.col(fields[0]).cast("long").alias("doc_id"), leaf(values).alias("leaf"), F.when(tampered, later).alias("extra"))
    found = proofs(manifest(rows)).withColumn("folded_root", folded(F.coalesce("extra", "leaf"), "proof", "places", "runs"))
    return found.select("doc_id", "leaf", "subroot", "root", "proof", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
