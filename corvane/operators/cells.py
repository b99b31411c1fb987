"""Exact dense search over a partitioned vector index: cells with centres and radii, and only cells that can hold a hit are scored.

Centres are fitted on a bounded sample. A vector of a cell of centre c and radius r has a dot product with q of at most q.c + |q| r, so
the k-th score of the cells that are scored first bounds what the others must reach; cells that can't are passed over. Nothing is
approximate: the result is that of ``dense.search``. How much is passed over depends on the vectors: clusters do well, directions
drawn at random in many dimensions have no near neighbours, and every cell must be scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import dense
from .lexical import best

#: Vectors that centres are fitted on, the steps of the fit, and rows that are scored first for each query (at least k).
SAMPLE, STEPS, FIRST_ROWS = 10_000, 8, 256


@dataclass(frozen=True)
class Cells:
    """rows (id, vector, cell); centres, radii and numbers of rows by cell."""

    rows: DataFrame
    centres: np.ndarray
    radii: np.ndarray
    counts: np.ndarray


def _nearest(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    square = (centres**2).sum(axis=1)[None, :] - 2 * rows @ centres.T
    cell = square.argmin(axis=1)
    return cell, np.sqrt(((rows - centres[cell]) ** 2).sum(axis=1))


def fit(vectors: DataFrame, cells: int, sample: int = SAMPLE) -> np.ndarray:
    """Centres of (id, vector) by Lloyd's steps over at most ``sample`` vectors, taken by the hash of their id; from the farthest of them on."""
    some = vectors.where("vector is not null").select("vector", F.xxhash64("id").alias("h")).orderBy("h").limit(sample).select("vector").toPandas()
    if some.empty:
        return np.zeros((0, 0))
    if some["vector"].map(len).nunique() > 1:
        raise ValueError(f"vectors of {len(some['vector'][0])} dimensions are expected")
    rows = np.array(some["vector"].tolist(), np.float64)
    centres, far = [rows[0]], np.full(len(rows), np.inf)
    while len(centres) < min(cells, len(rows)):
        far = np.minimum(far, ((rows - centres[-1]) ** 2).sum(axis=1))
        if not far.max() > 0:
            break
        centres.append(rows[far.argmax()])
    centres = np.array(centres)
    for _ in range(STEPS):
        cell, _ = _nearest(rows, centres)
        n = np.bincount(cell, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, rows)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def built(vectors: DataFrame, cells: int = 64, sample: int = SAMPLE) -> Cells:
    """The index of all (id, vector). Rows without a vector are left out."""
    rows = vectors.where("vector is not null").select("id", "vector")
    centres = fit(rows, cells, sample)
    kind = dict(rows.dtypes)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            if len(flat) != batch.num_rows * centres.shape[1]:
                raise ValueError(f"vectors of {centres.shape[1]} dimensions are expected")
            cell, distance = _nearest(flat.reshape(batch.num_rows, -1), centres) if batch.num_rows else (np.zeros(0, np.int64), np.zeros(0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(distance)], ["id", "vector", "cell", "distance"])

    placed = rows.mapInArrow(assign, f"id {kind['id']}, vector {kind['vector']}, cell int, distance double")
    radii, counts = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
    for r in placed.groupBy("cell").agg(F.max("distance").alias("r"), F.count("*").alias("n")).collect():  # a row a cell
        radii[r["cell"]], counts[r["cell"]] = r["r"], r["n"]
    return Cells(placed.drop("distance"), centres, radii, counts)


def search(index: Cells, queries: DataFrame, k: int, digits: int = 6) -> tuple[DataFrame, DataFrame]:
    """(qid, id, score, position) of the best ``k`` for each of queries (qid, vector), and (qid, cells, rows) that were scored for it.

    Queries go in blocks of ``dense.SENT`` numbers; of a block the first hits (k for each) come to the driver, which picks the cells.
    """
    asked = queries.where("vector is not null").select("qid", "vector")
    kinds = {"qid": dict(asked.dtypes)["qid"], "id": dict(index.rows.dtypes)["id"]}
    schema = f"qid {kinds['qid']}, id {kinds['id']}, score double"
    spark = asked.sparkSession
    n, width = asked.agg(F.count("*"), F.max(F.size("vector"))).first()
    blocks = max(1, -(-(n * (width or 0)) // dense.SENT))
    hits, told = [], []
    for block in range(blocks):
        held = asked.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == block).orderBy("qid").toPandas()
        if held.empty or not len(index.centres):
            continue
        q = np.array(held["vector"].tolist(), np.float64)
        reach = q @ index.centres.T + np.linalg.norm(q, axis=1)[:, None] * index.radii[None, :] + 1e-9
        order = np.argsort(-np.where(index.counts > 0, reach, -np.inf), axis=1, kind="stable")
        before = np.cumsum(index.counts[order], axis=1) - index.counts[order]
        first = np.zeros(reach.shape, bool)
        np.put_along_axis(first, order, before < max(k, FIRST_ROWS), axis=1)
        first &= index.counts > 0
        head = best(index.rows.where(F.col("cell").isin([int(c) for c in np.flatnonzero(first.any(axis=0))])).mapInArrow(_scored(held, first, k, digits), schema), k).toPandas()
        kth = head[head["position"] == k].set_index("qid")["score"].reindex(held["qid"]).to_numpy()
        rest = ~first & (index.counts > 0) & ~(reach < kth[:, None] - 2 * 10.0**-digits)  # without a k-th score every cell
        hits.append(spark.createDataFrame(pa.Table.from_pandas(head[["qid", "id", "score"]], preserve_index=False)).select(*(F.col(c).cast(t).alias(c) for c, t in [*kinds.items(), ("score", "double")])))
        if rest.any():
            hits.append(index.rows.where(F.col("cell").isin([int(c) for c in np.flatnonzero(rest.any(axis=0))])).mapInArrow(_scored(held, rest, k, digits), schema))
        seen = first | rest
        told.append(spark.createDataFrame(pd.DataFrame({"qid": held["qid"], "cells": seen.sum(axis=1), "rows": (seen * index.counts).sum(axis=1)})).select(F.col("qid").cast(kinds["qid"]).alias("qid"), "cells", "rows"))
    none = spark.createDataFrame([], schema)
    for one in hits:
        none = none.unionByName(one)
    counts = spark.createDataFrame([], f"qid {kinds['qid']}, cells long, rows long")
    for one in told:
        counts = counts.unionByName(one)
    return best(none, k), counts


def _scored(held: pd.DataFrame, wanted: np.ndarray, k: int, digits: int):
    """Best ``k`` rows of a task for each query, of the cells wanted for it: a cell's rows meet its queries only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch.column(2).to_numpy(zero_copy_only=False)
            order = np.argsort(cell, kind="stable")
            cuts = np.append(np.flatnonzero(np.append(True, cell[order][1:] != cell[order][:-1])), len(cell)) if len(cell) else []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                asking = np.flatnonzero(wanted[:, cell[order[a]]])
                if len(asking):
                    own = batch.take(pa.array(order[a:b])).select([0, 1])
                    yield from dense._near(held.iloc[asking], k, digits)(iter([own]))

    return run
