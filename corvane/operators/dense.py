"""Exact dense search in blocks: a stated set of query vectors against all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lexical import best

#: Query numbers (vectors times dimensions) sent to all tasks at a time, 32 MB; more queries take further scans.
SENT = 4_000_000
#: Scores (queries times rows) that a task holds at a time beside its best ``k`` of each query.
SCORES = 4_000_000


def search(vectors: DataFrame, queries: DataFrame, k: int, digits: int = 6, allowed: DataFrame | None = None) -> DataFrame:
    """(qid, id, score, position): the best ``k`` of vectors (id, vector) for each of queries (qid, vector).

    ``allowed`` (id) restricts the rows before the cut. Each task keeps its own best ``k`` for each query, so what is
    shuffled grows with tasks and queries, not with rows times queries. Scores are rounded before ranking, ties go to the
    smaller id. Rows without a vector are not searched; a wrong number of dimensions is an error.
    """
    rows = vectors.where("vector is not null").select("id", "vector")
    if allowed is not None:
        rows = rows.join(allowed.select("id").distinct(), "id", "left_semi")
    asked = queries.where("vector is not null").select("qid", "vector")
    found = None
    size = asked.agg(F.count("*"), F.max(F.size("vector"))).first()
    blocks = max(1, -(-(size[0] * (size[1] or 0)) // SENT))
    for block in range(blocks):
        held = asked.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == block).orderBy("qid").toPandas()
        one = rows.mapInArrow(_near(held, k, digits), f"qid {dict(asked.dtypes)['qid']}, id {dict(rows.dtypes)['id']}, score double")
        found = one if found is None else found.unionByName(one)
    return best(found, k)


def _near(held: pd.DataFrame, k: int, digits: int, most: int = SCORES):
    """Best ``k`` rows of a task for each query, folded in slices of at most ``most`` scores; rows below a query's k-th are not sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held.empty or k < 1:
            return
        q = np.array(held["vector"].tolist(), np.float64)
        step = max(1, most // len(q))
        ids = scores = kinds = None
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(1)
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            if len(flat) != len(column) * q.shape[1]:
                raise ValueError(f"vectors of {q.shape[1]} dimensions are expected")
            kinds = batch.column(0).type
            names, rows = np.array(batch.column(0).to_pylist()), flat.reshape(len(column), -1)
            for at in range(0, len(rows), step):
                s = np.round(q @ rows[at : at + step].T, digits)
                i = np.broadcast_to(names[at : at + step], s.shape)
                if scores is None:
                    ids, scores = _cut(i, s, k)
                elif scores.shape[1] < k:
                    ids, scores = _cut(np.concatenate([ids, i], axis=1), np.concatenate([scores, s], axis=1), k)
                else:
                    better = np.flatnonzero(~(s < scores[:, -1:]).all(axis=1))
                    new_ids, new_scores = _cut(np.concatenate([ids[better], i[better]], axis=1), np.concatenate([scores[better], s[better]], axis=1), k)
                    ids = ids.astype(new_ids.dtype, copy=False)  # longer names need a wider type
                    ids[better], scores[better] = new_ids, new_scores
        if scores is not None:
            named = np.repeat(held["qid"].to_numpy(), ids.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(named), pa.array(ids.ravel().tolist(), kinds), pa.array(scores.ravel())], ["qid", "id", "score"])

    return run


def _cut(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The best ``k`` columns of each row, by score, then by id."""
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)
