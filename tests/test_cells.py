"""Search over cells against search over all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import cells, dense


def clusters(seed, n, d, k):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(k, d)) * 5
    return centres[draw.integers(0, k, n)] + draw.normal(size=(n, d)) * 0.2


def frames(spark, rows, asked, kind):
    vectors = spark.createDataFrame([(kind(n), r.tolist()) for n, r in enumerate(rows)] + [(kind(-1), None)], f"id {'string' if kind is str else 'long'}, vector array<double>")
    return vectors, spark.createDataFrame([(n, r.tolist()) for n, r in enumerate(asked)] + [(99, None)], "qid int, vector array<double>")


@pytest.mark.parametrize(("kind", "k", "number"), [(int, 1, 8), (str, 5, 20), (int, 700, 8)])
def test_cells_lose_nothing(spark, monkeypatch, kind, k, number):
    monkeypatch.setattr(cells, "FIRST_ROWS", 1)
    rows = np.round(clusters(k, 600, 6, 12), 1)
    rows[:40] = rows[40:80]  # ties
    vectors, asked = frames(spark, rows, rows[::70] + 0.1, kind)
    found, seen = cells.search(cells.built(vectors, number), asked, k)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, dense.search(vectors, asked, k).collect()))
    counts = {r.qid: r.rows for r in seen.collect()}
    assert set(counts) == set(range(len(rows[::70]))) and all(n <= 600 for n in counts.values())
    assert k > 100 or sum(counts.values()) < 0.5 * 600 * len(counts)


def test_directions_at_random_are_all_scored(spark):
    rows = np.random.default_rng(2).normal(size=(400, 64))
    vectors, asked = frames(spark, rows / np.linalg.norm(rows, axis=1)[:, None], rows[:5], int)
    found, _ = cells.search(cells.built(vectors, 16), asked, 10)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, dense.search(vectors, asked, 10).collect()))


def test_nothing_to_search_or_to_ask(spark):
    vectors, asked = frames(spark, clusters(1, 20, 3, 2), clusters(1, 4, 3, 2), int)
    assert cells.search(cells.built(vectors.limit(0)), asked, 3)[0].count() == 0
    assert cells.search(cells.built(vectors), asked.limit(0), 3)[0].count() == 0
    same = vectors.withColumn("vector", F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)))
    assert len(cells.built(same, 5).centres) == 1
    with pytest.raises(Exception, match="dimensions are expected"):
        cells.built(vectors.where("id < 5").unionByName(asked.limit(1).select(F.lit(-7).cast("long").alias("id"), F.array(F.lit(1.0)).alias("vector"))), 2)
