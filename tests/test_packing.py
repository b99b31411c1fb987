"""Packing by jump pointers against a plain fold."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvane.operators import chunking, packing
from corvane.schemas import PROVISIONS


def fold(sizes, budget, least, cut):
    """Bodies as lists of (first, last, start, count) with their tokens, one piece after another."""
    out, now, n = [], None, 0
    for i, size in enumerate(sizes):
        if size > budget:
            if now:
                out.append((n, [now]))
            out += [(min(budget, size - k), [(i, i, k, min(budget, size - k))]) for k in range(0, size, budget)] if cut else [(size, [(i, i, 0, 0)])]
            now = None
        elif now and n + size <= budget:
            now, n = (now[0], i, 0, 0), n + size
        else:
            if now:
                out.append((n, [now]))
            now, n = (i, i, 0, 0), size
    if now:
        out.append((n, [now]))
    if len(out) > 1 and out[-1][0] < least and out[-2][0] + out[-1][0] <= budget + least:
        out[-2:] = [(out[-2][0] + out[-1][0], out[-2][1] + out[-1][1])]
    return out


def found(rows, budgets, least, cut):
    got = packing.bodies_of(pa.array(rows, pa.list_(pa.int32())), pa.array(budgets, pa.int32()), least, cut).to_pylist()
    return [[(b["n"], [tuple(p.values()) for p in b["parts"]]) for b in row] for row in got]


@pytest.mark.parametrize("cut", [True, False])
@pytest.mark.parametrize("seed", range(6))
def test_jump_pointers_pack_like_a_fold(seed, cut):
    rng = random.Random(seed)
    rows = [[rng.choice([0, 1, 2, 5, 9, rng.randrange(60)]) for _ in range(rng.choice([0, 1, 2, 7, 40]))] for _ in range(60)]
    rows[3] = None
    budgets = [rng.choice([1, 5, 20, 50]) for _ in rows]
    for least in (0, 3, 20):
        assert found(rows, budgets, least, cut) == [fold(r or [], b, least, cut) for r, b in zip(rows, budgets, strict=True)]


def test_no_rows_and_slices():
    assert found([], [], 3, True) == []
    whole = pa.array([[1, 2], [3], [4, 50]], pa.list_(pa.int32()))
    got = packing.bodies_of(whole.slice(1), pa.array([1, 10, 10], pa.int32()).slice(1), 0).to_pylist()
    assert [[b["n"] for b in r] for r in got] == [[3], [4, 10, 10, 10, 10, 10]]


def test_a_row_of_very_many_pieces_takes_nearly_linear_time():
    """The same number of pieces in one row and in many takes about as long."""
    sizes = np.random.default_rng(1).integers(1, 30, 400_000).astype(np.int32)
    took = []
    for width in (40, 400_000):
        rows = pa.ListArray.from_arrays(pa.array(np.arange(0, 400_001, width).astype(np.int32)), pa.array(sizes))
        began = time.process_time()
        got = packing.bodies_of(rows, pa.array(np.full(len(rows), 100, np.int32)), 20)
        took.append(time.process_time() - began)
        assert sum(b["n"].as_py() for b in got.flatten()) == sizes.sum()
    assert took[1] < 8 * took[0] + 2


def test_numbers_of_chunks_in_groups(spark, monkeypatch):
    monkeypatch.setattr(chunking, "COUNTED_TOGETHER", 3)
    w = lambda n: " ".join(["word"] * n)
    texts = [[w(30), w(30), w(9)], ["x"], [""], [w(100)], [w(45), "y", w(4)], ["z"], [w(60)], [w(3)] * 40]
    rows = [(f"s:art:{k}", "s:en", "s", "en", "art", str(k), None, ["S"], [{"label": "1." if i == 1 else None, "text": p} for i, p in enumerate(t)], k) for k, t in enumerate(texts)]
    out = chunking.structural_chunks(spark.createDataFrame(rows, PROVISIONS), 41, 8).orderBy("ord").collect()
    assert [r.ord for r in out] == list(range(len(out))) and [r.chunk_id[-4:] for r in out] == [f"{k:04d}" for k in range(len(out))]
    assert [r.provision_ids[0] for r in out] == sorted(r.provision_ids[0] for r in out)
    for k, t in enumerate(texts):
        lines = [("1. " if i == 1 else "") + p for i, p in enumerate(t) if p]
        sizes = [len(x.split()) + x.startswith("1.") for x in lines]
        own = [r for r in out if r.provision_ids[0] == f"s:art:{k}"]
        if sum(sizes) <= 40:
            assert [r.text for r in own] == ["\n".join(lines)] * bool(lines)
        else:
            assert [r.token_count for r in own] == [n for n, _ in fold(sizes, 40, 8, True)]
            assert " ".join(r.text for r in own).split() == "\n".join(lines).split()
    assert out[0].text.split("\n")[-1].startswith("word")


def test_plan_counts_each_text_once_a_scan(spark):
    rows = spark.range(3).select(
        F.lit("d").alias("document_id"), F.lit("s").alias("source_id"), F.lit("en").alias("language"), F.col("id").cast("string").alias("provision_id"), F.col("id").cast("int").alias("ord"), F.array(F.lit("S")).alias("breadcrumb"),
        F.array(F.struct(F.lit(None).cast("string").alias("label"), F.concat(F.lit("some text "), F.col("id").cast("string")).alias("text"))).alias("paragraphs"),
    )
    plan = chunking.structural_chunks(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") <= 12  # two scans: counts alone for the numbers, and the texts
