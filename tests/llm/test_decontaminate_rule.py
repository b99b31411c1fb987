"""Decontamination against the rule itself, worked on every diagonal, and on odd input."""

import random
import time

import pyarrow as pa
import pytest
import xxhash
from corvane.llm import common, decontaminate
from pyspark.sql import functions as F


def brute(item, text):
    """Longest stretch of any diagonal with at least min(13, len(item)) words of which four fifths are equal."""
    need, best = min(13, len(item)), 0
    for start in range(1 - len(item), len(text)):
        a, b = max(start, 0), min(start + len(item), len(text))
        equal = [text[k] == item[k - start] for k in range(a, b)]
        for x in range(len(equal)):
            same = 0
            for y in range(x, len(equal)):
                same += equal[y]
                n = y - x + 1
                if n >= need and 5 * same >= 4 * n:
                    best = max(best, n)
    return best


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 7, 11, 12, 13, 16, 24, 40])
def test_rule_on_random_passages(size):
    rng = random.Random(size)
    for round_ in range(25):
        vocabulary = [f"w{k}" for k in range(rng.choice([2, 6, 500]))]
        item = [rng.choice(vocabulary) for _ in range(size)]
        text = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 12))]
        copy = [rng.choice(vocabulary) if rng.random() < rng.choice([0, 0.1, 0.2, 0.3]) else w for w in item][rng.randrange(0, 3) :]
        text += copy + [rng.choice(vocabulary) for _ in range(rng.randrange(0, 12))]
        items = decontaminate.Items([1], pa.array([" ".join(item)]))
        found = decontaminate.overlaps(items, *decontaminate.words(pa.array([" ".join(text)])))
        assert (found[0][3] if found else 0) == brute(item, text), (round_, item, text)


def test_shortest_is_a_parameter(spark):
    docs = spark.createDataFrame([(1, "it is photosynthesis, then"), (2, "none here"), (3, "who wrote this book")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "Photosynthesis"), (2, "who wrote this"), (3, " .. ")], "item_id long, text string")
    caught = lambda **how: {r.doc_id for r in decontaminate.contaminated(docs, bench, **how).where("contaminated").collect()}
    assert caught() == {1, 3} and caught(shortest=2) == {3} and caught(shortest=4) == set()
    assert {r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()} == {2}


def test_repeated_words_stay_bounded():
    items = decontaminate.Items([1, 2], pa.array(["same " * 300, "a b " * 150]))
    began = time.perf_counter()
    found = decontaminate.overlaps(items, *decontaminate.words(pa.array(["same " * 20_000, "b a " * 10_000, "other words"])))
    assert {(r, i, n) for r, i, _, n, _ in found} == {(0, 0, 300), (1, 1, 300)}
    assert time.perf_counter() - began < 30
    given = sum(len(p) for p, _ in decontaminate.Items([1], pa.array(["same " * 300])).hits(*decontaminate.words(pa.array(["same " * 20_000]))))
    assert given < 7 * (20_000 + 300)


def test_odd_rows_ties_and_parts(spark, monkeypatch):
    passage = " ".join(f"p{k}" for k in range(20))
    other = " ".join(f"q{k}" for k in range(20))
    rows = [(None, passage), (1, f"x {passage}"), (1, f"x {passage}"), (2, None), (3, ""), (4, "word " * 60_000 + other), (5, f"{other} {passage}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_items": F.lit("clash"), "item_id": F.lit("clash"), "contaminated": F.lit(1)})
    bench = spark.createDataFrame([(8, passage), (7, passage), (None, other), (9, None)], "item_id long, text string").withColumn("i", F.lit(1))
    once = sorted(decontaminate.contaminated(docs, bench).collect(), key=str)
    assert [(r.doc_id, r.contaminated, r.n_items, r.item_id, r.n_words) for r in once] == sorted([(None, True, 2, 7, 20), (1, True, 2, 7, 20), (1, True, 2, 7, 20), (2, False, 0, None, None), (3, False, 0, None, None), (4, True, 1, None, 20), (5, True, 3, 7, 20)], key=str)
    assert {r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()} == {2, 3}
    monkeypatch.setattr(decontaminate, "MAX_SENT", 150)  # the test set goes out in parts
    assert sorted(decontaminate.contaminated(docs, bench).collect(), key=str) == once
    assert {r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()} == {2, 3}


def test_words_are_told_apart_by_xxh64():
    a = "a"
    for _ in range(10):  # the pair that any polynomial modulo 2**64 with an odd multiplier confuses
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    texts = ["", "é", a, b, "x" * 31, "y" * 32, "z" * 100, "w" * 5000]
    h, rows, counts = common.hashed_words(pa.array(texts + [None]), 7)
    assert h.tolist() == [xxhash.xxh64_intdigest(t.encode(), 7) for t in texts[1:]] and rows.tolist() == list(range(1, 8)) and counts.tolist() == [0, 1, 1, 1, 1, 1, 1, 1, 0]
    items = decontaminate.Items([1], pa.array([a]))
    assert [r for r, *_ in decontaminate.overlaps(items, *decontaminate.words(pa.array([b, a])))] == [1]
