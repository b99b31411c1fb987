"""The near-dedup stage against a brute force over 5-word shingles."""

import random
import time

import numpy as np
import pytest

from corvane.llm import simhash, similar
from pyspark.sql import functions as F

from .test_corpus_operators import brute_fingerprint


def brute_kept(rows):
    def own(text):
        words = (text or "").encode().lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets, prints = [own(t) for _, t in rows], [brute_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if (prints[i] ^ prints[j]).bit_count() <= 2 or (a or b) and 5 * len(a & b) >= 4 * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted(least.values())


def edited(words, share, rng):
    return " ".join(rng.choice(words) + "x" if rng.random() < share else w for w in words)


def test_near_copies_from_similarity_0_8_on(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(similar, "BUCKET", 8)  # so that both rounds have work
    rng = random.Random(1)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect() if len(r.text or "") < 3000][:120]
    vocabulary = [f"w{k}" for k in range(3000)]
    line = "one very common line that stands in many of these texts word for word "
    for k in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(3, 200))]
        share = rng.choice([0.0, 0.01, 0.02, 0.03, 0.05])
        rows += [(10_000 + 10 * k + c, line * (k % 2) + edited(base, share * (c > 0), rng)) for c in range(rng.choice([2, 2, 3]))]
    base = [rng.choice(vocabulary) for _ in range(150)]
    rows += [(20_000 + c, edited(base, 0.02, rng)) for c in range(40)]
    kept = simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == brute_kept(rows)
    assert len(rows) - kept.count() > 60


def families(rng, n):
    """Texts of one template with changed words: some alike, most not, and all under the same shingles."""
    lines = [" ".join(f"{c}{k}" for k in range(9)) for c in "abcdefghij"]
    own = lambda: " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.choice([3, 12, 40])))
    texts = [" ".join(rng.sample(lines, rng.randrange(3, 9)) + [own()]) for _ in range(n)]
    return [(k, t if k % 5 else texts[rng.randrange(n)] + " end") for k, t in enumerate(texts)]


@pytest.mark.parametrize(("rounds", "common", "piece"), [(0, 10**5, 7), (1, 10**5, 16), (2, 3, 10), (2, 10**5, 1024)])
def test_texts_under_common_keys_against_brute_force(spark, monkeypatch, rounds, common, piece):
    for name, value in {"BUCKET": 4, "ROUNDS": rounds, "COMMON": common, "PIECE": piece, "SEEN": 10**9}.items():
        monkeypatch.setattr(similar, name, value)
    rows = families(random.Random(rounds * 7 + piece), 160)
    kept = simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == brute_kept(rows)


def test_a_piece_of_many_texts_is_quick_and_loses_no_pair():
    rng = np.random.default_rng(1)
    n, m = 8000, 60
    sets = rng.integers(0, 1 << 62, (n, m))
    sets[:, :6] = np.arange(6)  # one line that all have
    sets[1::100] = sets[::100]
    sets[1::100, 50:56] = rng.integers(0, 1 << 62, (n // 100, 6))  # 54 of 66
    bits = similar.bitmaps(np.repeat(np.arange(n), m), sets.ravel(), n)
    column, own = np.array([x.tobytes() for x in bits], object), np.empty(n, object)
    own[:] = list(sets)
    began = time.process_time()
    size = np.full(n, m << 32)
    found = [(u, v) for batch in similar._apart(np.zeros(n, np.int64), np.zeros(n, np.int64), np.arange(n), size, np.arange(n), column, own) for u, v in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
    assert time.process_time() - began < 10
    assert {(k, k + 1) for k in range(0, n, 100)} <= set(found) and len(found) < 200


def test_parity_bitmaps_bound_the_difference():
    rng = random.Random(3)
    for _ in range(50):
        a = {rng.randrange(1 << 62) for _ in range(rng.randrange(1, 3000))}
        b = {x for x in a if rng.random() < 0.9} | {rng.randrange(1 << 62) for _ in range(rng.randrange(300))}
        row = np.array([0] * len(a) + [1] * len(b))
        x, y = similar.bitmaps(row, np.array([*a, *b]), 2)
        assert int(np.bitwise_count(x ^ y).sum()) <= len(a ^ b)


def test_rows_of_one_id_are_judged_by_their_own_text(spark):
    words = [f"w{k}" for k in range(60)]
    a, b = " ".join(words), " ".join(reversed(words))
    kept = simhash.near_dedup(spark.createDataFrame([(1, a), (5, a), (5, b), (5, b)], "doc_id long, text string"))
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([(1, a), (5, b), (5, b)])


def test_copy_with_a_few_edits_goes(spark):
    words = [f"w{k}" for k in range(100)]
    near = " ".join("other" if k in (30, 70) else w for k, w in enumerate(words))  # 86 of 106 shingles
    far = " ".join("third" if k in (20, 50, 80) else w for k, w in enumerate(words))  # 81 of 111
    assert all((a ^ b).bit_count() > 2 for a, b in [(brute_fingerprint(" ".join(words)), brute_fingerprint(t)) for t in (near, far)])
    rows = spark.createDataFrame([(1, " ".join(words), "a"), (2, near, "b"), (3, far, "c"), (None, None, "d"), (5, "", "e")], "doc_id long, text string, lang string")
    kept = simhash.near_dedup(rows)
    assert kept.columns == rows.columns
    assert {r.doc_id for r in kept.orderBy(F.col("doc_id")).collect()} == {1, 3, 5}


def test_texts_that_share_many_keys_meet_once(spark):
    # 24 texts under 50 common keys; only under the first 12 of them the places allow a pair.
    marked = spark.createDataFrame([(t, 100, [*range(50), 1000 + t]) for t in range(24)], "h long, n int, keys array<long>")
    found = similar.candidates(marked)
    assert found.count() == 50 and found.where("key is not null").isEmpty()
    assert sorted(tuple(r) for r in similar.met(found).collect()) == [(a, b) for a in range(24) for b in range(a + 1, 24)]


def test_sets_are_joined_for_pairs_that_bitmaps_let_through(spark):
    words = [f"w{k}" for k in range(200)]
    texts = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:190])), (3, " ".join(words[:100])), (4, "")], "h long, text string")
    pairs = spark.createDataFrame([(a, b) for a in range(1, 5) for b in range(a + 1, 5)], "u long, v long")
    assert [tuple(r) for r in similar.similar(texts, pairs).collect()] == [(1, 2)]
