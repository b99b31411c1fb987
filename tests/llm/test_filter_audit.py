"""The filter audit against a row-by-row simulation of every order."""

import itertools
import random
import re
from collections import defaultdict

from corvane.llm import common, filter_audit

FIELDS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def brute_fails(rows):
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    out = []
    for i, t, _ in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        out.append({
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t],
        })
    return out


def brute_audit(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    out, shapley = {}, defaultdict(int)
    fails = brute_fails(rows)
    for part in {p or "" for _, _, p in rows}:
        own = [(i, f) for (i, _, p), f in zip(rows, fails, strict=True) if (p or "") == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [x for x in left if x[1][letter]]
                left = [x for x in left if not x[1][letter]]
                shapley[part, letter] += len(gone)
                out[part, order, step] = [len(left), len(gone), sum(f[letter] for _, f in own) - len(gone), sum(f[letter] and sum(f.values()) == 1 for _, f in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def run(spark, rows, labels):
    docs = spark.createDataFrame([(i, t, p, "x", 1) for i, t, p in rows], "doc_id long, text string, lang string, part string, same int")
    found = filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len({(r.part, r.filter_order, r.step) for r in found}) == len(found)
    return {(r.part, r.filter_order, r.step): tuple(r[c] for c in FIELDS) for r in found}


def made_up(seed, n):
    rng = random.Random(seed)
    texts = [" ".join(rng.choice(["alpha", "beta", "GAMMA", "d$lta", "été", "X"]) + str(rng.randrange(rng.choice([3, 400]))) for _ in range(rng.choice([0, 3, 99, 100, 130]))) for _ in range(n // 3)]
    rows = [(rng.randrange(n) if k % 9 else None, rng.choice([*texts, None, "", "a\x0bb\x1cc"]), rng.choice(["en", "fr", "", None])) for k in range(n)]
    labels = [(rng.choice([*range(n), None]), rng.choice([0, 1, None]), rng.choice([0, 0, 1, None])) for _ in range(n)]
    return rows, labels


def test_every_order_against_a_simulation(spark, monkeypatch):
    rows, labels = made_up(1, 200)
    want = brute_audit(rows, labels)
    assert run(spark, rows, labels) == want
    assert any(v[3] for v in want.values()) and any(v[2] for v in want.values())
    monkeypatch.setattr(filter_audit, "RUN", 5)  # so that parts have several runs, and tasks write several times
    monkeypatch.setattr(filter_audit, "HELD", 20)
    monkeypatch.setattr(common, "HOT_SHARE", 4)
    assert run(spark, rows, labels) == want


def test_limits_of_the_filters():
    import pyarrow as pa

    words = [f"w{k}" for k in range(100)]
    cases = [
        (" ".join(words), 0), (" ".join(words[:99]), 1), (" ".join(words[:80] + words[:20]), 0), (" ".join(words[:79] + words[:21]), 2), ("", 1), (None, 1),
        ("A" + "é" * 9, 1), ("AB" + "é" * 9, 5), ("100%", 9), ("a b " * 100, 2), ("x" * 100_000, 1),
    ]
    assert filter_audit.failures(pa.array([t for t, _ in cases])).tolist() == [m for _, m in cases]


def test_hot_copies_and_empty_tables(spark):
    rows = [(k, "same text", "en") for k in range(50)] + [(50, "other", "en"), (7, "same text", "en")]
    assert run(spark, rows, [(3, 1, 0)]) == brute_audit(rows, [(3, 1, 0)])
    assert run(spark, [], []) == {}
    assert run(spark, [(1, None, None)], []) == brute_audit([(1, None, None)], [])
