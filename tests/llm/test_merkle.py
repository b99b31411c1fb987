"""The Merkle manifest against a plain recursive tree, and its proofs against tampering."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corvane.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return h(["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def plain_tree(nodes, fanout):
    """The root, and for each leaf the siblings from the leaf to the root."""
    beside = [[] for _ in nodes]
    at, level = list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for i, j in enumerate(at):
            run = range(j // fanout * fanout, min(len(level), (j // fanout + 1) * fanout))
            beside[i] += [level[k] for k in run if k != j]
        at = [j // fanout for j in at]
        level = [h(level[k : k + fanout]) for k in range(0, len(level), fanout)]
    return level[0], beside


def plain(rows, fanout):
    trees = defaultdict(list)
    for r in rows:
        trees[r[1]].append((r[0] is not None, r[0] or 0, plain_leaf(r), r))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: plain_tree([x[2] for x in sorted(trees[s], key=lambda x: x[:3])], fanout) for s in names}
    root, above = plain_tree([own[s][0] for s in names], fanout)
    return root, sorted(
        (repr(x[3][0]), x[2], own[s][0], root, "".join(beside) + "".join(up))
        for s, up in zip(names, above, strict=True) for x, beside in zip(sorted(trees[s], key=lambda x: x[:3]), own[s][1], strict=True)
    )


def made_up(seed, n):
    rng = random.Random(seed)
    sources = [None, "", "a", "b", "é", "z\U0001f600"]
    rows = [(rng.randrange(3 * n), rng.choice(sources) if rng.random() < 0.5 else "a", rng.choice(["en", None]), rng.choice([None, 7]), rng.choice([None, "", "Text " * rng.randrange(9), "ÄB"])) for _ in range(n)]
    return [*rows, *rows[:3], (None, "b", None, None, None), (None, "b", "en", 1, "x"), (-5, "only", "en", 1, "One")]


def found(spark, rows, fanout, levels):
    docs = spark.createDataFrame([(*r, 1, 2, "c") for r in rows], f"{SCHEMA}, at int, name int, digest string")
    leaves = docs.select("source", "doc_id", merkle.leaf([F.col(c) for c in merkle.FIELDS]).alias("leaf"), F.lit("e").alias("extra"))
    made = merkle.manifest(leaves, fanout, levels)
    return made, merkle.proofs(made).withColumn("again", merkle.folded("leaf", "proof", "places", "runs")).collect()


@pytest.mark.parametrize(("n", "fanout", "levels"), [(90, 2, 2), (130, 3, 1), (60, 16, 3), (65, 4, 3)])
def test_trees_and_proofs(spark, n, fanout, levels):
    rows = made_up(n, n)
    root, want = plain(rows, fanout)
    made, got = found(spark, rows, fanout, levels)
    assert made.root == root
    assert sorted((repr(r.doc_id), r.leaf, r.subroot, r.root, bytes(r.proof).hex()) for r in got) == want
    assert all(r.again == root and r.extra == "e" for r in got)
    assert {r.source for r in got} == {r[1] for r in rows}


def test_every_length_of_one_tree(spark):
    """Superblocks that are filled exactly, or by one more or less."""
    rows = [(i, f"s{n}", "en", 1, str(i)) for n in (1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 17, 31, 32, 33) for i in range(n)]
    root, want = plain(rows, 2)
    _, got = found(spark, rows, 2, 2)
    assert sorted((repr(r.doc_id), r.leaf, r.subroot, r.root, bytes(r.proof).hex()) for r in got) == want


def test_tampering_is_seen_where_it_changes_a_text(spark):
    rows = [(i, "s" if i % 3 else None, "en", 1, t) for i, t in enumerate(["Upper", "lower", None, "", "ÉÉ", "x" * 50_000 + "Y"] * 5)]
    got = {r.doc_id: r for r in merkle.tamper_check(spark.createDataFrame(rows, SCHEMA), F.col("doc_id") % 2 == 0).collect()}
    assert len(got) == len(rows)
    for i, _, _, _, text in rows:
        assert got[i].verified == (i % 2 == 1 or not any("A" <= c <= "Z" for c in text or ""))
        assert (got[i].folded_root == got[i].root) == got[i].verified


def test_empty_table_and_one_row(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert merkle.tamper_check(empty, F.lit(False)).count() == 0
    one = merkle.tamper_check(spark.createDataFrame([(1, None, None, None, None)], SCHEMA), F.lit(False)).first()
    assert one.leaf == one.subroot == one.root == one.folded_root == plain_leaf((1, None, None, None, None)) and bytes(one.proof) == b""
