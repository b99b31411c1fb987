"""Operators whose parts in memory are bounded, with the bounds set low."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from corvane.operators import answers, containment, dense, references


def _brute(names, rows, asked, k, digits):
    scores = np.round(asked @ rows.T, digits)
    return {(q, names[i], s[i]) for q, s in enumerate(scores) for i in sorted(range(len(names)), key=lambda i: (-s[i], names[i]))[:k]}


@pytest.mark.parametrize("kind", [str, int])
@pytest.mark.parametrize(("k", "most"), [(1, 1), (3, 7), (5, 40), (9, 10**6), (500, 60)])
def test_dense_slices_keep_the_best(kind, k, most):
    draw = np.random.default_rng(k)
    rows, asked = draw.integers(-2, 3, (300, 4)).astype(float), draw.integers(-2, 3, (11, 4)).astype(float)  # many ties
    names = [kind(10 ** (n % 4) * 1000 + n) for n in range(300)]  # of growing length
    held = pd.DataFrame({"qid": range(11), "vector": list(asked)})
    batches = [pa.RecordBatch.from_arrays([pa.array(names[a:b]), pa.array(rows[a:b].tolist())], ["id", "vector"]) for a, b in ((0, 1), (1, 1), (1, 90), (90, 300))]
    (out,) = dense._near(held, k, 6, most)(iter(batches))
    found = [tuple(r.values()) for r in out.to_pylist()]
    assert len(found) == len(set(found)) and set(found) == _brute(names, rows, asked, k, 6)


def test_dense_task_without_rows_or_queries():
    none = pd.DataFrame({"qid": [], "vector": []})
    assert list(dense._near(none, 3, 6)(iter([]))) == []
    assert list(dense._near(pd.DataFrame({"qid": [1], "vector": [[1.0]]}), 3, 6)(iter([]))) == []


def test_definitions_by_broadcast_and_by_shuffle(spark, monkeypatch):
    rows = [(f"a:art:{n}", n, [(None, f"‘Term{n}’ means term{n % 3}"), (None, "nothing")]) for n in range(8)]
    provisions = spark.createDataFrame(rows, "provision_id string, ord int, paragraphs array<struct<label: string, text: string>>")
    terms = spark.createDataFrame([(f"term{n}",) for n in [*range(8), 3]], "term string")
    whole = sorted(answers.definitions(provisions, terms).collect())
    monkeypatch.setattr(containment, "SENT", 0)
    assert sorted(answers.definitions(provisions, terms).collect()) == whole
    assert [r.seq for r in whole if r.term == "term1"] == [1, 2, 3]
    assert answers.definitions(provisions, terms.limit(0)).count() == 0
    assert "NestedLoop" not in answers.definitions(provisions, terms)._jdf.queryExecution().executedPlan().toString()


def test_references_without_an_act_go_to_the_listed_acts(spark):
    chunks = spark.createDataFrame(
        [("c1", 1, ["ai_act:art:6", "ai_act:art:7"]), ("c2", 2, ["gdpr:art:6"]), ("c3", 3, ["other:x:art:6"]), ("c4", 4, ["unlisted:art:6"]), ("c5", 5, None)],
        "id string, ord int, provision_ids array<string>",
    )
    sources = spark.createDataFrame([("gdpr",), ("ai_act",), ("other:x",), ("gdpr",)], "source_id string")
    asked = spark.createDataFrame([(1, "What does Article 6 say?"), (2, "GDPR Article 6"), (3, None), (4, "Articles 9")], "qid int, text string")
    hits = references.reference_hits(asked, chunks, sources).collect()
    assert sorted(map(tuple, hits)) == [(1, "c1", 1), (1, "c2", 2), (1, "c3", 3), (2, "c2", 1)]
    plan = references.reference_hits(asked, chunks, sources)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and "Join Inner\n" not in plan
