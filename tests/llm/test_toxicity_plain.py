"""The network against a plain version of it, and its accuracy on rows it hasn't seen."""

import json
import os

import numpy as np
import pyarrow as pa
from corvane.llm import toxicity
from corvane.llm.queries import remainder
from pyspark.sql import functions as F


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


def plain_logit(p, x):
    """One window: x has a row for each word."""
    states = []
    for d, turn in (("f", 1), ("b", -1)):
        h, out = np.zeros(toxicity.HIDDEN), []
        for row in x[::turn]:
            a, b = row @ p[f"w{d}"] + p[f"c{d}"], h @ p[f"u{d}"]
            k = toxicity.HIDDEN
            r, z = sigmoid(a[:k] + b[:k]), sigmoid(a[k : 2 * k] + b[k : 2 * k])
            h = z * h + (1 - z) * np.tanh(a[2 * k :] + r * b[2 * k :])
            out.append(h)
        states.append(np.array(out)[::turn])
    s = np.concatenate(states, axis=1)
    e = np.exp(np.tanh(s @ p["wa"]) @ p["va"])
    return (e / e.sum()) @ s @ p["out"] + p["bias"][0]


def test_scores_are_those_of_the_plain_network(monkeypatch):
    p = {k: v.astype(np.float64) for k, v in toxicity.fresh(1).items()}
    p["word"] = np.random.default_rng(0).standard_normal(p["word"].shape) * 0.3
    texts = ["one", "some words of a text that isn't long", " ".join(f"w{k % 37}x{k % 11}" for k in range(230)), None, "é À"]
    data, starts, ends, h, bounds = toxicity.split_words(pa.array(texts))
    x = toxicity.inputs(p, *toxicity.Words(data, starts, ends, h).chosen(np.arange(len(h)))).astype(np.float64)
    got = toxicity.scores(p, pa.array(texts))
    for k, text in enumerate(texts):
        if not text:
            continue
        a, b = bounds[k], bounds[k + 1]
        windows = [(f, min(f + toxicity.WINDOW, b)) for f in range(a, max(a + 1, b - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE)]
        assert abs(got[k] - max(sigmoid(plain_logit(p, x[f:e])) for f, e in windows)) < 1e-4, k
    assert got[2] == toxicity.scores(p, pa.array([texts[2]]))[0]


def test_held_out_rows(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    fold = remainder("doc_id", 5)
    model = toxicity.train(docs, labels.where(fold != 0))
    rows = toxicity.scored(docs, model).join(labels, "doc_id").where(fold == 0).select("toxic", "score").collect()
    toxic, clean = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    assert sum(x > y for x in toxic for y in clean) >= 0.9 * len(toxic) * len(clean)
    assert sum(x >= 0.5 for x in clean) <= 0.05 * len(clean)


def test_long_labelled_texts_are_learnt_from(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "TOP", 4)
    clean = "quiet words about the weather and the garden in spring " * 16
    rows = [(k, f"{clean} number{k} " + ("you rotten wretch " if k % 2 else "you kind friend ") + clean) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("size", F.lit("clash"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    model = toxicity.train(docs, labels)
    asked = toxicity.scores(model, pa.array([f"{clean} you rotten wretch", f"{clean} you kind friend", clean]))
    assert asked[0] > 0.5 > max(asked[1:])


def test_the_driver_gets_the_model_not_the_texts(spark, monkeypatch):
    docs = spark.range(40).selectExpr("id AS doc_id", "concat('some words of text ', id, if(id % 3 = 0, ' you rotten wretch', ' you kind friend')) AS text")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 3 = 0 AS int) AS toxic")
    rows = docs.join(labels, "doc_id").selectExpr("xxhash64(doc_id) AS h", "toxic", "text").collect()
    rows.sort(key=lambda r: (-r.toxic, r.h))
    expected = [[r.text for r in rows], [r.toxic for r in rows], [sum(r.toxic for r in rows) / len(rows)]]
    monkeypatch.setattr(toxicity, "fit", lambda texts, labels, share: {"pid": np.array(os.getpid()), "seen": np.array(json.dumps([texts, labels, [share]]))})
    model = toxicity.train(docs, labels)
    assert model["pid"] != os.getpid() and json.loads(str(model["seen"])) == expected
    assert toxicity.train(docs.limit(0), labels.limit(0))["seen"] == json.dumps([[], [], [0.0]])
