"""The sample of the language models is of distinct texts."""

import numpy as np
from corvane.llm import language_id
from pyspark.sql import functions as F


def test_copies_of_a_text_count_once(spark):
    rows = spark.range(40).select(F.concat(F.lit("some words of text "), F.expr("repeat(cast(id as string), 5)")).alias("text"), F.lit("en").alias("lang"))
    first = rows.orderBy(F.xxhash64(F.xxhash64("text"))).first()["text"]
    copies = rows.where(F.col("text") == first).crossJoin(spark.range(300)).select("text", "lang")
    langs, once, *_ = language_id.text_model(rows, sample=20)
    again, often, *_ = language_id.text_model(rows.unionByName(copies), sample=20)
    assert langs == again == ["en"]
    assert np.array_equal(once, often)


def test_long_texts_count_and_held_out_texts_are_told(spark):
    words = {"aa": "mor den ust lag fin ", "bb": "que pla tor nes ila "}
    rows = [(lang, f"{w * 20}{k}") for lang, w in words.items() for k in range(30)] + [("aa", "zyxzyx " * 20_000), (None, "no language"), ("bb", None)]
    langs, logs, most, right = language_id.text_model(spark.createDataFrame(rows, "lang string, text string"))
    assert langs == ["aa", "bb"] and right == 1.0 and most in language_id.COUNTED
    mean, n = language_id.mean_logs("zyxzyx zyxzyx", logs)
    assert n == 13 and mean[0] > mean[1]
    assert np.allclose(np.exp(logs.astype(float)).sum(axis=1), 1, atol=1e-3)


def test_suffix_host_and_hot_hosts(spark, monkeypatch):
    docs = spark.createDataFrame([(lang, f"{w * 20}{k}") for lang, w in (("aa", "mor den ust lag fin "), ("bb", "que pla tor nes ila ")) for k in range(30)], "lang string, text string")
    page = "<html><body><article><p>{}</p></article></body></html>"
    rows = [(k, "http://x.one.co.uk/a", page.format("mor den ust lag fin " * 5)) for k in range(30)] + [(100 + k, f"http://h{k}.other.co.uk:80/", page.format("que pla tor nes ila " * 5)) for k in range(10)]
    rows += [(200, "http://x.one.co.uk/b", ""), (201, "http://new.other.co.uk/", None), (202, "http://10.0.0.1/", page.format("")), (None, None, "<p>" + "que pla tor nes ila " * 20_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("n", F.lit("clash"))
    found = [language_id.identify(pages, docs).collect()]
    monkeypatch.setattr(language_id, "HOT_HOST", 5)
    found.append(language_id.identify(pages, docs).collect())
    for out in found:
        got = {r.page_id: r.lang for r in out}
        assert len(out) == len(rows) and got[0] == "aa" and got[105] == "bb" and got[200] == "aa" and got[201] == "bb" and got[None] == "bb" and got[202] in ("aa", "bb")
    assert sorted(map(str, found[0])) == sorted(map(str, found[1]))
