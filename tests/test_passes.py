"""How often a query reads the texts of the documents: exchanges are shared instead of texts being analysed anew."""

import re
import tracemalloc

import pandas as pd
import pyarrow as pa
import pytest

import __spark_entry__
from corvane.functions import vectors
from corvane.operators import chunking, containment, evaluation, lexical
from pyspark.sql import functions as F


def passes(df) -> int:
    """Scans of texts in the plan that ran, without those of exchanges that are used again."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return len(re.findall(r"FileScan parquet \[[^\]]*\btext#[^\n]*documents\.parquet", plan))


@pytest.mark.parametrize("name,most", [("bm25_topk", 1), ("rrf_fusion", 1), ("hybrid_search", 1), ("compare_configurations", 1), ("bm25_blocks_read", 2), ("index_maintained", 3)])
def test_passes_over_the_texts(spark, sf_dir, name, most):
    assert passes(__spark_entry__.queries()[name](spark, sf_dir)) == most


def test_terms_and_totals_share_a_pass_over_the_postings(spark):
    docs = spark.range(60).selectExpr("id", "id % 2 AS kind", "if(id = 7, array(), array('a', 'b', 'a', concat('c', id % 5))) AS tokens")
    asked = spark.createDataFrame([("a",), ("c1",), ("none",)], "term string")
    for by in ((), ("kind",)):
        whole, index = lexical.build(docs, "id", "tokens", by), lexical.build(docs, "id", "tokens", by, asked)
        got = lexical.term_stats(index)
        assert {tuple(r) for r in got.collect()} == {tuple(r) for r in lexical.term_stats(whole).where("term IN ('a', 'c1')").collect()}
        plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        counted = re.findall(r"HashAggregate\(keys=\[id#\d+L?, [^\]]*term#\d+\], functions=\[(?!partial)", plan)
        assert len(counted) == 1, plan
    assert lexical.build(docs.limit(0), "id", "tokens", (), asked).totals.first().asDict() == {"n": 0, "avgdl": 0.0}


def test_dictionary_reads_the_texts_once(spark, sf_dir):
    assert passes(__spark_entry__.queries()["term_dictionary"](spark, sf_dir)) == 1


@pytest.mark.parametrize("n,few", [(3, 16), (3, 0), (40, 16)])
def test_texts_that_meet_terms_stay_where_they_are(spark, monkeypatch, n, few):
    monkeypatch.setattr(containment, "FEW", few)
    texts = spark.range(50).selectExpr("id", "concat('Words w', id % 7, ' of ', id) AS text")
    terms = spark.range(n).selectExpr("concat('W', id) AS term")
    got = containment.containing(texts, terms)
    assert {tuple(r) for r in got.select("id", "term").collect()} == {(i, f"W{k}") for i in range(50) for k in range(n) if f"w{k}" in f"words w{i % 7} of {i}"}
    assert not re.search(r"Exchange hashpartitioning\([^)]*__h", got._jdf.queryExecution().executedPlan().toString())


def test_python_gets_first_bytes_not_words():
    assert vectors._hashed.func(pd.Series(["0001", "", None]), pd.Series([2, 2, 2])).map(lambda v: [round(x, 4) for x in v]).tolist() == [[0.7071, 0.7071], [0, 0], [0, 0]]


def test_places_of_a_batch_are_numbers():
    texts = pa.array(["a b c d e f g h " * 200] * 500 + [None])
    tracemalloc.start()
    counts, places = chunking._places(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert counts.tolist() == [1600] * 500 + [0] and places[1].as_py() == {"start": 2, "end": 3}
    assert peak < 40_000_000  # 800 000 places of 8 bytes, copied a few times


def test_usage_stays_where_it_is_when_priced(spark):
    usage = spark.range(100).selectExpr("concat('m', id % 3) AS model", "id AS input_tokens", "id AS output_tokens", "0L AS cache_read_tokens", "0L AS cache_write_tokens")
    prices = spark.createDataFrame([("m0", 1.0, 2.0), ("m1", 2.0, 4.0)], "model string, input_per_mtok double, output_per_mtok double")
    priced = evaluation.cost_usd(usage, prices)
    assert {r.model: round(r.c * 10**6) for r in priced.groupBy("model").agg(F.sum("cost_usd").alias("c")).collect()} == {"m0": 3 * sum(range(0, 100, 3)), "m1": 6 * sum(range(1, 100, 3)), "m2": 0}
    assert "Exchange hashpartitioning" not in priced._jdf.queryExecution().executedPlan().toString()
