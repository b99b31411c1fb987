"""Hot anchors are refined to their last bytes; ranges follow the volume."""

import random

import pytest
from corvane.llm import common, suffix_dedup
from pyspark.sql import functions as F

from .test_corpus_operators import brute_repeats


@pytest.mark.parametrize("hot", [1, 3])
def test_a_phrase_in_many_contexts(spark, monkeypatch, hot):
    rng = random.Random(hot)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = text(118)
    rows = [(k, text(rng.randrange(20, 60)) + shared + text(rng.randrange(20, 60))) for k in range(14)]
    rows += [(20 + k, text(30) + shared[:70] + "ab"[k % 2] * 30 + text(20)) for k in range(8)] + [(30 + k, "ab"[k % 2] * 60 + shared[50:] + text(20)) for k in range(8)]
    seen = []
    halved = suffix_dedup._split_hot
    monkeypatch.setattr(suffix_dedup, "_split_hot", lambda rows, hot: seen.append(1) or halved(rows, hot))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = suffix_dedup.remove_repeats(docs, hot=hot).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out} == brute_repeats(rows)
    assert len(seen) == 7  # the buckets were cut down to single places


def test_rows_that_share_an_id_and_null_ids(spark):
    text = "".join(chr(97 + k * k % 23) for k in range(400))
    rows = [(1, text, 0), (1, text, 0), (1, text[:300], 0), (None, text, 0), (2, "é" * 300, 1)]
    out = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, anchor int").withColumns({"place": F.lit("x"), "r": F.lit("y")})).collect()
    assert len(out) == 5
    own = {(r.doc_id, r.n_bytes): r.n_removed for r in out}
    # A null id comes before all; of the rows of one id the order is by the text's hash.
    assert own[None, 400] < 400 and own[1, 400] == 400 and own[1, 300] == 300 and own[2, 600] == 598


def test_ranges_follow_the_volume(spark, monkeypatch):
    docs = spark.createDataFrame([("x" * 1000,), (None,)] * 50, "text string")
    assert common.ranges_for(docs, "text") == 4
    monkeypatch.setattr(common, "RANGE_BYTES", 1000)
    assert common.ranges_for(docs, "text") == 50
    assert common.ranges_for(docs.limit(0), "text") == 4
