"""The pipeline, stage by stage, against plain versions of its parts."""

import corpus_pipeline
from corvane.llm import packing, queries
from pyspark.sql import functions as F

from .test_corpus_operators import brute_groups
from .test_similar import brute_kept


def test_stages(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")  # the smallest tables have too few labels to hold a model to its accuracy
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, sf_dir).persist()
        assert docs.columns == before.columns
        old, new = ({(r.doc_id, r.text) for r in x.select("doc_id", "text").collect()} for x in (before, docs))
        assert new <= old
        if name == "toxicity":
            gone = {i for i, _ in old - new}
            assert sum(labels.get(i) == 0 for i in gone) <= 0.02 * len(labels)
            assert sum(labels.get(i) == 1 for i in gone) >= 0.7 * sum(v == 1 for i, v in labels.items() if i in {j for j, _ in old})
        elif name == "exact_dedup":
            assert {i for i, _ in new} == {g[0] for g in brute_groups(sorted(old)) if g[3]}
        elif name == "near_dedup":
            assert sorted(i for i, _ in new) == brute_kept(sorted(old))
        else:
            items = [" ".join(r.text.split()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            assert not any(i in " ".join(t.split()) for _, t in new for i in items)
            assert len(old - new) < 0.1 * len(old)
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert out.select("doc_id").distinct().count() == docs.count()


def test_run_and_empty_table(spark, sf_dir, tmp_path):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_rows_pass_through(spark, sf_dir):
    rows = spark.createDataFrame([(1, None, None, None, None), (None, "some words here", "en", None, 3), (3, "", "", "", 0), (3, "", "", "", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, sf_dir)
    assert sorted(r.doc_id is None for r in rows.collect()) == [False, True]
    assert packing.pack(rows.withColumn("rank", F.lit(1)), queries.tokenizer_path()).count() == 2
