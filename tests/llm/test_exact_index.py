"""The index of exact dedup is written by owners of bucket ranges."""

from corvane.llm import exact_dedup
from pyspark.sql import functions as F


def test_owners_write_ranges_of_buckets(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index = exact_dedup.build_index(spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text")), bucket_keys=50)[0]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = index.groupBy(F.input_file_name()).agg(F.min(F.struct("bucket", "h")).alias("a"), F.max(F.struct("bucket", "h")).alias("b")).orderBy("a").collect()
    assert len(files) > 1 and index.count() == 2000
    assert all(tuple(x.b) < tuple(y.a) for x, y in zip(files, files[1:], strict=False))


def test_depth_follows_the_keys(spark, monkeypatch):
    assert [exact_dedup.depth_of(n, 50_000) for n in (0, 10**6, 50_000 << 12, 50_000 << 20)] == [16, 16, 17, 25]
    monkeypatch.setattr(exact_dedup, "LEAST_DEPTH", 3)
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 1000).alias("text"))
    index, depth = exact_dedup.build_index(docs, bucket_keys=5)
    assert depth == 12 and index.groupBy("bucket").count().agg(F.max("count")).first()[0] <= 5
    groups = exact_dedup.exact_groups(docs, bucket_keys=5).collect()
    assert len(groups) == 3000 and {(r.doc_id % 1000, r.group_size, r.kept) for r in groups} == {(k, 3, kept) for k in range(1000) for kept in (True, False)}
    assert all(r.keep_id == r.doc_id % 1000 for r in groups)
