"""Span trees, the term dictionary and the block walk on odd input."""

from pyspark.sql import functions as F

from corvane.operators import dictionary, spans
from corvane.sources import markup


def test_rollup_of_trees_orphans_and_null_costs(spark):
    rows = [("t", 1, None, "root", 5), ("t", 2, 1, "a", None), ("t", 3, 2, "b", 7), ("t", 4, 1, "a", 1), ("t", 9, 8, "orphan", 3), ("u", 1, None, "other", 2), ("u", 2, 1, "x", 0)]
    got = spans.rollup(spark.createDataFrame(rows, "trace_id string, span_id int, parent_id int, name string, cost long")).collect()
    assert sorted(tuple(r) for r in got) == [
        ("t", 1, 0, "root", 4, 13), ("t", 2, 1, "root/a", 2, 7), ("t", 3, 2, "root/a/b", 1, 7), ("t", 4, 1, "root/a", 1, 1), ("u", 1, 0, "other", 2, 2), ("u", 2, 1, "other/x", 1, 0),
    ]


def test_rollup_of_a_deep_trace(spark):
    rows = spark.range(60).select(F.lit("t").alias("trace_id"), F.col("id").alias("span_id"), F.nullif(F.col("id") - 1, F.lit(-1)).alias("parent_id"), F.lit("s").alias("name"), F.lit(1).cast("long").alias("cost"))
    got = {r.span_id: (r.depth, r.spans, r.inclusive_cost) for r in spans.rollup(rows).collect()}
    assert got == {k: (k, 60 - k, 60 - k) for k in range(60)}


def test_dictionary_ids_are_dense_and_stems_add_up(spark):
    rows = [(1, "en", "systems", 2), (1, "en", "system", 1), (2, "en", "systems", 1), (2, "fr", "systèmes", 4), (3, "en", "2024", 1), (3, "fr", "system", 1)]
    postings = spark.createDataFrame(rows, "id int, language string, term string, tf long")
    entries = dictionary.numbered(postings)
    assert sorted(r.id for r in entries.collect()) == list(range(5))
    stems = {(r.language, r.term): r.stem for r in dictionary.stemmed(postings).collect()}
    assert stems["en", "systems"] == stems["en", "system"] == "system" and stems["en", "2024"] == "2024"
    got = {(r.id, r.language, r.term): r.tf for r in dictionary.mapped(postings, dictionary.stemmed(postings), "stem").collect()}
    assert got[1, "en", "system"] == 3 and got[2, "en", "system"] == 1 and len(got) == 5
    assert dictionary.numbered(postings.limit(0)).count() == 0


def test_block_walk_yields_errors_as_rows(spark):
    good = "<html xmlns='http://www.w3.org/1999/xhtml'><body><div id='art_2'><p>one</p><table><tr><td>(a)</td><td><p>two</p></td></tr></table></div></body></html>"
    files = spark.createDataFrame([("good", bytearray(good.encode())), ("bad", bytearray(b"<a><b></a>")), ("none", None), ("empty", bytearray(b"<html/>"))], "name string, content binary")
    got = sorted((r.name, r.number, r.part, r.label, r.text, r.error is not None) for r in markup.act_blocks(files).where("name <> 'empty'").fillna("-", ["number", "label", "text"]).fillna(-1, ["part"]).collect())
    assert got == [("bad", "-", -1, "-", "-", True), ("good", "2", 0, "-", "one", False), ("good", "2", 1, "(a)", "two", False), ("none", "-", -1, "-", "-", True)]
    assert "NoneType" not in str([r.error for r in markup.act_blocks(files).where("name = 'none'").collect()])
