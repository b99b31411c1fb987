"""Joins that would else hold everything against everything: containment, overlap of intervals; and the median without a sort."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from corvane.operators import chunking, containment, evaluation
from corvane.schemas import PROVISIONS


@pytest.mark.parametrize("sent", [10**6, 0])
def test_containment_against_brute_force(spark, monkeypatch, sent):
    monkeypatch.setattr(containment, "SENT", sent)
    rng = random.Random(sent)
    text = lambda n: "".join(rng.choice("aAbBéÉ \n.😀日") for _ in range(n))
    texts = [(k, text(rng.randrange(30)) if k % 9 else None) for k in range(80)] + [(100, ""), (101, "aab" * 20_000), (102, "aab" * 20_000)]
    terms = [text(rng.randrange(5)) for _ in range(60)] + ["", "aab", "AAB", "nowhere", None, "a", "😀"]
    got = containment.containing(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([(t,) for t in terms], "term string"))
    want = {(i, t, s) for i, t in texts for s in terms if t is not None and s is not None and s.lower() in t.lower()}
    rows = [tuple(r) for r in got.select("id", "text", "term").collect()]
    assert set(rows) == want and len(rows) == len(want)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in got._jdf.queryExecution().executedPlan().toString()


def test_containment_of_nothing(spark):
    none = spark.createDataFrame([], "term string")
    assert containment.containing(spark.createDataFrame([(1, "x")], "id int, text string"), none).count() == 0
    assert containment.containing(spark.createDataFrame([], "id int, text string"), spark.createDataFrame([("x",), ("",)], "term string")).count() == 0


@pytest.mark.parametrize("step", [1, 7, 1000])
def test_overlaps_against_brute_force(spark, step):
    rng = random.Random(step)
    windows = [(rng.randrange(3), a, a + rng.randrange(1, 40), n) for n, a in enumerate(rng.randrange(200) for _ in range(60))]
    spans = [(rng.randrange(3), s, s + rng.choice([0, 1, 5, 90]), n) for n, s in enumerate(rng.randrange(200) for _ in range(80))]
    got = chunking.overlap_join(spark.createDataFrame(windows, "doc int, a int, b int, w int"), spark.createDataFrame(spans, "doc int, s int, e int, p int"), "doc", step)
    rows = [(r.w, r.p) for r in got.collect()]
    want = {(w, p) for d, a, b, w in windows for f, s, e, p in spans if d == f and s < b and a < e}
    assert set(rows) == want and len(rows) == len(want)


def test_a_document_of_very_many_spans_makes_linear_rows(spark):
    n = 100_000
    windows = spark.range(n // 10).select(F.lit(1).alias("doc"), (F.col("id") * 200).alias("a"), (F.col("id") * 200 + 300).alias("b"))
    spans = spark.range(n).select(F.lit(1).alias("doc"), (F.col("id") * 20).alias("s"), (F.col("id") * 20 + 18).alias("e"))
    met = chunking.overlap_join(windows, spans, "doc", 256)
    assert met.count() == sum(len(range(max(0, (a - 18) // 20 + 1), min(n, -(-(a + 300) // 20)))) for a in range(0, n // 10 * 200, 200))
    # Rows that meet under a step: at most those of two steps for each window.
    filed = windows.withColumn("k", F.explode(F.sequence(F.floor(F.col("a") / 256), F.floor((F.col("b") - 1) / 256)))).count()
    assert filed < 3 * n // 10


def test_fixed_chunks_of_provisions_without_language_or_tokens(spark):
    rows = [(f"s:art:{k}", f"s{k % 2}", "s", None, "art", str(k), None, [], [{"label": None, "text": t}], k) for k, t in enumerate(["a b c", "d", "e f g h", " ", "...."])]
    out = chunking.fixed_chunks(spark.createDataFrame(rows, PROVISIONS), 3, 1).collect()
    assert sorted((r.document_id, r.ord, r.text.split(), r.provision_ids) for r in out) == [
        ("s0", 0, ["a", "b", "c"], ["s:art:0"]), ("s0", 1, ["c", "e", "f"], ["s:art:0", "s:art:2"]), ("s0", 2, ["f", "g", "h"], ["s:art:2"]), ("s0", 3, ["h", ".."], ["s:art:2", "s:art:4"]),
        ("s0", 4, ["..."], ["s:art:4"]), ("s1", 0, ["d"], ["s:art:1"]),
    ]


@pytest.mark.parametrize("values", [
    [], [3.0], [2.0, 1.0], [5.0] * 7, [1.0, 1.0, 2.0, 2.0], [None, float("nan"), 4.0, -4.0, 0.0], [1e308, -1e308, 1.0, 5e-324, 0.0], [5e-324, 0.0], [float(k % 17) * 0.1 for k in range(500)], [2.0**k for k in range(-300, 300, 7)],
])
@pytest.mark.parametrize("bins", [2, 1024])
def test_median_by_refinement(spark, values, bins):
    own = sorted(v for v in values if v is not None and v == v)
    got = evaluation.upper_median(spark.createDataFrame([(v,) for v in values], "v double"), "v", bins)
    assert got == (own[len(own) // 2] if own else None)


def _counted(rows, terms):
    """Lines and ids of each term that stands in any line."""
    fold = lambda t: t.lower().replace("ß", "ss")
    want = {}
    for i, t in rows:
        for line in t.split("\n") if t is not None else []:
            for s in {s for s in terms if s is not None and fold(s) in fold(line)}:
                lines, ids = want.setdefault(s, (0, set()))
                want[s] = (lines + 1, ids | ({i} - {None}))
    return {s: (n, len(ids)) for s, (n, ids) in want.items()}


def _counted_input(rng):
    text = lambda n: "".join(rng.choice("aAbBéÉß \n.😀日") for _ in range(n))
    long = "x" * 30 + "y" + "x" * 30
    rows = [(k // 2 if k % 11 else None, text(rng.randrange(60)) if k % 9 else None) for k in range(70)] + [(90, ""), (91, "\n"), (92, long + "\n" + long.upper()), (92, "x" * 16 + "y"), (93, "x" * 61)]
    return rows, [text(rng.randrange(1, 12)) for _ in range(90)] + ["", "aab", "AAB", "nowhere", None, "a", "a\na", long, long[:31], long[14:47], "x" * 8, "x" * 9, "x" * 16, "x" * 17, "x" * 40, "SS"]


@pytest.mark.parametrize("sent", [10**6, 7])
def test_counts_against_brute_force(spark, monkeypatch, sent):
    monkeypatch.setattr(containment, "SENT", sent)
    rows, terms = _counted_input(random.Random(sent))
    got = containment.counted(spark.createDataFrame(rows, "id int, text string").repartition(3), spark.createDataFrame([(t,) for t in terms], "term string"), "id").collect()
    assert {r.term: (r.lines, r.documents) for r in got} == _counted(rows, terms) and len(got) == len({r.term for r in got})


@pytest.mark.parametrize(("places", "rows_a_batch"), [(1, 1), (5, 2), (64, 7), (1 << 17, 3), (1 << 17, 1000)])
def test_counts_do_not_depend_on_where_texts_are_cut(monkeypatch, places, rows_a_batch):
    monkeypatch.setattr(containment, "PLACES", places)
    rows, terms = _counted_input(random.Random(places + rows_a_batch))
    rows = sorted((r for r in rows if r[1] is not None), key=lambda r: (r[0] is not None, str(r[0])))
    want, terms = _counted(rows, terms), sorted({t.lower().replace("ß", "ss") for t in terms if t is not None})
    sums = containment.Sums([t.encode() for t in terms])
    whole = pa.RecordBatch.from_arrays([pa.array([None if i is None else str(i) for i, _ in rows]), pa.array([t.lower().replace("ß", "ss") + "\n" for _, t in rows])], ["id", "text"])
    for k in range(0, len(rows), rows_a_batch):
        sums.add(*whole.slice(k, rows_a_batch).columns)
    found = dict(zip(terms, zip(*sums.ended().tolist(), strict=True), strict=True))
    assert {t: n for t, n in found.items() if n[0]} == {s.lower().replace("ß", "ss"): n for s, n in want.items()}


def test_counts_of_nothing(spark):
    none, texts = spark.createDataFrame([], "term string"), spark.createDataFrame([(1, "x")], "id int, text string")
    assert containment.counted(texts, none, "id").count() == 0
    assert containment.counted(texts.limit(0), spark.createDataFrame([("x",), ("",)], "term string"), "id").count() == 0


def test_no_row_of_a_line_and_a_term_is_made_to_count_them(spark, sf_dir):
    plan = __spark_entry__.queries()["term_containment"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan and "Join" not in plan
