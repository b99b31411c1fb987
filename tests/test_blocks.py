"""Impact-bounded BM25 against the whole index, and statistics kept up to date against a rebuild."""

import random

import pytest
from pyspark.sql import functions as F

from corvane.operators import blocks, lexical, statistics, store
from corvane.plans.corpus import Searcher, ingest
from corvane.schemas import DOCUMENTS, LENGTHS, POSTINGS, PROVISIONS, TERMS, TOTALS


def made_up(spark, seed, n=400):
    """Documents of a few common and many rare words, with equal ones among them; questions with repeated and unknown words."""
    rng = random.Random(seed)
    word = lambda: f"c{rng.randrange(4)}" if rng.random() < 0.5 else f"r{int(rng.paretovariate(0.5))}"
    docs = [(k, rng.choice(["en", "fr"]), [word() for _ in range(rng.choice([0, 1, 5, 30]))]) for k in range(n)]
    docs += [(n + k, d[1], d[2]) for k, d in enumerate(docs[:20])]
    asked = [(q, rng.choice(["en", "fr", "xx"]), [word() for _ in range(rng.randrange(1, 6))] + ["c0"] * (q % 3) + ["unknown"]) for q in range(25)]
    return spark.createDataFrame(docs, "id int, language string, tokens array<string>"), spark.createDataFrame(asked, "qid int, language string, tokens array<string>")


@pytest.mark.parametrize(("by", "k", "first", "size"), [((), 3, 1, 8), (("language",), 5, 2, 8), ((), 1, 0, 4), ((), 500, 4, 64)])
def test_blocks_lose_nothing(spark, by, k, first, size):
    docs, asked = made_up(spark, k)
    index = lexical.build(docs, "id", "tokens", by)
    want = sorted(map(tuple, lexical.search(index, asked, k).collect()))
    made = blocks.blocked(index, size=size)
    assert sorted(map(tuple, blocks.search(made, asked, k, first=first).collect())) == want
    head, tail, told = blocks.plan(made, asked, k, first=first)
    stage = {(r.qid, r.block): r.stage for r in told.collect()}
    assert {(r.qid, r.id // size) for r in head.collect()} <= {x for x, s in stage.items() if s == 1}
    assert {(r.qid, r.id // size) for r in tail.collect()} <= {x for x, s in stage.items() if s == 2}
    # No document of a block that is passed over has the score of the last place.
    last = {}
    for qid, _, score, _ in want:
        last[qid] = min(last.get(qid, score), score)
    for r in lexical.search(index, asked, 10**6).collect():
        if stage[r.qid, r.id // size] > 2:
            assert r.score < last[r.qid]
    assert k > 100 or sum(s > 2 for s in stage.values()) > 0.1 * len(stage)


@pytest.mark.parametrize("factor", [0.4, 3.0])
def test_bounds_of_another_time_still_hold(spark, factor):
    docs, asked = made_up(spark, 9)
    index = lexical.build(docs, "id", "tokens")
    then = lexical.Lexical(index.postings, index.terms, index.totals.withColumn("avgdl", F.col("avgdl") * factor))
    made = blocks.blocked(index, size=8)
    stale = blocks.Blocked(made.postings, blocks.bounds(made.postings, then), index, 0.75)
    assert sorted(map(tuple, blocks.search(stale, asked, 5).collect())) == sorted(map(tuple, lexical.search(index, asked, 5).collect()))


def test_ids_by_hash_and_an_empty_index(spark):
    docs, asked = made_up(spark, 4)
    named = docs.withColumn("id", F.concat(F.lit("n"), "id"))
    index = lexical.build(named, "id", "tokens")
    assert sorted(map(tuple, blocks.search(blocks.blocked(index, block=blocks.block_of("string", blocks=40)), asked, 5).collect())) == sorted(map(tuple, lexical.search(index, asked, 5).collect()))
    with pytest.raises(ValueError):
        blocks.blocked(index)
    assert blocks.search(blocks.blocked(lexical.build(docs.limit(0), "id", "tokens")), asked, 5).count() == 0


def test_changes_equal_a_rebuild(spark):
    docs, _ = made_up(spark, 2, 120)

    def of(rows):
        lengths = rows.withColumn("len", F.size("tokens"))
        return statistics.of(rows.select("id", "language", F.explode("tokens").alias("term")).distinct(), lengths, ("language",))

    gone, come = docs.where("id % 3 = 0 or language = 'fr'"), docs.where("id % 6 = 0").withColumn("tokens", F.concat("tokens", F.array(F.lit("new"))))
    changed = statistics.change(of(gone), of(come))
    now, want = statistics.merged(of(docs), changed), of(docs.join(gone, "id", "left_anti").unionByName(come))
    assert sorted(map(tuple, now.terms.collect())) == sorted(map(tuple, want.terms.collect()))
    assert sorted(map(tuple, now.totals.collect())) == sorted(map(tuple, want.totals.collect()))
    some = statistics.touched(of(docs), changed)
    names = {(r.language, r.term) for r in changed.terms.collect()}
    assert {tuple(r) for r in some.terms.collect()} == {tuple(r) for r in want.terms.collect() if (r.language, r.term) in names}


def act(spark, name, texts):
    rows = [(f"{name}:art:{k}", f"{name}:en", name, "en", "art", str(k), None, ["S", f"Article {k}"], [{"label": None, "text": t}], k) for k, t in enumerate(texts)]
    return spark.createDataFrame([(f"{name}:en", name, "en", name, "u", "h", None)], DOCUMENTS), spark.createDataFrame(rows, PROVISIONS)


def test_stored_statistics_follow_every_ingest(spark, tmp_path):
    tables = store.Tables(spark, str(tmp_path))
    for name, texts in (("a", ["providers of systems", "systems of risk", "risk"]), ("b", ["providers keep records", "records"]), ("a", ["providers only", "a longer text on providers and systems and other matters"]), ("b", [])):
        ingest(tables, *act(spark, name, texts))
        postings, lengths = tables.read("postings", POSTINGS), tables.read("lengths", LENGTHS)
        want = statistics.of(postings, lengths, ("language",))
        assert {(r.language, r.term, r.df) for r in tables.read("terms", TERMS).collect()} == {tuple(r) for r in want.terms.collect()}
        assert {(r.language, r.n, r.tokens) for r in tables.read("totals", TOTALS).collect()} == {tuple(r) for r in want.totals.collect()}
        search = Searcher(tables)
        asked = search.questions(spark.createDataFrame([(1, "providers of systems", "en"), (2, "records of risk", "en")], "qid int, text string, language string"))
        whole = lexical.of(postings, lengths, ("language",))
        own = search.lexical(asked)
        assert sorted(map(tuple, blocks.search(own, asked, 3).collect())) == sorted(map(tuple, lexical.search(whole, asked, 3).collect()))
    plan = search.search(asked.select("qid", "text", "language"), signals=("bm25",))._jdf.queryExecution().optimizedPlan().toString()
    assert str(tmp_path / "lengths") not in plan and "lengths/" not in plan


def test_the_second_of_two_writers_is_told(spark, tmp_path):
    one, two = store.Tables(spark, str(tmp_path)), store.Tables(spark, str(tmp_path))
    ingest(one, *act(spark, "a", ["text"]))
    version, catalog = two._latest()
    one.append("notes", spark.range(2))
    with pytest.raises(store.Conflict):
        two._commit(version, catalog)
    two.append("notes", spark.range(3))
    assert one.read("notes", spark.range(1).schema).count() == 5
    assert len(one._versions()) == 3 and one.vacuum() >= 0 and len(one._versions()) == 1
