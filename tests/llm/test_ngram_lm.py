"""The language model against a plain interpolated modified Kneser-Ney of word triples."""

import math
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from corvane.llm import ngram_lm
from pyspark.sql import functions as F


def tokens(text):
    return [*(text or "").encode().lower().split(), b"</s>"]


class Plain:
    def __init__(self, texts):
        self.raw, self.three = Counter(), Counter()
        for t in texts:
            x = [b"<s>", b"<s>", *tokens(t)]
            self.raw.update(x[2:])
            self.three.update(zip(x, x[1:], x[2:], strict=False))
        self.two = Counter((v, w) for _, v, w in self.three)
        self.one = Counter(w for _, w in self.two)
        self.d3, self.d2, self.d1 = (ngram_lm.discounts([list(c.values()).count(k) for k in (1, 2, 3, 4)]) for c in (self.three, self.two, self.one))
        every = list(self.one.values())
        self.single = {n: self.mixed(n, self.d1, every, 1 / (len(self.raw) + 1)) for n in {0, *every}}
        self.after3, self.after2 = defaultdict(list), defaultdict(list)
        for (u, v, _), n in self.three.items():
            self.after3[u, v].append(n)
        for (v, _), n in self.two.items():
            self.after2[v].append(n)

    @staticmethod
    def mixed(n, d, after, lower):
        if not after:
            return lower
        total, taken = sum(after), (0, *d)
        return max(n - taken[min(n, 3)], 0) / total + sum(taken[min(k, 3)] for k in after) / total * lower

    def p(self, u, v, w):
        two = self.mixed(self.two[v, w], self.d2, self.after2.get(v), self.single[self.one[w]])
        return self.mixed(self.three[u, v, w], self.d3, self.after3.get((u, v)), two)

    def score(self, text):
        x = [b"<s>", b"<s>", *tokens(text)]
        n, kinds = sum(self.raw.values()), len(self.raw)
        return len(x) - 2, sum(self.raw[w] > 0 for w in x[2:]), sum(math.log10((self.raw[w] + 1) / (n + kinds + 1)) for w in x[2:]), sum(math.log10(self.p(*y)) for y in zip(x, x[1:], x[2:], strict=False))


def test_plain_version_is_a_distribution():
    plain = Plain(["a b a c", "b a", "a a a b", "", "c b a c d"])
    every = [*plain.raw, b"never seen"]
    for u in [b"<s>", *every]:
        for v in [b"<s>", *every]:
            assert math.isclose(sum(plain.p(u, v, w) for w in every), 1, rel_tol=1e-12)


@pytest.mark.parametrize(("ranges", "wide"), [(None, 32), (1, 32), (9, 2)])
def test_scores_are_those_of_the_plain_version(spark, sf_dir, monkeypatch, ranges, wide):
    monkeypatch.setattr(ngram_lm, "FLUSH", 20_000)  # several arrays from each task
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").where("n_chars < 2000").limit(60)
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(None, "no id"), (900, None), (901, ""), (902, "the the the the"), (902, "the the the the"), (903, "word " * 3000), (904, "word " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"r": F.lit("clash"), "n": F.lit(1)}).repartition(5)
    learnt = docs.where("doc_id is null or doc_id % 3 <> 0")
    folder = ngram_lm.train(learnt, ranges=ranges)
    plain = Plain([t for i, t in rows if i is None or i % 3])
    found = ngram_lm.scored(docs, folder).collect()
    assert len(found) == len(rows)
    want = sorted(((i, *plain.score(t)) for i, t in rows), key=lambda x: (x[0] is None, x[0] or 0))
    for r, w in zip(sorted(found, key=lambda r: (r.doc_id is None, r.doc_id or 0)), want, strict=True):
        assert (r.doc_id, r.n_tokens, r.n_known) == w[:3] and r.train_tokens == sum(plain.raw.values())
        assert math.isclose(r.base_score, w[3], rel_tol=1e-9) and math.isclose(r.score, w[4], rel_tol=1e-9), r.doc_id
    # Text learnt from is likelier than by single words.
    assert sum(r.score for r in found) > sum(r.base_score for r in found)


def test_words_with_equal_polynomials_are_two(spark):
    a = "a"
    for _ in range(10):
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, f"{a} {b}")], "doc_id long, text string")
    row = ngram_lm.scored(docs, ngram_lm.train(docs)).first()
    assert (row.n_tokens, row.n_known) == (3, 3) and math.isclose(row.base_score, 3 * math.log10(2 / 7))


def test_words_of_many_owners_are_dealt(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.expr("concat('the w', id % 40, ' the w', id % 7, ' the')").alias("text"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    folder = ngram_lm.train(docs, ranges=12)
    model, plain = ngram_lm.Model(folder), Plain([t for _, t in rows])
    assert len(model.get("total", 0, "v")) >= 2  # "the" and the start mark
    got = model.score(pa.array([t for _, t in rows[:50]]))[3]
    assert all(math.isclose(x, plain.score(t)[3], rel_tol=1e-9) for x, (_, t) in zip(got, rows, strict=False))
