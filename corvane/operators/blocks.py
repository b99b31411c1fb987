"""Impact-bounded BM25: postings in blocks of ids, each with the greatest contribution of a term, so that most blocks aren't joined.

A block's bound for a query is the sum of its terms' greatest contributions there. Some document of the block does reach the
greatest single contribution, so the k-th largest of those over all blocks is a score that k documents have for certain: blocks whose bound
is lower can't reach the best k. The blocks of highest bound are scored first, which raises that score to their own k-th; of the
others only those are joined whose bound still reaches it. Terms and blocks together are the key, so a stop word is no hot key.

What is stored of a contribution doesn't go stale: ``most`` is the greatest tf / (1 - b + b * len / base) with the average length ``base`` of
its time. Under another average length it changes by a factor between min(1, average / base) and max(1, average / base).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import lexical

#: Ids of a block, for ids that are numbers; other ids are dealt by hash, with about as many in a block.
BLOCK = 64
#: Blocks of each query that are scored first.
FIRST = 4


@dataclass(frozen=True)
class Blocked:
    """postings (by, term, block, id, tf, len) and bounds (by, term, block, most, base), with the index they belong to."""

    postings: DataFrame
    bounds: DataFrame
    index: lexical.Lexical
    b: float


def block_of(id_type: str, size: int = BLOCK, blocks: int | None = None) -> Column:
    """The block of column ``id``: runs of ``size`` numbers, or one of ``blocks`` by hash."""
    if id_type in ("tinyint", "smallint", "int", "bigint"):
        return F.expr(f"cast(floor(id / {size}) as bigint)")
    if blocks is None:
        raise ValueError("ids that aren't numbers need the number of blocks")
    return F.pmod(F.xxhash64("id"), F.lit(blocks))


def blocked(index: lexical.Lexical, b: float = 0.75, block: Column | None = None, size: int = BLOCK) -> Blocked:
    """The blocks of an index. Without ``block`` ids are numbers."""
    on = [*index.by, "term"]
    block = block_of(dict(index.postings.dtypes)["id"], size) if block is None else block
    postings = index.postings.select(*on, block.alias("block"), "id", "tf", "len")
    return Blocked(postings, bounds(postings, index, b), index, b)


def _per_length(b: float) -> Column:
    return 1 - b + b * F.when(F.col("avgdl") == 0, 1.0).otherwise(F.col("len") / F.col("avgdl"))


def bounds(postings: DataFrame, index: lexical.Lexical, b: float = 0.75) -> DataFrame:
    """(by, term, block, most, base) of postings with their block: folds within tasks, so a common term is a row a block and task."""
    placed = lexical.with_totals(postings, index)
    return placed.groupBy(*index.by, "term", "block").agg(F.max(F.col("tf") / _per_length(b)).alias("most"), F.max("avgdl").alias("base"))


def weighted(index: lexical.Lexical, queries: DataFrame) -> DataFrame:
    """(qid, by, term, weight, avgdl) of queries (qid, tokens, by): times and idf of each term that the index has."""
    on = [*index.by, "term"]
    asked = queries.select("qid", *index.by, F.explode("tokens").alias("term")).groupBy("qid", *on).agg(F.count("*").alias("times"))
    return lexical.with_totals(asked.join(index.terms, on), index).select("qid", *on, (F.col("times") * lexical.idf(F.col("n"), F.col("df"))).alias("weight"), "avgdl")


def _saturated(x: Column, k1: float) -> Column:
    return x * (k1 + 1) / (x + k1)


def reach(blocks: Blocked, weights: DataFrame, k: int, k1: float = 1.5, digits: int = 6) -> DataFrame:
    """(qid, block, bound, sure, threshold, kept) of every query and block that has one of its terms: the most that a document of the block
    can score, what one of its documents scores at least, what k documents score at least, and whether the block can beat that."""
    on = [*blocks.index.by, "term"]
    met = weights.join(blocks.bounds, on)
    drift = F.when(F.col("base") == 0, 1.0).otherwise(F.col("avgdl") / F.col("base"))
    high = F.col("weight") * _saturated(F.col("most") * F.greatest(F.lit(1.0), drift), k1)
    low = F.col("weight") * _saturated(F.col("most") * F.least(F.lit(1.0), drift), k1)
    each = met.groupBy("qid", "block").agg(F.round(F.sum(high), 9).alias("bound"), F.round(F.max(low), 9).alias("sure"))
    kth = best_values(each, "sure", k).select("qid", F.col("value").alias("threshold"))
    return each.join(kth, "qid", "left").withColumn("kept", F.col("threshold").isNull() | (F.col("bound") >= F.col("threshold") - 2 * 10.0**-digits))


def best_values(rows: DataFrame, column: str, k: int) -> DataFrame:
    """(qid, value): the k-th largest value of each query; no row for those with fewer."""
    order = Window.partitionBy("qid").orderBy(F.desc(column))
    return rows.select("qid", column, F.row_number().over(order).alias("place")).where(F.col("place") <= k).where(F.col("place") == k).select("qid", F.col(column).alias("value"))


def _scores(blocks: Blocked, asked: DataFrame, k1: float, digits: int) -> DataFrame:
    """(qid, block, id, score) of rows (qid, block, by, term, weight, avgdl)."""
    on = [*blocks.index.by, "term", "block"]
    hits = asked.join(blocks.postings, on)
    part = F.col("weight") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * _per_length(blocks.b))
    return hits.groupBy("qid", "id").agg(F.round(F.sum(part), digits).alias("score"))


def plan(blocks: Blocked, queries: DataFrame, k: int, k1: float = 1.5, digits: int = 6, first: int = FIRST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scores (qid, id, score) of the blocks that are joined first and of those joined after, and (qid, block, bound, stage) of every
    block: stage 1 joined first, 2 joined after, 3 passed over for the first blocks' scores, 4 for the bounds alone."""
    weights = weighted(blocks.index, queries)
    seen = reach(blocks, weights, k, k1, digits)
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("bound"), "block"))
    seen = seen.withColumn("place", F.when(F.col("kept"), place))
    head = _scores(blocks, seen.where(F.col("place") <= first).select("qid", "block").join(weights, "qid"), k1, digits)
    kth = best_values(head, "score", k).select("qid", F.col("value").alias("scored"))
    stage = F.when(~F.col("kept"), 4).when(F.col("place") <= first, 1).when(F.col("scored").isNotNull() & (F.col("bound") < F.col("scored") - 2 * 10.0**-digits), 3).otherwise(2)
    told = seen.join(kth, "qid", "left").select("qid", "block", "bound", stage.alias("stage"))
    tail = _scores(blocks, told.where("stage = 2").select("qid", "block").join(weights, "qid"), k1, digits)
    return head, tail, told


def search(blocks: Blocked, queries: DataFrame, k: int, k1: float = 1.5, digits: int = 6, first: int = FIRST) -> DataFrame:
    """(qid, id, score, position) of the best ``k`` for each query, equal to ``lexical.search`` over the whole index."""
    head, tail, _ = plan(blocks, queries, k, k1, digits, first)
    return lexical.best(head.unionByName(tail), k)
