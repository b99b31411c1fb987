"""Retrieval metrics, answer checks, run summaries, judge calibration, usage cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Prices in USD for a million tokens, by model size; pass your own table for real model names.
PRICES = (("large", 5.0, 25.0), ("large-previous", 5.0, 25.0), ("medium", 2.0, 10.0), ("small", 1.0, 5.0))
USABLE_KAPPA = 0.4


def outcome_columns(k: int) -> dict[str, Column]:
    """Measures of one case: expected ARRAY<STRING>, retrieved ARRAY<ARRAY<STRING>> in rank order."""
    expected = F.array_distinct("expected")
    found = F.array_distinct(F.flatten("retrieved"))
    hit = F.transform(F.col("retrieved"), lambda p: F.arrays_overlap(p, expected))
    first = F.array_position(hit, True)
    first = F.when(first > 0, first)
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.size(expected), F.lit(k))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    gain = F.aggregate(F.transform(F.slice(hit, 1, k), lambda h, i: F.when(h, 1 / F.log2(i + 2.0)).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)
    some = F.size(expected) > 0
    return {
        "first_rank": first.cast("int"),
        "hit": F.coalesce((first <= k).cast("double"), F.lit(0.0)),
        "recall": F.when(some, F.size(F.array_intersect(found, expected)) / F.size(expected)).otherwise(0.0),
        "reciprocal": F.when(first <= k, 1 / first).otherwise(0.0),
        "ndcg": F.when(some, gain / F.when(some, ideal)).otherwise(0.0),
    }


def retrieval_scores(outcomes: DataFrame, k: int, by: tuple[str, ...] = ()) -> DataFrame:
    """n, hit_rate, recall, mrr, ndcg over all cases (0 without any), and the ids missed in order of ``ord``.

    Recall reads the whole list of results; the others stop at ``k``.
    """
    each = outcomes.select("*", *[v.alias(f"_{name}") for name, v in outcome_columns(k).items()])
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 4)
    missed = F.transform(F.array_sort(F.collect_list(F.when(F.col("_hit") == 0, F.struct("ord", "id")))), lambda x: x["id"])
    return each.groupBy(*by).agg(
        F.count("*").alias("n"), mean("_hit").alias("hit_rate"), mean("_recall").alias("recall"), mean("_reciprocal").alias("mrr"), mean("_ndcg").alias("ndcg"), missed.alias("misses")
    )


def citation_scores(cited: Column, expected: Column) -> tuple[Column, Column]:
    """Precision and recall against labels: nothing expected is (1 if nothing is cited else 0, 1); nothing cited is (0, 0)."""
    cited, expected = F.array_distinct(cited), F.array_distinct(expected)
    both = F.size(F.array_intersect(cited, expected))
    none, silent = F.size(expected) == 0, F.size(cited) == 0
    precision = F.when(none, silent.cast("double")).when(silent, 0.0).otherwise(both / F.nullif(F.size(cited), F.lit(0)))
    recall = F.when(none, 1.0).when(silent, 0.0).otherwise(both / F.nullif(F.size(expected), F.lit(0)))
    return precision, recall


def checks(abstained: Column, expect_abstention: Column, route: Column, expected_route: Column, has_router: Column | None = None) -> tuple[Column, Column]:
    """Abstention and route correctness; the route's is null without a label, or for paths without a router."""
    right = F.coalesce(route == expected_route, F.lit(False))
    known = expected_route.isNotNull() if has_router is None else expected_route.isNotNull() & has_router
    return abstained == expect_abstention, F.when(known, right)


def upper_median(rows: DataFrame, value: str, bins: int = 1024) -> float | None:
    """The upper of two middle values, exactly, by refinement: the range is cut into ``bins``, the bin that holds the wanted rank
    becomes the range, from its least to its greatest value, and so on until it holds one value. A step brings ``bins`` rows to the
    driver, whatever the number of values; null and NaN don't count; None of no values."""
    own = rows.select(F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    least, most, n = own.agg(F.min("v"), F.max("v"), F.count("*")).first()
    rank = n // 2
    while n and least < most:
        width = (most / 2 - least / 2) / (bins / 2)
        # Half of each, as the difference of two very large numbers is no number; too narrow a range is cut in two.
        place = F.least(F.floor((F.col("v") / 2 - least / 2) / (width / 2)), F.lit(bins - 1)) if width / 2 > 0 else (F.col("v") > least).cast("int")
        counts = own.where(F.col("v").between(least, most)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most")).orderBy("bin").collect()
        for r in counts:
            if rank < r["n"]:
                least, most = r["least"], r["most"]
                break
            rank -= r["n"]
    return least


def run_summary(cases: DataFrame) -> DataFrame:
    """Averages of case results (see ``schemas.CASE_RESULT``) in one row.

    Faithfulness and correctness are means over graded cases (faithfulness given), halved; a missing correctness of a
    graded case counts 0. Ungraded measures are null.
    """
    graded = F.col("faithfulness").isNotNull()
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    flag = lambda c: F.col(c).cast("double")
    return cases.agg(
        F.count("*").alias("n"),
        F.round(F.avg(F.when(graded, F.col("faithfulness") / 2)), 4).alias("faithfulness"),
        F.round(F.avg(F.when(graded, F.coalesce("correctness", F.lit(0)) / 2)), 4).alias("correctness"),
        F.round(mean("citation_precision"), 4).alias("citation_precision"),
        F.round(mean("citation_recall"), 4).alias("citation_recall"),
        F.round(mean(flag("abstention_correct")), 4).alias("abstention_accuracy"),
        F.round(F.avg(flag("route_correct")), 4).alias("route_accuracy"),
        F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 4).alias("total_cost_usd"),
        F.round(mean("cost_usd"), 6).alias("cost_per_case_usd"),
        F.round(mean("steps"), 4).alias("mean_steps"),
        F.round(F.lit(upper_median(cases, "latency_seconds") or 0.0), 4).alias("median_latency_seconds"),
    )


def by_category(cases: DataFrame) -> DataFrame:
    """Per category: cases, mean correctness (halved, over graded; null if none), mean precision, mean abstention."""
    return cases.groupBy("category").agg(
        F.count("*").alias("n"),
        F.round(F.avg(F.col("correctness") / 2), 4).alias("correctness"),
        F.round(F.avg("citation_precision"), 4).alias("citation_precision"),
        F.round(F.avg(F.col("abstention_correct").cast("double")), 4).alias("abstention_accuracy"),
    )


def to_review(cases: DataFrame) -> DataFrame:
    """Cases graded below the best: scores of 0 and 1."""
    return cases.where(F.coalesce("correctness", F.lit(2)) < 2)


def unpivoted(cases: DataFrame, key: str, numbers: list[str], flags: list[str]) -> DataFrame:
    """(key, name, value) of every measure that is not null."""
    typed = cases.select(key, *[F.col(c).cast("double").alias(c) for c in [*numbers, *flags]])
    return typed.unpivot(key, [*numbers, *flags], "name", "value").where("value is not null")


def agreement(pairs: DataFrame) -> DataFrame:
    """Judge against human, by metric: (metric, judge, human) rows, both given.

    Kappa compares observed agreement with that of independent raters over scores 0 to 2; if chance agreement is
    complete, kappa is 1 for complete agreement and else 0.
    """
    both = pairs.where("judge is not null and human is not null")
    share = lambda c: F.avg(c.cast("double"))
    a, b = F.col("judge"), F.col("human")
    sums = both.groupBy("metric").agg(
        F.count("*").alias("pairs"), share(a == b).alias("exact"), share(F.abs(a - b) <= 1).alias("within_one"), *[share(x == s).alias(f"{n}{s}") for n, x in (("a", a), ("b", b)) for s in (0, 1, 2)]
    )
    chance = F.col("a0") * F.col("b0") + F.col("a1") * F.col("b1") + F.col("a2") * F.col("b2")
    kappa = F.when(chance >= 1, (F.col("exact") == 1).cast("double")).otherwise((F.col("exact") - chance) / F.nullif(1 - chance, F.lit(0.0)))
    out = sums.withColumn("kappa", F.round(kappa, 4))
    return out.select("metric", "pairs", F.round("exact", 4).alias("exact"), F.round("within_one", 4).alias("within_one"), "kappa", (F.col("kappa") >= USABLE_KAPPA).alias("usable"))


def cost_usd(usage: DataFrame, prices: DataFrame, model: str = "model", read: float = 0.1, write: float = 1.25) -> DataFrame:
    """``usage`` with cost_usd of each row; an unknown model costs 0. Prices are a row a model and are sent to all tasks: usage of a few models
    must not be dealt by model."""
    p = prices.select(F.col("model").alias(model), "input_per_mtok", "output_per_mtok")
    full = usage.join(F.broadcast(p), model, "left")
    inputs = F.col("input_tokens") + F.col("cache_read_tokens") * read + F.col("cache_write_tokens") * write
    cost = (inputs * F.col("input_per_mtok") + F.col("output_tokens") * F.col("output_per_mtok")) / 1_000_000
    return full.withColumn("cost_usd", F.coalesce(cost, F.lit(0.0))).drop("input_per_mtok", "output_per_mtok")
