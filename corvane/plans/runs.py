"""Answer runs over a set of cases: answers, checks, judges, and the results' table."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation
from ..schemas import CASE_RESULT, CORRECTNESS, FAITHFULNESS

NO_TEXTS = "array<string>"


@dataclass(frozen=True)
class Judges:
    """Functions of columns that give JSON: faithfulness (question, context, answer) with score and unsupported claims,
    correctness (question, reference answer, answer) with score and reason. A null stands for no reply."""

    faithfulness: Callable[[Column, Column, Column], Column]
    correctness: Callable[[Column, Column, Column], Column]


def sliced(cases: DataFrame, limit: int | None = None) -> DataFrame:
    """The first ``limit`` cases in file order; all without one."""
    return cases.orderBy("ord", "id").limit(limit) if limit else cases


def review_rate(cases: DataFrame) -> DataFrame:
    """One row: n, and the share of cases that a person has reviewed (0 of none)."""
    return cases.agg(F.count("*").alias("n"), F.coalesce(F.avg(F.coalesce("reviewed", F.lit(False)).cast("int")), F.lit(0.0)).alias("review_rate"))


def seen_context(seen: DataFrame, provisions: DataFrame) -> DataFrame:
    """(qid, context) of the provisions that a run has read: seen (qid, language, provisions), in the order given; ids the store
    doesn't have are skipped, and a run that read none of them has an empty context."""
    own = provisions.select("provision_id", "language", "text")
    each = seen.select("qid", "language", F.posexplode("provisions").alias("at", "provision_id")).join(own, ["provision_id", "language"])
    block = F.concat(F.lit("["), "provision_id", F.lit("]\n"), F.col("text"))
    ordered = F.array_sort(F.collect_list(F.struct("at", block.alias("block"))))
    texts = each.groupBy("qid").agg(F.array_join(F.transform(ordered, lambda x: x["block"]), "\n\n").alias("context"))
    return seen.select("qid").join(texts, "qid", "left").na.fill("", ["context"])


def score_of(raw: Column, schema) -> Column:
    """A judge's score from 0 to 2; whatever can't be read or lies outside counts 0."""
    score = F.from_json(raw, schema)["score"]
    return F.when(score.between(0, 2), score).otherwise(0)


def judged(results: DataFrame, judges: Judges | None) -> DataFrame:
    """``results`` (question, context, reference_answer, answer, abstained) with faithfulness, correctness and unsupported; null
    for abstained answers and without judges. A case without a reference has no correctness."""
    if judges is None:
        return results.withColumns({"faithfulness": F.lit(None).cast("int"), "correctness": F.lit(None).cast("int"), "unsupported": F.array().cast(NO_TEXTS)})
    asked = ~F.col("abstained")
    out = results.withColumns({
        "__f": F.when(asked, F.coalesce(judges.faithfulness(F.col("question"), F.col("context"), F.col("answer")), F.lit("{}"))),
        "__c": F.when(asked & (F.coalesce("reference_answer", F.lit("")) != ""), F.coalesce(judges.correctness(F.col("question"), F.col("reference_answer"), F.col("answer")), F.lit("{}"))),
    })
    return out.withColumns({
        "faithfulness": F.when(F.col("__f").isNotNull(), score_of(F.col("__f"), FAITHFULNESS)).cast("int"),
        "correctness": F.when(F.col("__c").isNotNull(), score_of(F.col("__c"), CORRECTNESS)).cast("int"),
        "unsupported": F.coalesce(F.from_json("__f", FAITHFULNESS)["unsupported"], F.array().cast(NO_TEXTS)),
    }).drop("__f", "__c")


def results(cases: DataFrame, answers: DataFrame, judges: Judges | None = None, has_router: bool = False) -> DataFrame:
    """Case results (see ``schemas.CASE_RESULT``) of cases (``schemas.CASES``) and answers (qid, answer, citations, abstained, context,
    and, where known, route, steps, cost_usd, latency_seconds)."""
    have = set(answers.columns)
    absent = {"route": F.lit(None).cast("string"), "steps": F.lit(1), "cost_usd": F.lit(0.0), "latency_seconds": F.lit(0.0)}
    full = answers.select("qid", "answer", "citations", "abstained", "context", *[F.col(c) if c in have else v.alias(c) for c, v in absent.items()])
    both = cases.join(full, cases["id"] == full["qid"])
    precision, recall = evaluation.citation_scores(F.col("citations"), F.coalesce("expected_provisions", F.array().cast(NO_TEXTS)))
    abstention, route = evaluation.checks(F.col("abstained"), F.coalesce("expect_abstention", F.lit(False)), F.col("route"), F.col("expected_route"), F.lit(has_router))
    out = judged(both.withColumns({"citation_precision": precision, "citation_recall": recall, "abstention_correct": abstention, "route_correct": route}), judges)
    return out.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in CASE_RESULT.fields])


def answer_run(searcher, cases: DataFrame, complete: Callable[[Column, Column], Column], judges: Judges | None = None, limit: int | None = None) -> DataFrame:
    """Results of a batch of cases through retrieval and one completion each. The batch is answered as one plan; a case's latency is
    its share of that time."""
    from ..operators import answers

    chosen = sliced(cases, limit).persist()
    began = time.perf_counter()
    asked = chosen.select(F.col("id").alias("qid"), F.col("question").alias("text"), "language")
    hits = searcher.search(asked).withColumnRenamed("header", "breadcrumb").persist()
    got = answers.answered(searcher.questions(asked).select("qid", "text", "language"), hits, complete).join(answers.context(hits), "qid", "left").persist()
    n = got.count()
    share = (time.perf_counter() - began) / max(n, 1)
    return results(chosen, got.withColumn("latency_seconds", F.lit(share)).na.fill("", ["context"]), judges)


def agent_run(agent, cases: DataFrame, provisions: DataFrame, judges: Judges | None = None, limit: int | None = None, tracer=None) -> DataFrame:
    """Results of cases asked of the agent one by one, as each is a conversation with tools; judging is one plan. ``provisions`` is
    (provision_id, language, text). A dataset has as many rows as its questions."""
    spark: SparkSession = cases.sparkSession
    rows = []
    for case in sliced(cases, limit).toLocalIterator():
        began = time.perf_counter()
        if tracer is None:
            run = agent.ask(case["question"], case["language"], case["id"])
        else:
            with tracer.trace(case["id"], session=case["id"]):
                run = agent.ask(case["question"], case["language"], case["id"])
        rows.append((case["id"], case["language"], run.answer, run.citations, run.abstained, run.route, run.steps, float(run.cost_usd), time.perf_counter() - began, list(agent.seen.provisions)))
    got = spark.createDataFrame(rows, "qid string, language string, answer string, citations array<string>, abstained boolean, route string, steps int, cost_usd double, latency_seconds double, provisions array<string>")
    return results(cases, got.join(seen_context(got.select("qid", "language", "provisions"), provisions), "qid"), judges, has_router=True)


def usage_total(usage: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Sums of token counts, and total_tokens of inputs and outputs."""
    sums = usage.groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")])
    return sums.withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens"))
