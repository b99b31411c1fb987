"""Fusion of rankings and hybrid search over batches of questions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import CONFIGURATIONS, Settings
from . import blocks, dense, lexical, references


def fuse(rankings: DataFrame, weights: Mapping[str, float], k: int = 60, by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """Reciprocal rank fusion of (qid, signal, id, position): (qid, id, score, components).

    A signal's contribution is weight / (k + position); an id repeated in one signal has its last position; a signal without
    a weight counts 1.
    """
    weight = F.lit(1.0)
    for signal, w in weights.items():
        weight = F.when(F.col("signal") == signal, float(w)).otherwise(weight)
    last = rankings.groupBy(*by, "signal", "id").agg(F.max("position").alias("position"))
    parts = last.withColumn("part", weight / (F.lit(k) + F.col("position")))
    components = F.map_from_entries(F.array_sort(F.collect_list(F.struct("signal", "part"))))
    return parts.groupBy(*by, "id").agg(F.round(F.sum("part"), 9).alias("score"), components.alias("components"))


def finish(fused: DataFrame, chunks: DataFrame, limit: int, sources: list[str] | None = None, by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """Fused ids that are chunks (id, source_id, provision_ids), of the sources if given, one for each list of provisions,
    ranked from 1 up to ``limit``. The sources are applied here, after candidates were cut."""
    hits = fused.join(chunks.select("id", "source_id", "provision_ids"), "id")
    if sources:
        hits = hits.where(F.col("source_id").isin(list(sources)))
    order = [F.desc("score"), F.col("id")]
    first = hits.withColumn("same", F.row_number().over(Window.partitionBy(*by, "provision_ids").orderBy(*order))).where("same = 1").drop("same")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= limit)


def rankings(queries: DataFrame, chunks: DataFrame, index: lexical.Lexical | blocks.Blocked | None, vectors: DataFrame, signals: tuple[str, ...], settings: Settings, same: tuple[str, ...] = ()) -> DataFrame:
    """(qid, signal, id, position) of each signal asked for.

    queries: qid, text, tokens, vector, and the columns ``same``; chunks: id, ord, source_id, provision_ids, and ``same``;
    vectors: id, vector. With ``same`` (a language), a query meets only chunks that agree; the index is then built by it.
    """
    parts = []
    if "reference" in signals:
        hits = references.reference_hits(queries, chunks, chunks.select("source_id").distinct())
        if same:
            own = queries.select("qid", *same).join(hits, "qid")
            hits = own.join(chunks.select("id", *same), ["id", *same])
            hits = hits.withColumn("position", F.row_number().over(Window.partitionBy("qid").orderBy("position")))
        parts.append(hits.select("qid", F.lit("reference").alias("signal"), "id", "position"))
    if "dense" in signals:
        parts.append(_dense(queries, chunks, vectors, settings, same).select("qid", F.lit("dense").alias("signal"), "id", "position"))
    if "bm25" in signals:
        if isinstance(index, blocks.Blocked):
            hits = blocks.search(index, queries, settings.candidates, settings.bm25_k1)
        else:
            hits = lexical.search(index, queries, settings.candidates, settings.bm25_k1, settings.bm25_b)
        parts.append(hits.select("qid", F.lit("bm25").alias("signal"), "id", "position"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _dense(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, settings: Settings, same: tuple[str, ...]) -> DataFrame:
    if not same:
        return dense.search(vectors, queries, settings.candidates)
    (column,) = same
    # One search for each language: a handful.
    values = [r[0] for r in queries.select(column).distinct().orderBy(column).collect()]
    out = None
    for value in values:
        allowed = chunks.where(F.col(column) == value).select("id")
        one = dense.search(vectors, queries.where(F.col(column) == value), settings.candidates, allowed=allowed)
        out = one if out is None else out.unionByName(one)
    return out if out is not None else dense.search(vectors, queries, settings.candidates)


def search(
    queries: DataFrame, chunks: DataFrame, index: lexical.Lexical | blocks.Blocked | None, vectors: DataFrame, settings: Settings | None = None, signals: tuple[str, ...] | None = None,
    weights: Mapping[str, float] | None = None, sources: list[str] | None = None, limit: int | None = None, same: tuple[str, ...] = (),
) -> DataFrame:
    """Hybrid search: qid, rank, id, score, components, matched_reference, source_id, provision_ids. A limit of 0 means the default."""
    settings = settings or Settings()
    found = rankings(queries, chunks, index, vectors, signals or settings.signals, settings, same)
    fused = fuse(found, settings.weights if weights is None else weights, settings.rrf_k)
    return finish(fused, chunks, limit or settings.top_k, sources).withColumn("matched_reference", F.map_contains_key("components", F.lit("reference")))


def compare(queries: DataFrame, chunks: DataFrame, index: lexical.Lexical | blocks.Blocked | None, vectors: DataFrame, settings: Settings | None = None, limit: int = 5, configurations: Mapping[str, Mapping[str, float]] = CONFIGURATIONS, same: tuple[str, ...] = ()) -> DataFrame:
    """Every configuration's results in one plan: config, qid, rank, id, score, provision_ids. Signals are ranked once."""
    settings = settings or Settings()
    found = rankings(queries, chunks, index, vectors, ("reference", "dense", "bm25"), settings, same)
    weights = F.create_map(*[x for name, w in configurations.items() for x in (F.lit(name), F.create_map(*[y for s, v in w.items() for y in (F.lit(s), F.lit(float(v)))]))])
    each = found.select(F.explode(weights).alias("config", "w"), "*").where(F.try_element_at("w", F.col("signal")).isNotNull()).withColumn("weight", F.try_element_at("w", F.col("signal")))
    last = each.groupBy("config", "qid", "signal", "id").agg(F.max("position").alias("position"), F.max("weight").alias("weight"))
    fused = last.groupBy("config", "qid", "id").agg(F.round(F.sum(F.col("weight") / (settings.rrf_k + F.col("position"))), 9).alias("score"))
    return finish(fused, chunks, limit, by=("config", "qid"))
