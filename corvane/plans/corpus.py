"""Whole flows: ingest and index, search, answer, evaluate."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CONFIGURATIONS, Settings
from ..functions.text import analyse, detect_language, embedding_text
from ..functions.vectors import hashing_embedding
from ..operators import answers, blocks, evaluation, lexical, retrieval, statistics, store
from ..operators.chunking import WORDS, TokenCounter, chunk
from ..schemas import BOUNDS, CHUNK_EMBEDDINGS, CHUNKS, DOCUMENTS, EMBEDDING_CACHE, LENGTHS, POSTINGS, PROVISIONS, TERMS, TOTALS


def ingest(tables: store.Tables, documents: DataFrame, provisions: DataFrame, settings: Settings | None = None, counter: TokenCounter = WORDS, batch: tuple[str, int] | None = None) -> DataFrame:
    """Stores documents, provisions, chunks, the chunks' postings and their bounds, replacing those of the same document (from chunks on:
    of the same strategy), and adds the change to the stored term statistics; the report. All tables change at once, and what a
    document no longer has is deleted."""
    settings = settings or Settings()
    strategy = settings.chunk_strategy
    cut = chunk(provisions, strategy, settings.chunk_max_tokens, settings.chunk_overlap_tokens, settings.chunk_min_tokens, counter).select(*CHUNKS.fieldNames()).persist()
    tokens = cut.select("document_id", "strategy", "language", F.col("chunk_id").alias("id"), analyse(embedding_text(F.col("header"), F.col("text")), F.col("language")).alias("tokens")).withColumn("len", F.size("tokens")).persist()
    keys = ["document_id", "strategy", "language", "id", "len"]
    postings = tokens.select(*keys, F.explode("tokens").alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("tf"))
    own = {"strategy": strategy}
    names = documents.select("document_id").distinct()
    gone = [store.where_given(tables.read(name, schema), strategy=strategy).join(names, "document_id", "left_semi") for name, schema in (("postings", POSTINGS), ("lengths", LENGTHS))]
    stored = stored_statistics(tables, strategy)
    changed = statistics.change(statistics.of(*gone, ("language",)), statistics.of(postings, tokens, ("language",)))
    after = statistics.touched(stored, changed)
    # The average length as it is after this change; later changes are allowed for by searches.
    placed = postings.withColumn("block", F.col("document_id"))
    bounds = blocks.bounds(placed, statistics.index(placed, statistics.merged(stored, changed)), settings.bm25_b).withColumnRenamed("block", "document_id").withColumn("strategy", F.lit(strategy))
    try:
        tables.replace(documents, "document_id", {
            "documents": (documents, DOCUMENTS, {}), "provisions": (provisions, PROVISIONS, {}), "chunks": (cut, CHUNKS, own), "postings": (postings, POSTINGS, own), "lengths": (tokens, LENGTHS, own), "bounds": (bounds, BOUNDS, own),
        }, {
            "terms": (after.terms.withColumn("strategy", F.lit(strategy)), TERMS, own, changed.terms, ["term", "language"]), "totals": (after.totals.withColumn("strategy", F.lit(strategy)), TOTALS, own, changed.totals, ["language"]),
        }, batch)
    finally:
        tokens.unpersist()
        cut.unpersist()
    now = tables.read("chunks", CHUNKS).join(documents.select("document_id"), "document_id", "left_semi").where(F.col("strategy") == strategy)
    return store.ingest_report(documents, provisions, now)


def stored_statistics(tables: store.Tables, strategy: str) -> statistics.Statistics:
    terms, totals = (store.where_given(tables.read(name, schema), strategy=strategy).drop("strategy") for name, schema in (("terms", TERMS), ("totals", TOTALS)))
    return statistics.Statistics(terms, totals, ("language",))


def index(tables: store.Tables, embed: Callable[[Column], Column] = hashing_embedding, model: str = "hashing-64", dimensions: int = 64) -> DataFrame:
    """Adds vectors of new texts, refreshes the links of current chunks; the report."""
    hashes = store.hashed(tables.read("chunks", CHUNKS)).withColumn("embedding_text", embedding_text(F.col("header"), F.col("text")))
    cache = tables.read("embedding_cache", EMBEDDING_CACHE)
    report = store.index_report(hashes, cache, model).toPandas()  # one row, read before the cache grows
    fresh = store.pending(hashes.select("text_sha256", F.col("embedding_text").alias("text")), cache, model)
    tables.append("embedding_cache", store.embedded(fresh, embed, model, dimensions))
    links = hashes.select("chunk_id", F.lit(model).alias("model"), "text_sha256")
    tables.overwrite("chunk_embeddings", links, model)
    return tables.spark.createDataFrame(report)


class Searcher:
    """Hybrid search over stored tables for batches of questions (qid, text[, language])."""

    def __init__(self, tables: store.Tables, settings: Settings | None = None, embed: Callable[[Column], Column] = hashing_embedding, model: str = "hashing-64") -> None:
        self.settings, self.embed = settings or Settings(), embed
        chunks = store.where_given(tables.read("chunks", CHUNKS), strategy=self.settings.chunk_strategy)
        self.chunks = chunks.withColumn("id", F.col("chunk_id"))
        self.postings, self.bounds = (store.where_given(tables.read(name, schema), strategy=self.settings.chunk_strategy).withColumn("block", F.col("document_id")) for name, schema in (("postings", POSTINGS), ("bounds", BOUNDS)))
        self.statistics = stored_statistics(tables, self.settings.chunk_strategy)
        cache, links = tables.read("embedding_cache", EMBEDDING_CACHE), tables.read("chunk_embeddings", CHUNK_EMBEDDINGS)
        self.vectors = store.vector_matrix(links, cache, chunks, model).withColumnRenamed("chunk_id", "id")

    def questions(self, queries: DataFrame) -> DataFrame:
        """With language (detected if absent), tokens and vector."""
        language = F.coalesce("language", detect_language(F.col("text"))) if "language" in queries.columns else detect_language(F.col("text"))
        own = queries.withColumn("language", language)
        return own.withColumns({"tokens": analyse(F.col("text"), F.col("language")), "vector": self.embed(F.col("text"))})

    def lexical(self, asked: DataFrame) -> blocks.Blocked:
        """The stored index's part for the questions' terms: other postings, bounds and frequencies aren't read, and no lengths."""
        terms = lexical.asked_terms(asked)
        own = lexical.only(self.postings.select("id", "language", "block", "len", "term", "tf"), terms)
        kept = statistics.Statistics(lexical.only(self.statistics.terms, terms), self.statistics.totals, self.statistics.by)
        return blocks.Blocked(own, lexical.only(self.bounds.select("language", "block", "term", "most", "base"), terms), statistics.index(own, kept), self.settings.bm25_b)

    def search(self, queries: DataFrame, signals: tuple[str, ...] | None = None, weights: Mapping[str, float] | None = None, sources: list[str] | None = None, limit: int | None = None) -> DataFrame:
        asked = self.questions(queries)
        hits = retrieval.search(asked, self.chunks, self.lexical(asked) if "bm25" in (signals or self.settings.signals) else None, self.vectors, self.settings, signals, weights, sources, limit, same=("language",))
        return hits.join(self.chunks.select("id", "header", "text"), "id")

    def answer(self, queries: DataFrame, complete: Callable[[Column, Column], Column], **more) -> DataFrame:
        hits = self.search(queries, **more).withColumnRenamed("header", "breadcrumb")
        return answers.answered(self.questions(queries).select("qid", "text", "language"), hits, complete)

    def evaluate(self, cases: DataFrame, limit: int = 5, configurations: Mapping[str, Mapping[str, float]] = CONFIGURATIONS) -> DataFrame:
        """Scores of every configuration on cases (id, question, language, expected_provisions, ord), in one plan."""
        asked = self.questions(cases.select(F.col("id").alias("qid"), F.col("question").alias("text"), "language"))
        hits = retrieval.compare(asked, self.chunks, self.lexical(asked), self.vectors, self.settings, limit, configurations, same=("language",))
        lists = hits.groupBy("config", "qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "provision_ids"))), lambda x: x["provision_ids"]).alias("retrieved"))
        names = cases.sparkSession.createDataFrame([(c,) for c in configurations], "config string")
        every = cases.select("id", "ord", F.col("expected_provisions").alias("expected")).crossJoin(F.broadcast(names))
        full = every.join(lists.withColumnRenamed("qid", "id"), ["config", "id"], "left").withColumn("retrieved", F.coalesce("retrieved", F.array().cast("array<array<string>>")))
        return evaluation.retrieval_scores(full, limit, by=("config",))
