"""BM25: index tables and batched search."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Asked terms that are listed in a filter, so that scans of stored postings skip what they don't hold; more are joined.
LISTED = 5_000
#: Asked terms that are broadcast; more are joined by a shuffle.
SENT = 1_000_000
#: Stands behind the tokens of a document; no token.
MARK = "\0"


@dataclass(frozen=True)
class Lexical:
    """postings (id, term, tf, len), terms (term, df), totals (n, avgdl), all with the columns ``by``: an index for each of their
    values, such as a language."""

    postings: DataFrame
    terms: DataFrame
    totals: DataFrame
    by: tuple[str, ...] = ()


def asked_terms(queries: DataFrame) -> DataFrame:
    """Distinct terms of queries (tokens)."""
    return queries.select(F.explode("tokens").alias("term")).distinct()


def only(rows: DataFrame, asked: DataFrame, *more: str) -> DataFrame:
    """Rows whose term is one of the asked or of ``more``: by a filter that scans can use, a broadcast, or a join, by their number."""
    some = [r["term"] for r in asked.limit(LISTED + 1).collect()]
    if len(some) <= LISTED:
        return rows.where(F.col("term").isin(*some, *more))
    every = asked.select("term").unionByName(asked.sparkSession.createDataFrame([(x,) for x in more], "term string")) if more else asked
    return rows.join(sent(every), "term", "left_semi")


def sent(asked: DataFrame) -> DataFrame:
    """The rows, to be broadcast unless they are more than SENT."""
    return F.broadcast(asked) if asked.limit(SENT + 1).count() <= SENT else asked


def build(docs: DataFrame, id_col: str, tokens_col: str, by: tuple[str, ...] = (), asked: DataFrame | None = None) -> Lexical:
    """Index of documents with an array of tokens. Documents without tokens count for n and avgdl. With ``asked`` (term) it
    holds only those terms, which are sifted before anything is grouped."""
    own = docs.select(F.col(id_col).alias("id"), *by, F.coalesce(F.col(tokens_col), F.array().cast("array<string>")).alias("tokens"))
    if asked is None:
        postings = own.select("id", *by, F.size("tokens").alias("len"), F.explode("tokens").alias("term")).groupBy("id", *by, "len", "term").agg(F.count("*").alias("tf"))
        return of(postings, own.select("id", *by, F.size("tokens").alias("len")), by)
    return _dealt(own, by, asked)


def _dealt(own: DataFrame, by: tuple[str, ...], asked: DataFrame) -> Lexical:
    """The index of some terms, from one exchange by id: MARK behind a document's tokens carries its length, so postings, df and
    totals all read what one pass over the texts has written, and scores of a document are summed where its postings are."""
    tokens = F.explode(F.concat("tokens", F.array(F.lit(MARK))))
    # Without nulls no condition on them is inferred, which would make another exchange of it.
    each = own.select("id", *by, F.size("tokens").alias("len"), tokens.alias("term")).withColumn("term", F.coalesce("term", F.lit("")))
    counted = only(each, asked, MARK).repartition("id").groupBy("id", *by, "len", "term").agg(F.count_if(F.col("term") != MARK).alias("tf"), F.count("*").alias("times"))
    # Conditions on counts, not on the term: they stay behind the exchange. Terms and totals are the same rows by term, told apart by
    # ``tokens``, which only MARK has: as both read both counts, one pass over what the exchange wrote serves them.
    postings = counted.where("tf > 0").select("id", *by, "len", "term", "tf")
    every = counted.groupBy(*by, "term").agg(F.sum(F.when(F.col("tf") > 0, 1).otherwise(F.col("times"))).alias("df"), F.sum(F.when(F.col("tf") == 0, F.col("len") * F.col("times"))).alias("tokens"))
    terms = every.where("tokens is null").select(*by, "term", "df")
    totals = every.where("tokens is not null").groupBy(*by).agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n"), F.coalesce(F.sum("tokens") / F.sum("df"), F.lit(0.0)).alias("avgdl"))
    return Lexical(postings, terms, totals, by)


def of(postings: DataFrame, stats: DataFrame, by: tuple[str, ...] = ()) -> Lexical:
    """The index of postings (id, by, len, term, tf) and the lengths of all documents (id, by, len)."""
    terms = postings.groupBy(*by, "term").agg(F.count("*").alias("df"))
    totals = stats.groupBy(*by).agg(F.count("*").alias("n"), F.coalesce(F.avg("len"), F.lit(0.0)).alias("avgdl"))
    return Lexical(postings, terms, totals, by)


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def with_totals(df: DataFrame, index: Lexical) -> DataFrame:
    """One row of totals for each value of ``by``: a handful."""
    totals = F.broadcast(index.totals)
    return df.join(totals, list(index.by)) if index.by else df.crossJoin(totals)


def term_stats(index: Lexical) -> DataFrame:
    return with_totals(index.terms, index).select(*index.by, "term", "df", idf(F.col("n"), F.col("df")).alias("idf"))


def search(index: Lexical, queries: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, digits: int = 6) -> DataFrame:
    """(qid, id, score, position) of the best ``k`` for each query (qid, tokens, and the index's ``by``), which meets its
    own index only. A query's repeated tokens count again; scores are rounded before ranking, ties go to the smaller id.
    """
    asked = queries.select("qid", *index.by, F.explode("tokens").alias("term")).groupBy("qid", *index.by, "term").agg(F.count("*").alias("times"))
    on = [*index.by, "term"]
    weighted = with_totals(asked.join(index.terms, on), index).select("qid", *on, "times", idf(F.col("n"), F.col("df")).alias("idf"), "avgdl")
    hits = index.postings.join(F.broadcast(weighted) if asked.limit(SENT + 1).count() <= SENT else weighted, on)
    ratio = F.when(F.col("avgdl") == 0, 1.0).otherwise(F.col("len") / F.col("avgdl"))
    part = F.col("times") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * ratio))
    return best(hits.groupBy("qid", "id").agg(F.round(F.sum(part), digits).alias("score")), k)


def best(scores: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each query by (score, id), with their position from 1."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return scores.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)
