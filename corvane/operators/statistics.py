"""Document frequencies and totals of a lexical index, kept up to date by signed changes.

Documents that go count -1 and those that come +1; the sums by term and by language are added to what is stored, so an update reads
the postings of the documents it touches and the statistics, not the corpus. A search then takes df, n and the average length as
they are stored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lexical


@dataclass(frozen=True)
class Statistics:
    """terms (by, term, df) and totals (by, n, tokens)."""

    terms: DataFrame
    totals: DataFrame
    by: tuple[str, ...] = ()


def of(postings: DataFrame, lengths: DataFrame, by: tuple[str, ...] = ()) -> Statistics:
    """Those of postings (by, id, term) and of the lengths of all documents (by, len)."""
    terms = postings.groupBy(*by, "term").agg(F.count("*").alias("df"))
    return Statistics(terms, lengths.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.col("len").cast("long")).alias("tokens")), by)


def of_tokens(docs: DataFrame, by: tuple[str, ...] = ()) -> Statistics:
    """Those of documents (id, by, tokens), from one pass over them: a row for each term of a document, and one of lexical.MARK for its length."""
    own = docs.select("id", *by, F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"))
    each = own.select("id", *by, F.size("tokens").alias("len"), F.explode(F.concat(F.array_distinct("tokens"), F.array(F.lit(lexical.MARK)))).alias("term")).withColumn("term", F.coalesce("term", F.lit("")))
    end = F.col("term") == lexical.MARK
    counted = each.groupBy("id", *by, "term").agg(F.count_if(end).alias("n"), F.sum(F.when(end, F.col("len")).otherwise(0)).alias("tokens"))
    # Both use both sums, so they share the exchange.
    terms = counted.where("n = 0 and tokens = 0").groupBy(*by, "term").agg(F.count("*").alias("df"))
    return Statistics(terms, counted.where("n > 0").groupBy(*by).agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens")), by)


def change(gone: Statistics, come: Statistics) -> Statistics:
    """What changes when documents go and others come: rows that stay as they are drop out."""
    return Statistics(_summed([(gone.terms, -1), (come.terms, 1)], [*gone.by, "term"], ["df"]), _summed([(gone.totals, -1), (come.totals, 1)], list(gone.by), ["n", "tokens"]), gone.by)


def merged(stored: Statistics, changed: Statistics) -> Statistics:
    """The statistics after a change; terms and languages without documents drop out."""
    return Statistics(_summed([(stored.terms, 1), (changed.terms, 1)], [*stored.by, "term"], ["df"]), _summed([(stored.totals, 1), (changed.totals, 1)], list(stored.by), ["n", "tokens"]), stored.by)


def touched(stored: Statistics, changed: Statistics) -> Statistics:
    """The new rows of the terms and languages that a change names, the only ones that need writing."""
    on = [*stored.by, "term"]
    totals = stored.totals.join(changed.totals.select(*stored.by), list(stored.by), "left_semi") if stored.by else stored.totals
    return merged(Statistics(stored.terms.join(changed.terms.select(*on), on, "left_semi"), totals, stored.by), changed)


def _summed(rows: list[tuple[DataFrame, int]], keys: list[str], values: list[str]) -> DataFrame:
    signed = [df.select(*keys, *((F.col(v) * sign).cast("long").alias(v) for v in values)) for df, sign in rows]
    total = signed[0]
    for df in signed[1:]:
        total = total.unionByName(df)
    changed = F.lit(False)
    for v in values:
        changed = changed | (F.col(v) != 0)
    return total.groupBy(*keys).agg(*(F.sum(v).alias(v) for v in values)).where(changed)


def index(postings: DataFrame, statistics: Statistics) -> lexical.Lexical:
    """The index of postings (by, id, term, tf, len), with df, n and average length as they are stored."""
    totals = statistics.totals.select(*statistics.by, "n", F.coalesce(F.try_divide("tokens", "n"), F.lit(0.0)).alias("avgdl"))
    return lexical.Lexical(postings, statistics.terms, totals, statistics.by)
