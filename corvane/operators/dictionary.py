"""A dictionary of a corpus's terms: every distinct (language, term) once, with a dense id, its stem and the id of the stem.

Python stems each distinct term once instead of each token of each text; tokens get their stems by a join. Ids count the terms in
order of a digest's first digits, then of language and term: a group for each of the digits' values is numbered by itself, and the
sums of the groups before it are added, so no task sorts all terms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stem import stem_tokens

#: Hexadecimal digits of the groups that ids are counted in: 4096 groups.
DIGITS = 3
#: Entries that are broadcast; more are joined by a shuffle.
SENT = 1_000_000


def counted(postings: DataFrame) -> DataFrame:
    """Distinct (language, term) of postings (id, language, term, tf), with df and tf."""
    return postings.groupBy("language", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


def numbered(terms: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """Distinct rows (language, term) with their ``id``, from 0 without gaps. With ``carried`` columns the terms must be distinct already."""
    own = terms.select("language", "term", *carried) if carried else terms.select("language", "term").distinct()
    # Without nulls no condition on it is inferred, which would make another exchange of the terms.
    own = own.withColumn("part", F.coalesce(F.substring(F.sha2("term", 256), 1, DIGITS), F.lit("")))
    # A row for each group, 16^DIGITS at most. Carried columns are read here too: the groups and the places then come from one exchange.
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    n = F.count_if(F.hash(*carried) <= 2**31 - 1) if carried else F.count("*")  # every row
    parts = own.groupBy("part").agg(n.alias("n")).withColumn("before", F.coalesce(before, F.lit(0))).drop("n")
    place = F.row_number().over(Window.partitionBy("part").orderBy("language", "term"))
    return own.withColumn("place", place).join(F.broadcast(parts), "part").select("language", "term", (F.col("before") + F.col("place") - 1).alias("id"), *carried)


def stemmed(terms: DataFrame) -> DataFrame:
    """Distinct rows (language, term) with their ``stem``."""
    own = terms.select("language", "term").distinct()
    return own.withColumn("stem", F.element_at(stem_tokens(F.array("term"), F.col("language")), 1))


def mapped(postings: DataFrame, entries: DataFrame, column: str) -> DataFrame:
    """Postings (id, language, term, tf) by another column of the dictionary in place of the term: counts of one id add up."""
    some = F.broadcast(entries) if entries.limit(SENT + 1).count() <= SENT else entries
    met = postings.join(some.select("language", "term", F.col(column).alias("__to")), ["language", "term"])
    return met.groupBy("id", "language", F.col("__to").alias("term")).agg(F.sum("tf").alias("tf"))
