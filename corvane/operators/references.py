"""Explicit references in questions, and the passages they name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import provision_id

# How acts and provisions are written.
SOURCE_HINTS = (
    ("ai act", "ai_act"), ("ai-act", "ai_act"), ("aia", "ai_act"), ("2024/1689", "ai_act"), ("reglement ia", "ai_act"), ("règlement ia", "ai_act"),
    ("gdpr", "gdpr"), ("rgpd", "gdpr"), ("2016/679", "gdpr"),
)
ARTICLE = r"(?iu)\b(?:articles?|arts?\.?)\s*(?:premier|(\d{1,3}))(?:\s*(?:\(\s*(\d{1,2})\s*\)|,?\s*(?:§|paragraphe|paragraph|par\.)\s*(\d{1,2})))?"
ANNEX = r"(?iu)\b(?:annexe?s?)\s*([IVXL]{1,6}|\d{1,2})\b"
RECITAL = r"(?iu)\b(?:recitals?|considerants?|considérants?)\s*\(?(\d{1,3})\)?"


def detect_source(text: Column) -> Column:
    """The act of the first hint in list order that the text contains; null if none."""
    found = F.lit(None).cast("string")
    for needle, source in reversed(SOURCE_HINTS):
        found = F.when(F.contains(F.lower(text), F.lit(needle)), source).otherwise(found)
    return found


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def references_column(text: Column) -> Column:
    """Array of (kind, number, paragraph, source_id): articles, then annexes, then recitals, each in order of appearance."""
    source = detect_source(text)
    none = F.lit(None).cast("string")

    def row(kind: str, number: Column, paragraph: Column = none) -> Column:
        return F.struct(F.lit(kind).alias("kind"), number.alias("number"), paragraph.alias("paragraph"), source.alias("source_id"))

    numbers, first, second = (_all(text, ARTICLE, g) for g in (1, 2, 3))
    articles = F.transform(F.arrays_zip(numbers.alias("n"), first.alias("a"), second.alias("b")), lambda z: row("art", F.when(z["n"] == "", "1").otherwise(z["n"]), F.nullif(F.concat(z["a"], z["b"]), F.lit(""))))
    annexes = F.transform(_all(text, ANNEX, 1), lambda n: row("anx", F.upper(n)))
    recitals = F.transform(_all(text, RECITAL, 1), lambda n: row("rct", n))
    return F.concat(articles, annexes, recitals)


def find_references(queries: DataFrame) -> DataFrame:
    """(qid, seq, kind, number, paragraph, source_id) of queries (qid, text), seq from 0."""
    return queries.select("qid", F.posexplode(references_column(F.coalesce("text", F.lit("")))).alias("seq", "r")).select("qid", "seq", "r.*")


def reference_hits(queries: DataFrame, chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """(qid, id, position): chunks (id, ord, provision_ids) of the provisions that queries name, in order.

    A reference that names no act goes to every act of ``sources`` (source_id), in order of name. A chunk met again
    takes its last position.
    """
    refs = find_references(queries)
    of_provision = chunks.select("id", "ord", F.explode("provision_ids").alias("provision_id"))
    named = refs.where("source_id is not null").select("qid", "seq", "source_id", provision_id(F.col("source_id"), F.col("kind"), F.col("number")).alias("provision_id")).join(of_provision, "provision_id")
    # Without an act, references meet provisions by kind and number, so nothing is multiplied by the number of acts.
    part = lambda group: F.regexp_extract("provision_id", r"^(.*):([^:]*:[^:]*)$", group)
    local = of_provision.select("id", "ord", "provision_id", part(1).alias("source_id"), part(2).alias("local")).join(sources.select("source_id").distinct(), "source_id", "left_semi")
    fanned = refs.where("source_id is null").select("qid", "seq", F.concat_ws(":", "kind", "number").alias("local")).join(local, "local")
    wanted = named.unionByName(fanned.drop("local"))
    order = Window.partitionBy("qid").orderBy("seq", "source_id", "ord", "id")
    hits = wanted.withColumn("position", F.row_number().over(order))
    return hits.groupBy("qid", "id").agg(F.max("position").alias("position"))
