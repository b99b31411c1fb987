"""Training-corpus pipeline: toxicity, exact dedup, near dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns the columns of
``documents``; the last returns packed pieces. ``run`` writes each stage's result as Parquet into the shared folder.

Defined cases, for every stage: a null text counts as empty; a null id is an id like others and stays null; rows that repeat an id are
judged by their own text; very long texts are read whole; other columns, whatever their names, pass through up to the last stage; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.llm.common import table, written
from corvane.llm.decontaminate import decontaminate
from corvane.llm.exact_dedup import exact_dedup
from corvane.llm.packing import pack
from corvane.llm.queries import remainder, tokenizer_path
from corvane.llm.simhash import near_dedup
from corvane.llm.toxicity import keep_clean, train


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the network, learnt from the labelled rows of the training folds, scores below 0.5."""
    labels = table(spark, sf_dir, "labels")
    return keep_clean(docs, train(docs, labels.where(remainder("doc_id", 5) != 0)))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal without white space: the longest, then of smallest id; equal rows count once."""
    return exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the smallest id, of each component of texts within 2 bits or with a 5-word similarity of 0.8 or more."""
    return near_dedup(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no passage of the benchmark, also with a fifth of its words substituted."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all texts, packed best-fit into sequences of at most 2048 tokens."""
    return pack(docs, tokenizer_path())


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("decontamination", drop_leaks), ("packing", packed)]

#: Toxicity scores and tokens can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
