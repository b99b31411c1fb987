"""Traces as a table: observations with redacted attributes, and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import redact, redact_map


def observations(rows: DataFrame, rate: float = 1.0, enabled: bool = True) -> DataFrame:
    """Rows of ``schemas.AUDIT`` ready to leave: a share of traces by hash of their id, personal data replaced."""
    if not enabled:
        return rows.limit(0)
    kept = rows if rate >= 1 else rows.where(F.pmod(F.xxhash64("trace_id"), F.lit(1_000_000)) < rate * 1_000_000)
    clean = F.when(F.col("metadata").isNotNull(), F.map_concat(F.map_filter("metadata", lambda k, v: redact(v).eqNullSafe(v)), redact_map(F.col("metadata"))))
    return kept.withColumns({"input": redact(F.col("input")), "output": redact(F.col("output")), "metadata": clean})


def patches(spans: DataFrame, attributes: str = "attributes") -> DataFrame:
    """Only the attributes that redaction changes, of spans that have any."""
    return spans.withColumn(attributes, redact_map(F.col(attributes))).where(F.size(attributes) > 0)


def redact_all(values: str):
    """An array of strings, redacted; null when nothing changes."""
    new = F.transform(values, redact)
    return F.when(new != F.col(values), new)
