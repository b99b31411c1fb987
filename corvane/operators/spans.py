"""Traces as trees of spans: depth, path and inclusive cost of every span by one recursive statement."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Levels of a trace at most; deeper ones are an error.
DEEPEST = 100

_ROLLUP = f"""
    WITH RECURSIVE down(trace_id, span_id, depth, path) MAX RECURSION LEVEL {DEEPEST} AS (
      SELECT trace_id, span_id, 0, cast(name AS STRING) FROM {{spans}} WHERE parent_id IS NULL
      UNION ALL
      SELECT s.trace_id, s.span_id, d.depth + 1, concat(d.path, '/', s.name) FROM down d JOIN {{spans}} s ON s.trace_id = d.trace_id AND s.parent_id = d.span_id),
    up(trace_id, ancestor, cost) MAX RECURSION LEVEL {DEEPEST} AS (
      SELECT trace_id, span_id, cost FROM {{spans}}
      UNION ALL
      SELECT u.trace_id, s.parent_id, u.cost FROM up u JOIN {{spans}} s ON s.trace_id = u.trace_id AND s.span_id = u.ancestor WHERE s.parent_id IS NOT NULL),
    total AS (SELECT trace_id, ancestor, count(*) AS spans, sum(cost) AS inclusive_cost FROM up GROUP BY trace_id, ancestor)
    SELECT d.trace_id, d.span_id, d.depth, d.path, t.spans, t.inclusive_cost FROM down d JOIN total t ON t.trace_id = d.trace_id AND t.ancestor = d.span_id"""


def rollup(spans: DataFrame) -> DataFrame:
    """(trace_id, span_id, depth, path, spans, inclusive_cost) of spans (trace_id, span_id, parent_id, name, cost): spans counts a span and all
    below it, inclusive_cost adds their costs (null costs count nothing). Spans whose root is missing have no place and drop out."""
    spark = spans.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")  # as many rows as there are spans, not a fixed number
    return spark.sql(_ROLLUP, spans=spans.select("trace_id", "span_id", "parent_id", "name", "cost"))
