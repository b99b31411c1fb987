"""Checks of requests and structured outputs as predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import LANGUAGES, ROUTES


def valid_request(question: Column, k: Column, language: Column) -> Column:
    """A question of 3 to 2000 characters, 1 to 20 passages, a known language or none."""
    size = F.length(question).between(3, 2000)
    return F.coalesce(size, F.lit(False)) & F.coalesce(k.between(1, 20), F.lit(True)) & F.coalesce(language.isin(*LANGUAGES), F.lit(True))


def valid_score(score: Column) -> Column:
    """A judge's score: 0 to 2; what can't be read counts as 0."""
    return F.coalesce(F.when(score.between(0, 2), score), F.lit(0))


def valid_route(route: Column) -> Column:
    return F.coalesce(route.isin(*ROUTES), F.lit(False))
