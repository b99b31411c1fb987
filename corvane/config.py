"""Settings that fix results, with their defaults."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    chunk_strategy: str = "structural"
    chunk_max_tokens: int = 512
    chunk_overlap_tokens: int = 64
    chunk_min_tokens: int = 48
    top_k: int = 8
    candidates: int = 40
    rrf_k: int = 60
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    weights: dict[str, float] = field(default_factory=lambda: {"reference": 2.0, "dense": 1.0, "bm25": 0.4})
    signals: tuple[str, ...] = ("reference", "dense")
    agent_max_steps: int = 8
    agent_max_cost_usd: float = 0.50
    agent_token_budget: int = 120_000
    tool_timeout_seconds: float = 20.0
    max_corrections: int = 1
    min_section_words: int = 5
    cache_read_multiplier: float = 0.1
    cache_write_multiplier: float = 1.25
    environment: str = "dev"
    tracing: bool = False
    sources_file: str = "data/sources.json"
    raw_dir: str = "data/raw"
    tables_dir: str = "data/tables"

    def __post_init__(self) -> None:
        if not re.fullmatch(r"[a-z0-9_-]{1,40}", self.environment) or self.environment.startswith("langfuse"):
            raise ValueError("environment: 1 to 40 of a-z, 0-9, _ and -")

    @classmethod
    def from_env(cls, prefix: str = "CORVANE_") -> Settings:
        kinds = {"int": int, "float": float, "str": str, "bool": lambda x: x.lower() in ("1", "true", "yes")}
        given = {k: kinds[f.type](v) for k, f in cls.__dataclass_fields__.items() if f.type in kinds and (v := os.environ.get(prefix + k.upper())) is not None}
        return cls(**given)

    def public(self) -> dict[str, object]:
        """For display: paths and numbers, no secrets are kept here."""
        return {k: getattr(self, k) for k in self.__dataclass_fields__}


#: The six retrieval configurations that are compared.
CONFIGURATIONS: dict[str, dict[str, float]] = {
    "bm25 only": {"bm25": 1.0},
    "dense only": {"dense": 1.0},
    "dense + bm25": {"dense": 1.0, "bm25": 1.0},
    "dense + bm25 x0.4": {"dense": 1.0, "bm25": 0.4},
    "dense + references": {"dense": 1.0, "reference": 2.0},
    "all signals": {"dense": 1.0, "bm25": 0.4, "reference": 2.0},
}
