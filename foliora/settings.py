"""Settings of the engine: plain values, passed explicitly."""

from __future__ import annotations

import dataclasses
import os
from collections.abc import Mapping

from foliora.errors import ConfigurationError
from foliora.operators import answer, chunking, hybrid


@dataclasses.dataclass(frozen=True)
class Settings:
    root: str = "storage"
    chunk_strategy: str = "semantic"
    chunk_size: int = chunking.SIZE
    chunk_overlap: int = chunking.OVERLAP
    chunk_min_chars: int = chunking.LEAST
    breakpoint_threshold: float = chunking.BREAK
    page_merge_min_score: float = chunking.PAGE_MERGE
    max_units: int = chunking.MAX_UNITS
    retrieval_strategy: str = "hybrid"
    vector_weight: float = hybrid.VECTOR_WEIGHT
    candidate_multiplier: int = hybrid.MULTIPLIER
    top_k: int = 5
    context_min_score: float = answer.MIN_SCORE
    context_min_chars: int = answer.MIN_CHARS
    context_max_chars: int = answer.MAX_CHARS
    multi_query_count: int = 3
    load_strategy: str = "text"
    embedding_size: int = 64

    def __post_init__(self):
        chunking.check_parameters(self.chunk_size, self.chunk_overlap, self.chunk_min_chars, self.breakpoint_threshold, self.page_merge_min_score, self.max_units)
        chunking.strategy(self.chunk_strategy)
        if self.retrieval_strategy not in ("vector", "keyword", "hybrid"):
            raise ConfigurationError(f"Unknown retrieval strategy: {self.retrieval_strategy}")
        if not 0 <= self.vector_weight <= 1:
            raise ConfigurationError("vector_weight must be within [0, 1]")
        if self.top_k <= 0 or self.candidate_multiplier <= 0 or self.context_max_chars <= 0 or self.multi_query_count <= 0:
            raise ConfigurationError("top_k, candidate_multiplier, context_max_chars and multi_query_count must be above 0")

    @classmethod
    def from_environment(cls, env: Mapping[str, str] | None = None) -> Settings:
        """Settings from variables named ``FOLIORA_`` and the field in capitals."""
        env = os.environ if env is None else env
        values = {}
        for f in dataclasses.fields(cls):
            raw = env.get(f"FOLIORA_{f.name.upper()}")
            if raw is not None:
                try:
                    values[f.name] = type(f.default)(raw)
                except ValueError as e:
                    raise ConfigurationError(f"{f.name}: {raw!r} is not valid") from e
        return cls(**values)
