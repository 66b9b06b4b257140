"""Settings of linking; defaults as published."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Weights:
    token_overlap: float = 0.35
    fuzzy_similarity: float = 0.30
    acronym_signal: float = 0.20
    semantic_similarity: float = 0.15


@dataclass(frozen=True)
class Penalties:
    numeric_mismatch: float = 0.30
    numeric_one_side_only: float = 0.10


@dataclass(frozen=True)
class Thresholds:
    t_high: float = 0.92
    t_low: float = 0.75
    margin: float = 0.06


@dataclass(frozen=True)
class Candidates:
    max_total: int = 500
    max_lexical: int = 300
    max_embedding: int = 200
    use_k_first: bool = True


@dataclass(frozen=True)
class Arbitration:
    enabled: bool = False
    top_k: int = 3
    global_call_cap: int = 50
    min_confidence: float = 0.75
    forbid_both_single_token: bool = True


@dataclass(frozen=True)
class Embedding:
    enabled: bool = False
    neighbors: int = 100
    cache_dir: str = ""  # a folder that all machines share; without one embeddings live for the session
    batch_size: int = 250


@dataclass(frozen=True)
class Config:
    scoring: Weights = field(default_factory=Weights)
    penalties: Penalties = field(default_factory=Penalties)
    thresholds: Thresholds = field(default_factory=Thresholds)
    candidates: Candidates = field(default_factory=Candidates)
    arbitration: Arbitration = field(default_factory=Arbitration)
    embedding: Embedding = field(default_factory=Embedding)
    acronym_min_length: int = 3
    strip_prefix_designators: bool = False
    strip_categories: tuple[str, ...] = ("stopwords",)

    def stripping(self, *categories: str) -> Config:
        """With further categories of words to strip, each once."""
        return replace(self, strip_categories=tuple(dict.fromkeys((*self.strip_categories, *categories))))
