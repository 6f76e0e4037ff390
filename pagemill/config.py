"""Parameters of the engine, and layered configuration."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, replace
from typing import Any


@dataclass(frozen=True)
class ChunkConfig:
    target_chars: int = 900
    max_chars: int = 1300
    min_chars: int = 120
    context_prefix: bool = True


@dataclass(frozen=True)
class RetrievalConfig:
    k1: float = 1.5
    b: float = 0.75
    candidate_k: int = 20
    default_k: int = 5
    rrf_k: int = 60
    alpha: float = 0.5
    fusion: str = "rrf"
    mode: str = "hybrid"
    rerank: str = "none"
    lexical_weight: float = 0.20
    semantic_weight: float = 0.80
    coverage_weight: float = 0.0
    #: Postings that a batch of queries may score one by one; beyond that a
    #: search in rounds opens only the blocks that can matter. Both are exact.
    plain_postings: int = 20_000_000

    def __post_init__(self) -> None:
        if self.mode not in ("semantic", "keyword", "hybrid"):
            raise ValueError(f"unknown retrieval mode: {self.mode}")
        if self.fusion not in ("rrf", "weighted"):
            raise ValueError(f"unknown fusion: {self.fusion}")
        weights = (self.lexical_weight, self.semantic_weight, self.coverage_weight)
        if min(weights) < 0 or sum(weights) <= 0:
            raise ValueError("rerank weights must be non-negative and not all zero")


@dataclass(frozen=True)
class AgentConfig:
    max_steps: int = 24
    max_products: int = 4
    max_evidence_chunks: int = 80
    llm_confidence: float = 0.7
    llm_confidence_threshold: float = 0.55
    word_boundary: bool = False


@dataclass(frozen=True)
class GroundingConfig:
    support_threshold: float = 0.35
    number_strict: bool = True
    verify_conclusions: bool = False
    strip_unsupported: bool = True
    min_supported_rate: float = 0.5
    max_note_claims: int = 5
    min_claim_chars: int = 12
    note_chars: int = 160
    excerpt_chars: int = 500
    second_pass: bool = True
    #: Words that containment ignores. None by default, as verdicts then agree
    #: with the engine that this one replaces; text.GROUNDING_STOPWORDS is the
    #: list that its documentation names.
    stopwords: tuple[str, ...] = ()


@dataclass(frozen=True)
class GenerationConfig:
    evidence_chars: int = 6000
    comparison_chars: int = 8000
    excerpt_chars: int = 1200
    citation_excerpt_chars: int = 300
    extractive_chunks: int = 6
    extractive_sentences: int = 2


@dataclass(frozen=True)
class EngineConfig:
    chunking: ChunkConfig = field(default_factory=ChunkConfig)
    retrieval: RetrievalConfig = field(default_factory=RetrievalConfig)
    agent: AgentConfig = field(default_factory=AgentConfig)
    grounding: GroundingConfig = field(default_factory=GroundingConfig)
    generation: GenerationConfig = field(default_factory=GenerationConfig)

    def overlay(self, overrides: dict[str, dict[str, Any]]) -> EngineConfig:
        """A configuration with some fields of some sections replaced."""
        known = {f.name for f in fields(self)}
        if unknown := set(overrides) - known:
            raise ValueError(f"unknown configuration sections: {sorted(unknown)}")
        return replace(self, **{k: replace(getattr(self, k), **v) for k, v in overrides.items()})


def deep_merge(base: dict, over: dict) -> dict:
    """over laid upon base; objects merge key by key, all else is replaced."""
    out = dict(base)
    for k, v in over.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load_layers(path: str, read=None, key: str = "base_config", depth: int = 20) -> dict:
    """A JSON configuration with the chain of files that `key` names beneath it.
    read gives the text of a path (a local file unless told otherwise)."""
    if read is None:

        def read(p: str) -> str:
            with open(p, encoding="utf-8") as f:
                return f.read()

    own = json.loads(read(path))
    base = own.pop(key, None)
    if base is None:
        return own
    if depth <= 0:
        raise ValueError("configuration chain is too deep")
    if "/" not in base and "/" in path:
        base = path.rpartition("/")[0] + "/" + base
    return deep_merge(load_layers(base, read, key, depth - 1), own)
