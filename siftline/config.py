"""The engine's settings: one frozen record, with overrides from a mapping (environment) or the Spark session."""

from __future__ import annotations

import dataclasses
import os
from collections.abc import Mapping

ANALYZERS = ("whitespace", "regex", "regex_stem", "regex_stem_stop")
DISTANCES = ("Cosine", "Dot", "Euclid", "Manhattan")
MODES = ("dense", "sparse", "hybrid")
CONTRACTS = ("answer_overlap", "point_id", "group_id", "source_row_ordinal", "candidate_span_overlap")
STRATEGIES = ("raw_candidate", "whole_row", "dpr_window", "parent_dedup", "min_context", "parent_child")
TRUE = ("1", "true", "yes", "on")


@dataclasses.dataclass(frozen=True)
class EngineConfig:
    """All defaults that decide results. Ranges are checked on creation."""

    dataset_name: str = "nq_sample"
    dataset_split: str = "train"
    id_field: str = "id"
    text_field: str = "text"
    source_field: str = "title"
    max_passages: int | None = None
    max_raw_rows: int | None = None
    max_chunk_rows: int | None = None
    max_index_rows: int | None = None
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    bm25_epsilon: float = 0.25
    analyzer: str = "regex_stem_stop"
    soft_tokens: int = 60
    hard_tokens: int = 20
    target_tokens: int = 160
    max_tokens: int = 300
    context_token_cap: int = 400
    distance: str = "Cosine"
    rrf_k: int = 60
    dense_weight: float = 0.5
    sparse_weight: float = 1.0
    retrieve_k: int = 50
    rerank_k: int | None = None
    rerank_enabled: bool = False
    rerank_context_token_budget: int = 384
    dedupe_enabled: bool = True
    generation_context_token_budget: int = 1_500
    min_citations: int = 1
    embed_batch: int = 64

    def __post_init__(self) -> None:
        for name in ("max_passages", "max_raw_rows", "max_chunk_rows", "max_index_rows", "rerank_k"):
            if (v := getattr(self, name)) is not None and v < 1:
                raise ValueError(f"{name} must be at least 1")
        for name in ("soft_tokens", "hard_tokens", "target_tokens", "max_tokens", "context_token_cap", "rrf_k", "retrieve_k", "rerank_context_token_budget", "generation_context_token_budget", "min_citations", "embed_batch"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1")
        if not self.bm25_k1 > 0 or not 0 <= self.bm25_b <= 1 or self.bm25_epsilon < 0 or min(self.dense_weight, self.sparse_weight) < 0:
            raise ValueError("BM25 needs k1 > 0, 0 <= b <= 1, epsilon >= 0; weights must not be negative")
        if self.analyzer not in ANALYZERS or self.distance not in DISTANCES:
            raise ValueError(f"unknown analyzer {self.analyzer!r} or distance {self.distance!r}")

    def replace(self, **changes) -> EngineConfig:
        return dataclasses.replace(self, **changes)


def _parse(kind: str, text: str):
    if "bool" in kind:
        return text.strip().lower() in TRUE
    if "int" in kind:
        return int(text) if text.strip() else None
    return float(text) if "float" in kind else text


def from_mapping(values: Mapping[str, str], prefix: str = "RAG_", base: EngineConfig | None = None) -> EngineConfig:
    """Settings from names such as ``RAG_BM25_K1``. A cap of passages is also the cap of raw rows unless that is set itself."""
    base = base or EngineConfig()
    changes = {}
    for f in dataclasses.fields(EngineConfig):
        if (text := values.get(prefix + f.name.upper())) is not None:
            changes[f.name] = _parse(str(f.type), text)
    if "max_passages" in changes and "max_raw_rows" not in changes:
        changes["max_raw_rows"] = changes["max_passages"]
    return base.replace(**changes)


def from_environment() -> EngineConfig:
    return from_mapping(os.environ)


def from_session(spark, base: EngineConfig | None = None) -> EngineConfig:
    """Settings from ``spark.siftline.<field>``."""
    found = {f.name: v for f in dataclasses.fields(EngineConfig) if (v := spark.conf.get(f"spark.siftline.{f.name}", None)) is not None}
    return from_mapping({"RAG_" + k.upper(): v for k, v in found.items()}, base=base)
