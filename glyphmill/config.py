"""Settings of the retrieval engine and their validation."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

# Tags that stand on lines of their own.
BLOCK_TAGS = (
    "p", "div", "li", "tr", "td", "th", "table", "blockquote", "section", "article",
    "figure", "figcaption", "pre", "h1", "h2", "h3", "h4", "h5", "h6",
)
# Tags that break a line.
BREAK_TAGS = ("br", "hr")
# What a switch that is on may say.
_TRUE = {"1", "true", "yes", "on"}
# The modes that a setting may name.
_CHOICES = {
    "answer_mode": ("texte", "selection", "refus_puis_selection"),
    "selection_labels": ("chiffres", "lettres"),
    "selection_output": ("json", "texte"),
}


def flag(value: str | None, default: bool) -> bool:
    """A switch as people write it; absent or blank means the default."""
    return default if value is None or not value.strip() else value.strip().lower() in _TRUE


def rate(value: str) -> tuple[int, int]:
    """``"N/SECONDS"`` as a limit; both at least one."""
    n, _, window = value.partition("/")
    try:
        limit = int(n), int(window)
    except ValueError:
        raise ValueError(f"a rate limit reads N/SECONDS, not {value!r}") from None
    if min(limit) < 1:
        raise ValueError(f"both parts of a rate limit must be 1 or more: {value!r}")
    return limit


@dataclass(frozen=True)
class EngineConfig:
    """All knobs with their defaults; :meth:`from_env` reads ``GLYPHMILL_<NAME>``."""

    n_results: int = 5
    chunk_size: int = 600
    ingest_batch_size: int = 32
    embedding_timeout: int = 120
    distance_threshold: float = -1.0
    citations_required: bool = False
    answer_mode: str = "texte"
    selection_labels: str = "chiffres"
    selection_output: str = "json"
    hybrid_enabled: bool = True
    hybrid_candidates: int = 50
    hybrid_rrf_k: int = 10
    hybrid_vector_weight: float = 1.0
    hybrid_lexical_weight: float = 1.0
    login_rate: tuple[int, int] = (5, 60)
    register_rate: tuple[int, int] = (5, 3600)
    ask_rate: tuple[int, int] = (20, 60)
    backup_retention: int = 7
    language_enforcement: bool = True
    language_max_retries: int = 1
    embedding_model: str = "bge-m3"
    llm_model: str = "llama3.1"
    llm_provider: str = "ollama"
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    min_token_length: int = 3
    eval_k: int = 10
    language_dominance: float = 0.7
    grounding_min_length: int = 4
    embedding_margin: float = 5.0
    pipeline_version: str = "1"

    def __post_init__(self) -> None:
        at_least_one = ("n_results", "chunk_size", "ingest_batch_size", "embedding_timeout", "hybrid_candidates", "hybrid_rrf_k", "backup_retention", "eval_k")
        for name in at_least_one:
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be 1 or more")
        for name in ("hybrid_vector_weight", "hybrid_lexical_weight"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")
        if self.language_max_retries < 0:
            raise ValueError("language_max_retries must be 0 or more")
        for name, known in _CHOICES.items():
            if getattr(self, name) not in known:
                raise ValueError(f"{name} must be one of {', '.join(known)}")

    @classmethod
    def from_env(cls, env=None) -> EngineConfig:
        env = os.environ if env is None else env
        found = {}
        for f in fields(cls):
            raw = env.get(f"GLYPHMILL_{f.name.upper()}")
            if raw is None or not raw.strip():
                continue
            default = f.default
            found[f.name] = flag(raw, default) if isinstance(default, bool) else rate(raw) if isinstance(default, tuple) else type(default)(raw.strip())
        return cls(**found)

    @property
    def candidate_pool(self) -> int:
        return max(self.hybrid_candidates, self.n_results)


DEFAULTS = EngineConfig()
