"""Settings: defaults, bundled profiles, save and load."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, replace
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    evidence_k: int = 10
    max_sources: int = 5
    score_cutoff: int = 1
    chunk_chars: int = 5000
    overlap: int = 250
    page_size_limit: int | None = 1_280_000
    mmr_lambda: float = 1.0
    search_count: int = 8
    agent_evidence_n: int = 1
    context_prefix: str = "pqac"
    caption_radius: int = 1
    embedding: str = "sparse"
    group_by_question: bool = False
    background: str = ""
    temperature: float = 0.0

    def fingerprint(self) -> str:
        return hashlib.md5(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()  # noqa: S324

    def index_name(self, *parts: str) -> str:
        """A folder name from the settings that shape an index."""
        return hashlib.md5("|".join([*parts, self.embedding, str(self.chunk_chars), str(self.overlap)]).encode()).hexdigest()  # noqa: S324


# What each profile changes.
PROFILES = {
    "default": {},
    "fast": {"evidence_k": 5, "max_sources": 3},
    "debug": {"evidence_k": 2, "max_sources": 2},
    "high_quality": {"evidence_k": 20, "max_sources": 5, "chunk_chars": 7000, "overlap": 250},
    "clinical_trials": {"evidence_k": 15, "max_sources": 5, "chunk_chars": 9000, "overlap": 750},
    "search_only_clinical_trials": {"evidence_k": 15, "max_sources": 5, "chunk_chars": 9000, "overlap": 750},
    "wikicrow": {"evidence_k": 25, "max_sources": 12, "chunk_chars": 7000, "overlap": 1750, "search_count": 12},
    "contracrow": {"evidence_k": 30, "max_sources": 15, "chunk_chars": 7000, "overlap": 250},
    "openreview": {"chunk_chars": 3_000_000},
    "tier1_limits": {"evidence_k": 5, "max_sources": 3},
    "tier5_limits": {"evidence_k": 15, "max_sources": 5, "chunk_chars": 7000, "overlap": 250},
}


def profile(name: str = "default") -> Settings:
    return replace(Settings(), **PROFILES[name])


def save(settings: Settings, path: str) -> None:
    Path(path).write_text(json.dumps(asdict(settings), indent=2))


def load(path: str) -> Settings:
    return Settings(**json.loads(Path(path).read_text()))
