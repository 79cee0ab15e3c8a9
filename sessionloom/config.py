"""Settings of the command line: built-in values, then a JSON file, then SESSIONLOOM_* variables."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace

from .functions.chunking import ChunkPolicy
from .operators.embedding import EmbeddingProvider, HashEmbedding, HttpEmbedding


@dataclass(frozen=True)
class Settings:
    max_tokens: int = 512
    overlap_tokens: int = 64
    limit: int = 5
    dense_limit: int = 8
    lock_wait_seconds: float = 0.0
    embedding_url: str = ""
    embedding_model: str = "hash"
    embedding_width: int = 64
    request_timeout_seconds: float = 60.0

    def __post_init__(self):
        if not 1 <= self.limit <= 10 or not 1 <= self.dense_limit <= 200 or self.embedding_width < 1 or self.request_timeout_seconds <= 0 or self.lock_wait_seconds < 0:
            raise ValueError("limit lies in 1..10, dense_limit in 1..200, widths and times are positive")
        self.policy()

    def policy(self) -> ChunkPolicy:
        return ChunkPolicy(self.max_tokens, self.overlap_tokens)

    def provider(self) -> EmbeddingProvider:
        if self.embedding_url:
            return HttpEmbedding(self.embedding_url, self.embedding_model, self.embedding_width, timeout_seconds=self.request_timeout_seconds)
        return HashEmbedding(self.embedding_width)

    def manifest(self) -> dict:
        """What an index depends on: another value needs a rebuild."""
        return {"max_tokens": self.max_tokens, "overlap_tokens": self.overlap_tokens, "embedding": {"model": self.embedding_model, "width": self.embedding_width}}


def load(path: str | None = None, env: Mapping[str, str] = os.environ) -> Settings:
    """Settings from a file and the environment; unknown names in the file and values of a wrong type are errors."""
    kinds = {f.name: type(f.default) for f in fields(Settings)}
    found: dict[str, object] = {}
    if path:
        with open(path) as f:
            found = json.load(f)
        if unknown := sorted(set(found) - set(kinds)):
            raise ValueError(f"unknown settings: {', '.join(unknown)}")
    found |= {n: env[f"SESSIONLOOM_{n.upper()}"] for n in kinds if f"SESSIONLOOM_{n.upper()}" in env}
    try:
        return replace(Settings(), **{n: kinds[n](v) for n, v in found.items()})
    except (TypeError, ValueError) as e:
        raise ValueError(f"settings: {e}") from None
