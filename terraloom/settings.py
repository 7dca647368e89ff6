"""Settings of the engine, from TERRALOOM_* environment variables."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    """Defaults; a field ``x`` is read from TERRALOOM_X, weights as name=value pairs with commas."""

    embedder: str = "local"
    embedding_dim: int = 1536
    vector_store: str = "local"
    chunk_size: int = 220
    top_k: int = 8
    rrf_k: int = 60
    rrf_weights: str = ""
    gnn_layers: int = 2
    gnn_seed: int = 1337
    sh_degree: int = 4

    def weights(self) -> dict[str, float] | None:
        pairs = [p.split("=") for p in self.rrf_weights.split(",") if p.strip()]
        return {k.strip(): float(v) for k, v in pairs} or None

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> "Settings":
        env = dict(os.environ) if env is None else env
        found = {}
        for f in fields(cls):
            raw = env.get(f"TERRALOOM_{f.name.upper()}")
            if raw is not None and raw.strip():
                found[f.name] = int(raw) if isinstance(f.default, int) else raw.strip()
        return cls(**found)
