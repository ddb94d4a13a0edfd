"""Options of a build or a search, with their defaults in one place."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Options:
    # Defaults that results depend on.
    alpha_span_weight: float = 0.60
    similarity_threshold: float = 0.70
    min_similarity_score: float = 0.50
    top_k: int = 10
    pool_factor: int = 4
    similar_sentences_k: int = 20
    neighbours: int = 30
    reduced_dimensions: int = 128
    max_nodes: int = 25
    kmeans_rows_per_centre: int = 10
    kmeans_max_centres: int = 50_000
    kmeans_iterations: int = 20
    seed: int = 42
    clustering_method: str = "mutual_knn"
    encoder: str = "hashed_trigram"
    reranker: str | None = None

    @classmethod
    def from_json(cls, path: str) -> "Options":
        """Options from a JSON settings file; unknown keys are ignored."""
        with open(path, encoding="utf-8") as handle:
            given = json.load(handle)
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in given.items() if k in known})
