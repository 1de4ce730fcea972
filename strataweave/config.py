"""Thresholds, weights and fixed names. Values that results depend on are stated here."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace

# Required fields by bucket, id prefixes, allowed pairs of types.
REQUIRED_FIELDS = {"action_fields": ("name", "title"), "projects": ("title",), "measures": ("title",), "indicators": ("title", "description")}
PREFIXES = {"action_fields": "af", "projects": "proj", "measures": "msr", "indicators": "ind"}
ALLOWED = (("af", "proj"), ("proj", "af"), ("proj", "msr"), ("proj", "ind"), ("msr", "proj"), ("msr", "af"), ("msr", "ind"), ("ind", "proj"), ("ind", "af"), ("ind", "msr"))
# Directed pairs of the strict mode.
STRICT = (("af", "af"), ("af", "proj"), ("proj", "msr"), ("af", "msr"), ("proj", "ind"), ("msr", "ind"), ("af", "ind"), ("msr", "msr"))


@dataclass(frozen=True)
class Config:
    """Every threshold and weight of the analysis."""

    low_confidence: float = 0.7
    confidence_spread: float = 0.2
    many_connections: int = 10
    max_low_ratio: float = 0.15
    min_mean_confidence: float = 0.8
    min_completeness: float = 0.9
    duplicate_similarity: float = 0.85
    near_duplicate: float = 0.9
    min_af_coverage: float = 0.9
    min_project_coverage: float = 0.85
    min_measures: float = 1.0
    min_source_coverage: float = 0.8
    min_quote_match: float = 0.85
    fuzzy_match: float = 0.9
    max_repetition: float = 0.1
    max_language_inconsistency: float = 0.05
    min_description: int = 10
    max_description: int = 1000
    weights: dict = field(default_factory=lambda: {"integrity": 0.35, "content": 0.25, "connectivity": 0.25, "confidence": 0.10, "sources": 0.05})

    def shares(self) -> dict[str, float]:
        """The weights, scaled to a sum of 1."""
        total = sum(self.weights.values())
        return {k: v / total for k, v in self.weights.items()} if total > 0 else dict(self.weights)

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2)

    @staticmethod
    def from_json(text: str) -> "Config":
        return replace(Config(), **json.loads(text))
