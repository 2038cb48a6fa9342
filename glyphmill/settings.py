"""Settings from JSON, TOML and the environment."""

from __future__ import annotations

import json
import os
import tomllib
from dataclasses import asdict, dataclass
from pathlib import Path


@dataclass(frozen=True)
class RankingWeights:
    """Shares of TF-IDF position scores and of TextRank in a summary's ranking; both from 0 to 1, together 1."""

    sentence_extraction_weight: float = 0.2
    textrank_weight: float = 0.8

    def valid(self) -> bool:
        both = (self.sentence_extraction_weight, self.textrank_weight)
        return all(0 <= x <= 1 for x in both) and abs(sum(both) - 1) < 1e-9


def load_settings(path: str, prefix: str = "GLYPHMILL_") -> dict:
    """A JSON or TOML file; variables of the environment with the prefix replace its top entries. No file, no entries."""
    file, out = Path(path), {}
    if file.exists():
        out = tomllib.loads(file.read_text()) if file.suffix == ".toml" else json.loads(file.read_text())
    return out | {k[len(prefix) :].lower(): v for k, v in os.environ.items() if k.startswith(prefix)}


def load_weights(path: str) -> RankingWeights:
    """The weights of a file; the defaults where there is none or they don't fit."""
    try:
        given = load_settings(path)
        weights = RankingWeights(float(given["sentence_extraction_weight"]), float(given["textrank_weight"]))
    except (KeyError, TypeError, ValueError):
        return RankingWeights()
    return weights if weights.valid() else RankingWeights()


def save_weights(path: str, weights: RankingWeights) -> None:
    if not weights.valid():
        raise ValueError("weights must be from 0 to 1 and sum to 1")
    Path(path).write_text(json.dumps(asdict(weights)))
