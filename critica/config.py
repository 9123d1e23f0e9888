"""Job options. These are plain Python values turned into literals inside the plan;
none of them is a table."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class LoopConfig:
    """Refinement-loop thresholds (defaults of the loop being reproduced)."""

    max_iterations: int = 3
    min_quality_score: float = 7.0
    stagnation_patience: int = 2
    min_improvement_delta: float = 0.3


@dataclass(frozen=True)
class MetricsConfig:
    """Length normalisation bounds of the model-free answer scorer."""

    min_word_count: int = 30
    max_word_count: int = 300


@dataclass(frozen=True)
class CriticWeights:
    """Penalty per issue and cap per category, subtracted from the critic's raw score."""

    # Penalty weights and caps of the critic being reproduced.
    hallucination_penalty: float = 2.0
    hallucination_cap: float = 5.0
    factual_error_penalty: float = 1.5
    factual_error_cap: float = 4.0
    logical_flaw_penalty: float = 1.0
    logical_flaw_cap: float = 3.0
    missing_concept_penalty: float = 0.5
    missing_concept_cap: float = 2.0


DEFAULT_LOOP = LoopConfig()
DEFAULT_METRICS = MetricsConfig()
DEFAULT_WEIGHTS = CriticWeights()
