"""Settings of an evaluation."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR_MS = 3_600_000


@dataclass(frozen=True)
class TimingConfig:
    """Lags and distances count positions among the pairs that are left, not calendar steps."""

    threshold_kind: str = "percentile"  # or absolute
    threshold: float = 90.0
    min_distance: int = 5
    tolerance: int = 3
    warmup: int = 0
    prominence: float | None = None  # None: the observed deviation
    band: float = 0.1

    @classmethod
    def for_step(cls, step_ms: int) -> TimingConfig:
        """Defaults by time step: 22 hours or more count as daily."""
        return cls() if step_ms >= 22 * HOUR_MS else cls(min_distance=24, tolerance=24)


def timing_defaults(step_ms: Column) -> tuple[Column, Column]:
    """(min_distance, tolerance) of ``TimingConfig.for_step``, as columns."""
    daily, finer = TimingConfig.for_step(24 * HOUR_MS), TimingConfig.for_step(HOUR_MS)
    is_daily = step_ms >= 22 * HOUR_MS
    return F.when(is_daily, daily.min_distance).otherwise(finer.min_distance), F.when(is_daily, daily.tolerance).otherwise(finer.tolerance)


@dataclass(frozen=True)
class EvalConfig:
    nan_policy: str = "pairwise"  # pairwise, zero, mean
    transform: str = "none"  # none, log, sqrt, inverse
    benchmark: str = "mean"  # mean, persistence, climatology
    timing: TimingConfig = field(default_factory=TimingConfig)


@dataclass(frozen=True)
class Perturbation:
    """S' = m + (B(t - shift) - m) * scale * (1 - dampen) + offset + noise, m the mean of B."""

    shift: int = 0
    offset: float = 0.0
    scale: float = 1.0
    dampen: float = 0.0
    noise: float = 0.0
    noise_kind: str = "uniform"  # or gaussian
    seed: int = 42
