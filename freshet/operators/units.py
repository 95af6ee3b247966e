"""Unit conversion by way of cubic metres a second."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Volumetric units to m3/s, depth units to mm a step or a day, areas to km2.
VOLUME = {"m3s": 1.0, "cfs": 0.0283168, "ls": 0.001, "m3day": 1.15741e-5, "MLday": 0.0115741, "MGD": 0.0438126, "acftday": 0.0142764}
DEPTH = {"mm_step": (1.0, "step"), "mm_day": (1.0, "day"), "in_day": (25.4, "day")}
AREA = {"km2": 1.0, "mi2": 2.589988, "ha": 0.01, "acre": 0.00404686}


def area_km2(area: float, unit: str) -> float:
    return area * AREA[unit]


def compatible(a: str, b: str, has_area: bool) -> bool:
    """Dimensionless converts to itself only; a depth needs an area, even to itself."""
    if "dimensionless" in (a, b):
        return a == b
    return has_area or (a in VOLUME and b in VOLUME)


def to_m3s(unit: str, km2: float | None, step_ms: int, monthly: bool, ts: Column) -> Column:
    """What one unit is in m3/s. Months count with their own length."""
    if unit in VOLUME:
        return F.lit(VOLUME[unit])
    mm, per = DEPTH[unit]
    seconds = F.lit(86400.0) if per == "day" else F.day(F.last_day(ts)) * 86400.0 if monthly else F.lit(step_ms / 1000)
    return F.lit(mm * km2 * 1000.0) / seconds


def converted(series: DataFrame, a: str, b: str, km2: float | None = None, step_ms: int = 86_400_000, monthly: bool = False) -> DataFrame:
    """obs and sim from unit a to b; missing stays missing."""
    if not compatible(a, b, km2 is not None):
        raise ValueError(f"{a} does not convert to {b}")
    if a == b:
        return series
    factor = to_m3s(a, km2, step_ms, monthly, F.col("ts")) / to_m3s(b, km2, step_ms, monthly, F.col("ts"))
    return series.withColumns({c: F.col(c) * factor for c in ("obs", "sim")})


def converted_threshold(series: DataFrame, threshold: float, a: str, b: str, km2: float | None = None, step_ms: int = 86_400_000, monthly: bool = False) -> float | None:
    """An absolute threshold in the new unit, or None if the factor is not the same for all rows."""
    factor = to_m3s(a, km2, step_ms, monthly, F.col("ts")) / to_m3s(b, km2, step_ms, monthly, F.col("ts"))
    lo, hi = series.agg(F.min(factor), F.max(factor)).collect()[0]
    return threshold * lo if lo is not None and hi - lo <= 1e-9 * abs(hi) else None
