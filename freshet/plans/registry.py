"""The metric registry: what each metric is called, what is best, and how it is shown."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Id, label, optimum, direction, unitful, digits, by group.
ERROR_NORMS = [
    ("me", "Mean error", 0, "zero", True, 3), ("mae", "Mean absolute error", 0, "min", True, 3), ("mdae", "Median absolute error", 0, "min", True, 3),
    ("mse", "Mean squared error", 0, "min", True, 3), ("rmse", "Root mean squared error", 0, "min", True, 3), ("rsr", "RMSE over observed deviation", 0, "min", False, 3),
    ("nrmse_mean", "RMSE over mean", 0, "min", False, 3), ("nrmse_range", "RMSE over range", 0, "min", False, 3), ("nrmse_iqr", "RMSE over interquartile range", 0, "min", False, 3),
    ("mape", "Mean absolute percentage error", 0, "min", False, 2), ("smape", "Symmetric MAPE", 0, "min", False, 2), ("maape", "Mean arctangent absolute percentage error", 0, "min", False, 3),
    ("mapd", "Mean absolute percentage deviation", 0, "min", False, 2), ("msle", "Mean squared log error", 0, "min", False, 4), ("mle", "Mean log error", 0, "zero", False, 4),
    ("male", "Mean absolute log error", 0, "min", False, 4), ("rmsle", "Root mean squared log error", 0, "min", False, 4), ("mde", "Median error", 0, "zero", True, 3),
    ("mdse", "Median squared error", 0, "min", True, 3), ("mase", "Mean absolute scaled error", 0, "min", False, 3),
]
CORRELATION = [
    ("r", "Pearson correlation", 1, "max", False, 3), ("r2", "Coefficient of determination", 1, "max", False, 3), ("wr2", "Slope-weighted R2", 1, "max", False, 3),
    ("spearman", "Spearman rank correlation", 1, "max", False, 3), ("d", "Index of agreement", 1, "max", False, 3), ("d1", "Modified index of agreement", 1, "max", False, 3),
    ("dr", "Refined index of agreement", 1, "max", False, 3), ("drel", "Relative index of agreement", 1, "max", False, 3), ("lm_index", "Legates-McCabe index", 1, "max", False, 3),
]
EFFICIENCIES = [
    ("nse", "Nash-Sutcliffe efficiency", 1, "max", False, 3), ("nse_mod", "Modified NSE", 1, "max", False, 3), ("nse_rel", "Relative NSE", 1, "max", False, 3), ("lognse", "NSE of logs", 1, "max", False, 3),
    ("kge2009", "Kling-Gupta efficiency 2009", 1, "max", False, 3), ("kge2012", "Kling-Gupta efficiency 2012", 1, "max", False, 3), ("kge2021", "Kling-Gupta efficiency 2021", 1, "max", False, 3),
    ("kgenp", "Non-parametric KGE", 1, "max", False, 3), ("ve", "Volumetric efficiency", 1, "max", False, 3), ("pbias", "Percent bias", 0, "zero", False, 2), ("beta_nse", "Bias term of NSE", 0, "zero", False, 3), ("alpha", "Variability ratio", 1, "one", False, 3),
]
FDC = [("fhv", "High-flow volume bias", 0, "zero", False, 2), ("flv", "Low-flow volume bias", 0, "zero", False, 2), ("fms", "Mid-segment slope bias", 0, "zero", False, 2), ("fmm", "Median flow bias", 0, "zero", False, 2)]
TIMING = [
    ("peak_lag_abs", "Mean absolute peak lag", 0, "min", False, 2), ("peak_lag_signed", "Mean peak lag", 0, "zero", False, 2), ("event_threat", "Event threat score", 1, "max", False, 3),
    ("event_peak", "Event peak error", 0, "zero", False, 1), ("event_vol", "Event volume error", 0, "zero", False, 2), ("event_lag", "Event peak lag", 0, "zero", False, 2), ("lag_best", "Best lag", 0, "zero", False, 0),
    ("de", "Diagnostic efficiency", 0, "min", False, 3), ("de_const", "Constant error of DE", 0, "zero", False, 3), ("de_dyn", "Dynamic error of DE", 0, "min", False, 3),
    ("sd_occ", "Series distance occurrence", 1, "max", False, 3), ("sd_amp", "Series distance amplitude", 0, "zero", False, 2), ("sd_time", "Series distance timing", 0, "zero", False, 2),
    ("dtw_warp", "Mean warp of DTW", 0, "min", False, 2), ("dtw_dist", "DTW distance", 0, "min", True, 3), ("w1", "Wasserstein-1 of mass", 0, "min", False, 2), ("w2sq", "Squared Wasserstein-2 of mass", 0, "min", False, 2), ("xwt_lag", "Cross-wavelet lag", 0, "zero", False, 2),
]
GROUPS = {"Error norms": ERROR_NORMS, "Correlation & agreement": CORRELATION, "Efficiencies": EFFICIENCIES, "FDC signatures": FDC, "Timing & shape": TIMING}
# The metrics of the short preset, its timing metrics, those with a bounded form, those that may be given weights, and
# default weights.
ESSENTIALS = ("rmse", "mae", "rsr", "r", "r2", "d", "nse", "kge2009", "pbias", "ve", "fhv", "flv", "fms", "sd_occ", "sd_amp", "sd_time", "dtw_warp", "dtw_dist", "xwt_lag", "w1", "peak_lag_abs", "peak_lag_signed", "event_peak", "event_vol", "event_lag", "de")
TIMING_SUMMARY = ("sd_occ", "sd_amp", "sd_time", "dtw_warp", "dtw_dist", "xwt_lag", "w1", "peak_lag_abs", "peak_lag_signed", "event_peak", "event_vol", "event_lag", "de")
C2M = ("nse", "nse_mod", "nse_rel", "lognse", "kge2009", "kge2012", "kge2021", "kgenp", "ve", "lm_index", "drel")
CANDIDATES = ("nse", "kge2009", "r2", "ve", "rmse", "pbias", "peak_lag_abs", "w1", "dtw_warp", "de", "xwt_lag")
PRIORITIES = {"nse": 1.0, "kge2009": 1.0, "w1": 1.0, "peak_lag_abs": 1.0}

SCHEMA = "ordinal int, metric_id string, label string, grp string, optimum int, direction string, timing boolean, unitful boolean, digits int"


@dataclass(frozen=True)
class UserMetric:
    """A metric of a user's own, as a state that merges: ``sums`` are Spark aggregates over pairs with the columns obs, sim, e (sim - obs),
    n, mo and ms (number and means of the series), by name; ``finish`` makes the value of a series from them. So it is part of the
    panel's own aggregation, combined before any shuffle, and works on series of any length."""

    metric_id: str
    label: str
    sums: Callable[[], dict[str, Column]]
    finish: Callable[[dict[str, Column]], Column]
    optimum: int = 0
    direction: str = "min"  # min, max, zero or one
    unitful: bool = False
    digits: int = 3


USER_METRICS: dict[str, UserMetric] = {}


def register_metric(metric: UserMetric) -> None:
    """From now on ``metric`` is in every classical panel, in its registry, and so in rankings and bootstrap intervals."""
    if metric.metric_id in {r[1] for r in rows()} or metric.metric_id.startswith("kge_") or metric.metric_id in ("series_id", "n"):
        raise ValueError(f"there is a metric {metric.metric_id}")
    if metric.direction not in ("min", "max", "zero", "one") or not 0 <= metric.digits <= 4:
        raise ValueError("a direction is min, max, zero or one, and digits are 0 to 4")
    USER_METRICS[metric.metric_id] = metric


def unregister_metric(metric_id: str) -> None:
    USER_METRICS.pop(metric_id, None)


@contextmanager
def user_metrics(*metrics: UserMetric) -> Iterator[None]:
    """``metrics`` are registered for what is built within."""
    done = []
    try:
        for m in metrics:
            register_metric(m)
            done.append(m.metric_id)
        yield
    finally:
        for i in done:
            unregister_metric(i)


def user_sums() -> dict[str, Column]:
    """The aggregates of all registered metrics, under names that nothing else has."""
    return {f"user_{m.metric_id}_{k}": v for m in USER_METRICS.values() for k, v in m.sums().items()}


def user_values() -> dict[str, Column]:
    """The registered metrics, over a row a series with the columns of ``user_sums``."""
    return {m.metric_id: m.finish({k: F.col(f"user_{m.metric_id}_{k}") for k in m.sums()}) for m in USER_METRICS.values()}


def rows() -> list[tuple]:
    own = [(0, m, label, g, o, d, g == "Timing & shape", u, n) for g, ms in GROUPS.items() for m, label, o, d, u, n in ms]
    return own + [(0, m.metric_id, m.label, "User metrics", m.optimum, m.direction, False, m.unitful, m.digits) for m in USER_METRICS.values()]


def metric_registry(spark: SparkSession) -> DataFrame:
    """One row a metric, in display order; a small fixed table."""
    return spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(rows())], SCHEMA)


def preset(metrics: DataFrame, name: str) -> DataFrame:
    """Rows of ``metrics`` (metric_id) in a preset: essentials or extended."""
    if name == "extended":
        return metrics
    chosen = metrics.sparkSession.createDataFrame([(m,) for m in ESSENTIALS], "metric_id string")
    return metrics.join(F.broadcast(chosen), "metric_id", "left_semi")


def search(registry: DataFrame, text: str) -> DataFrame:
    """Metrics whose id or label holds ``text``, whatever the case."""
    return registry.where(F.lower(F.concat_ws(" ", "label", "metric_id")).contains(text.lower()))


def candidates(registry: DataFrame) -> DataFrame:
    """Metrics that a ranking may give weights, in display order, with the weight that each has by default (0: none)."""
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in PRIORITIES.items() for x in kv]), F.col("metric_id"))
    return registry.where(F.col("metric_id").isin(list(CANDIDATES))).withColumn("weight", F.coalesce(weight, F.lit(0.0)))


def displayed(metrics: DataFrame, registry: DataFrame) -> DataFrame:
    """``metrics`` (series_id, metric_id, value) rounded to each metric's digits, with its place in display order."""
    out = metrics.join(F.broadcast(registry.select("metric_id", "ordinal", "digits")), "metric_id")
    scale = F.pow(F.lit(10.0), F.col("digits"))
    return out.select("series_id", "ordinal", "metric_id", (F.floor(F.col("value") * scale + 0.5) / scale).alias("shown"))
