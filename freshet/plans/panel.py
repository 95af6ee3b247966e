"""All 63 metrics of a set of pairs, long: classical ones by aggregation, timing ones by their operators; and the chain from series
to metrics with its settings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import classical, frame, matching, shape, timing
from ..sources.scratch import written
from .config import EvalConfig, TimingConfig


def full_panel(pairs: DataFrame, cfg: TimingConfig, heavy: bool = True) -> DataFrame:
    """(series_id, metric_id, value). Series under four pairs get no timing metrics. With ``heavy`` the pairs and their events
    are written to the shared folder first, as many branches read them; the session's cache stays as it was."""
    if heavy:
        pairs = written(pairs.select("series_id", "k", "ts", "obs", "sim"), "panel-pairs")
    wide = classical.wide_panel(pairs)
    out = classical.to_long(wide, classical.metric_ids(wide))
    if not heavy:
        return out
    size = pairs.groupBy("series_id").agg(F.count("*").alias("n")).where("n >= 4").select("series_id")
    p = pairs.join(size, "series_id", "left_semi")
    level = timing.thresholds(p, cfg)
    seen, made = (written(timing.events(p, level, cfg, c), f"panel-events-{c}") for c in ("obs", "sim"))
    parts = {
        ("peak_lag_abs", "peak_lag_signed"): shape.peak_timing(shape.peak_table(p, cfg)),
        ("event_threat",): matching.event_threat(seen, made, cfg.tolerance),
        ("event_peak", "event_vol", "event_lag"): timing.event_metrics(timing.event_errors(p, seen, cfg.tolerance)),
        ("lag_best",): timing.best_lag(timing.lag_sweep(p)),
        ("de", "de_const", "de_dyn"): timing.diagnostic_efficiency(p),
        ("sd_occ", "sd_amp", "sd_time"): matching.series_distance(p, seen, made, cfg),
        ("dtw_warp", "dtw_dist"): shape.warping(timing.decimated(p), cfg),
        ("w1",): timing.wasserstein1(p),
        ("w2sq",): timing.wasserstein2sq(p),
        ("xwt_lag",): shape.cross_wavelet_lag(shape.cross_wavelet(p)),
    }
    for ids, df in parts.items():
        out = out.unionByName(classical.to_long(df, list(ids)))
    return out


def evaluate(series: DataFrame, cfg: EvalConfig = EvalConfig(), heavy: bool = True) -> DataFrame:
    """(series_id, metric_id, value) from series (series_id, ts, obs, sim): missing values by the policy, transform, then all metrics.
    No value is infinite; what is not available is NULL."""
    return full_panel(classical.transformed(frame.paired(series, cfg.nan_policy), cfg.transform), cfg.timing, heavy)


def skill_rows(series: DataFrame, cfg: EvalConfig = EvalConfig()) -> DataFrame:
    """(series_id, nse_skill, kge_skill): the metrics under the settings against those of the benchmark, which knows no transform."""
    pairs = frame.paired(series, cfg.nan_policy)
    model = classical.wide_panel(classical.transformed(pairs, cfg.transform)).select("series_id", "nse", "kge2009")
    bench = classical.wide_panel(classical.benchmark(pairs, cfg.benchmark)).select("series_id", F.col("nse").alias("nse_b"), F.col("kge2009").alias("kge_b"))
    of = lambda a, b: classical.skill(F.col(a), F.col(b))
    return model.join(bench, "series_id").select("series_id", of("nse", "nse_b").alias("nse_skill"), of("kge2009", "kge_b").alias("kge_skill"))
