"""Perturbed series with a known answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import normal_draws, uniform_draw
from ..plans.config import Perturbation, TimingConfig
from . import classical, ranges, shape, timing


def perturbed(base: DataFrame, p: Perturbation, c: str = "sim") -> DataFrame:
    """base (series_id, k, ...) with ``c`` shifted, scaled about its mean, offset and with noise. The shift stops at the ends;
    missing values stay missing and take no draw."""
    src = base.select("series_id", F.col("k").alias("from_k"), F.col(c).alias("moved"))
    n = base.groupBy("series_id").agg(F.max("k").alias("last"), F.avg(c).alias("mean"))
    x = base.join(n, "series_id").withColumn("from_k", F.least(F.greatest(F.col("k") - p.shift, F.lit(0)), F.col("last"))).join(src, ["series_id", "from_k"], "left")
    y = F.col("mean") + (F.col("moved") - F.col("mean")) * (p.scale * (1 - p.dampen)) + p.offset
    if p.noise > 0:
        w = Window.partitionBy("series_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
        x = x.withColumn("draw", F.count("moved").over(w) - 1)
        if p.noise_kind == "uniform":
            y = y + (uniform_draw(F.col("draw"), p.seed) * 2 - 1) * p.noise
        else:
            most = n.agg(F.max("last")).collect()[0][0]
            draws = normal_draws(base.sparkSession, p.seed, (most or 0) + 1).withColumnRenamed("j", "draw")
            x, y = x.join(draws, "draw", "left"), y + p.noise * F.col("z")
    return x.withColumn(c, y).select(base.columns)



#: Between a setting's name and a series' in the series_id of ``grid``.
MARK = "\x1f"
# The metrics that a comparison shows.
CLASSICAL = ("nse", "kge2009", "r", "rmse", "pbias")
TIMING = ("w1", "w2sq", "dtw_warp", "peak_lag_abs", "lag_best", "xwt_lag")
#: Those that measure a shift.
LAGS = ("lag_best", "xwt_lag", "peak_lag_abs")


def grid(base: DataFrame, settings: dict[str, Perturbation], c: str = "sim") -> DataFrame:
    """All settings' perturbations of base (series_id, k, ...) in one frame, as ``perturbed`` makes each; a row's series_id is its setting's
    name, MARK and its series' name. Values are moved and draws counted by blocks of places, so no task has a series whole."""
    if any(MARK in name for name in settings):
        raise ValueError("a setting's name can't hold the mark")
    src = base.select("series_id", F.col("k").alias("from_k"), F.col(c).alias("moved"))
    n = base.groupBy("series_id").agg(F.max("k").alias("last"), F.avg(c).alias("mean"))
    told = [F.struct(F.lit(i).alias("setting"), F.lit(name).alias("name"), F.lit(p.shift).alias("shift"), F.lit(p.scale * (1 - p.dampen)).alias("gain"), F.lit(float(p.offset)).alias("offset"), F.lit(float(max(p.noise, 0))).alias("noise"), F.lit(p.noise_kind).alias("kind"), F.lit(p.seed).alias("seed")) for i, (name, p) in enumerate(settings.items())]
    x = base.drop(c).join(n, "series_id").select("*", F.inline(F.array(*told)))
    x = x.withColumn("from_k", F.least(F.greatest(F.col("k") - F.col("shift"), F.lit(0)), F.col("last"))).join(src, ["series_id", "from_k"], "left")
    y = F.col("mean") + (F.col("moved") - F.col("mean")) * F.col("gain") + F.col("offset")
    if any(p.noise > 0 for p in settings.values()):
        x = ranges.running(x.withColumn("block_", ranges.block_of()), ["series_id", "setting"], "block_", [F.col("k")], {"seen": F.col("moved").isNotNull().cast("int")}).withColumn("draw", F.col("seen") - 1)
        uniform = F.lit(None).cast("double")
        for seed in {p.seed for p in settings.values() if p.noise > 0 and p.noise_kind == "uniform"}:
            uniform = F.when(F.col("seed") == seed, uniform_draw(F.col("draw"), seed)).otherwise(uniform)
        y = y + F.when((F.col("noise") > 0) & (F.col("kind") == "uniform"), (uniform * 2 - 1) * F.col("noise")).otherwise(0.0)
        seeds = sorted({p.seed for p in settings.values() if p.noise > 0 and p.noise_kind != "uniform"})
        if seeds:
            most = n.agg(F.max("last")).collect()[0][0]
            draws = [normal_draws(base.sparkSession, s, (most or 0) + 1).select(F.col("j").alias("draw"), "z", F.lit(s).alias("seed")) for s in seeds]
            every = draws[0]
            for d in draws[1:]:
                every = every.unionByName(d)
            x, y = x.join(every, ["seed", "draw"], "left"), y + F.when((F.col("noise") > 0) & (F.col("kind") != "uniform"), F.col("noise") * F.col("z")).otherwise(0.0)
    return x.withColumn(c, y).withColumn("series_id", F.concat("name", F.lit(MARK), "series_id")).select(base.columns)


def compared(pairs: DataFrame, settings: dict[str, Perturbation], cfg: TimingConfig = TimingConfig(), synthetic: bool = False, ids: tuple[str, ...] = CLASSICAL + TIMING) -> DataFrame:
    """(series_id, setting, metric_id, value, injected): metrics of each perturbed series against obs, beside those of the base, whose
    setting is "base". The base is sim, or obs itself if ``synthetic``. ``injected`` is the shift, for the metrics that measure one:
    what they should give where the base has no lag of its own. Only what ``ids`` asks for is made."""
    if "base" in settings:
        raise ValueError("the base's name can't be a setting's")
    base = pairs.withColumn("sim", F.col("obs")) if synthetic else pairs
    g = grid(base, {"base": Perturbation()} | settings)
    parts = {
        ("w1",): lambda: timing.wasserstein1(g), ("w2sq",): lambda: timing.wasserstein2sq(g), ("dtw_warp",): lambda: shape.warping(timing.decimated(g), cfg),
        ("peak_lag_abs",): lambda: shape.peak_timing(shape.peak_table(g, cfg)), ("lag_best",): lambda: timing.best_lag(timing.lag_sweep(g)), ("xwt_lag",): lambda: shape.cross_wavelet_lag(shape.cross_wavelet(g)),
    }
    plain = [i for i in ids if i not in TIMING]
    frames = [classical.to_long(classical.wide_panel(g), plain)] if plain else []
    frames += [classical.to_long(make(), list(of)) for of, make in parts.items() if of[0] in ids]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    setting, shift = F.substring_index("series_id", MARK, 1), F.lit(0)
    for name, p in settings.items():
        shift = F.when(setting == name, p.shift).otherwise(shift)
    injected = F.when(F.col("metric_id").isin(list(LAGS)), F.when(F.col("metric_id") == "peak_lag_abs", F.abs(shift)).otherwise(shift))
    return out.select(F.expr(f"substring(series_id, length(substring_index(series_id, '{MARK}', 1)) + 2)").alias("series_id"), setting.alias("setting"), "metric_id", "value", injected.alias("injected"))
