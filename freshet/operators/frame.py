"""Alignment, filters, resampling, missing values, checks and plot data over series (series_id, ts, obs, sim)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.stats import finite
from . import ranges


def by_time() -> WindowSpec:
    return Window.partitionBy("series_id").orderBy("ts")


def whole() -> WindowSpec:
    return Window.partitionBy("series_id")


def aligned(rows: DataFrame, order: str = "row_no") -> DataFrame:
    """Rows with a date, one a date: the first by ``order`` wins."""
    w = Window.partitionBy("series_id", "ts").orderBy(order)
    return rows.where(F.col("ts").isNotNull()).withColumn("rank_", F.row_number().over(w)).where("rank_ = 1").drop("rank_")


def in_window(series: DataFrame, a: Column, b: Column) -> DataFrame:
    """Both ends count; their order does not matter."""
    return series.where(F.col("ts").between(F.least(a, b), F.greatest(a, b)))


def in_season(series: DataFrame, start: int, end: int) -> DataFrame:
    """Days of the year from start to end, past New Year if start is later."""
    doy = F.dayofyear("ts")
    return series.where(doy.between(start, end) if start <= end else (doy >= start) | (doy <= end))


def resampled(series: DataFrame, to: str) -> DataFrame:
    """Means of the finite values of each UTC day or month that has rows."""
    return series.groupBy("series_id", F.date_trunc(to, "ts").alias("ts")).agg(F.avg("obs").alias("obs"), F.avg("sim").alias("sim"))


def subset(series: DataFrame, window: tuple[Column, Column] | None = None, season: tuple[int, int] | None = None, to: str | None = None) -> DataFrame:
    """Window, then season, then resampling."""
    if window:
        series = in_window(series, *window)
    if season:
        series = in_season(series, *season)
    return resampled(series, to) if to else series


def committed(series: DataFrame, dataset_id: str, **how) -> DataFrame:
    """A subset as a dataset of its own; an error if a series would have fewer than two rows."""
    out = subset(series, **how)
    least = out.groupBy("series_id").count().agg(F.min("count")).collect()[0][0]
    if not how or least is None or least < 2:
        raise ValueError("a subset needs a selection, and two rows or more")
    return out.withColumn("dataset_id", F.lit(dataset_id))


def cleaned(series: DataFrame) -> DataFrame:
    return series.withColumns({c: finite(F.col(c)) for c in ("obs", "sim")})


def paired(series: DataFrame, policy: str = "pairwise") -> DataFrame:
    """(series_id, k, ts, obs, sim): complete pairs in time order; k counts the pairs that are left, from 0."""
    x = cleaned(series)
    if policy == "zero":
        x = x.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("obs", "sim")})
    elif policy == "mean":
        x = x.withColumns({c: F.coalesce(F.col(c), F.avg(c).over(whole()), F.lit(0.0)) for c in ("obs", "sim")})
    elif policy != "pairwise":
        raise ValueError(f"no such policy: {policy}")
    x = x.where("obs is not null and sim is not null")
    return x.select("series_id", (F.row_number().over(by_time()) - 1).alias("k"), "ts", "obs", "sim")


def long_runs(wide: DataFrame, runs: list[str], keys: tuple[str, ...] = ("ts", "obs")) -> DataFrame:
    return wide.unpivot(list(keys), runs, "run_id", "sim")


def wide_runs(long: DataFrame, runs: list[str], keys: tuple[str, ...] = ("ts", "obs")) -> DataFrame:
    return long.groupBy(*keys).pivot("run_id", runs).agg(F.first("sim"))


def visible_runs(series: DataFrame, meta: DataFrame) -> DataFrame:
    return series.join(meta.where("visible").select("series_id"), "series_id", "left_semi")


def valid_location(meta: DataFrame) -> DataFrame:
    """Datasets with a possible position and area; missing ones are allowed."""
    ok = (F.col("lat").isNull() | (F.abs("lat") <= 90)) & (F.col("lon").isNull() | (F.abs("lon") <= 180)) & (F.col("area").isNull() | (F.col("area") > 0))
    return meta.where(ok)


def summary(series: DataFrame) -> DataFrame:
    """Missing, negative, least, mean and largest values of obs and sim, and their overlap."""
    x = cleaned(series)
    stats = [f for c in ("obs", "sim") for f in (F.count_if(F.col(c).isNull()).alias(f"{c}_missing"), F.count_if(F.col(c) < 0).alias(f"{c}_negative"), F.min(c).alias(f"{c}_min"), F.avg(c).alias(f"{c}_mean"), F.max(c).alias(f"{c}_max"))]
    return x.groupBy("series_id").agg(F.count("*").alias("n"), *stats, F.count_if(F.col("obs").isNotNull() & F.col("sim").isNotNull()).alias("overlap"))


def step(series: DataFrame) -> DataFrame:
    """The time step: step_ms, irregular, monthly. Monthly if over 90 % of gaps have 28 to 31 days; else the most frequent gap,
    the smallest of several, irregular if over 5 % are no multiples of it or over half differ. A lone row counts as daily."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    gaps = series.select("series_id", (ms - F.lag(ms).over(by_time())).alias("gap"))
    day = 86_400_000
    count = gaps.where("gap is not null").groupBy("series_id", "gap").agg(F.count("*").alias("c"))
    best = count.groupBy("series_id").agg(F.sum("c").alias("n"), F.sum(F.when(F.col("gap").between(28 * day, 31 * day), F.col("c")).otherwise(0)).alias("months"), F.max(F.struct("c", (-F.col("gap")).alias("less"))).alias("top"))
    mode = best.select("series_id", "n", "months", (-F.col("top.less")).alias("mode"), F.col("top.c").alias("mode_n"))
    uneven = (F.col("gap") != F.col("mode")) & F.coalesce(F.try_mod("gap", "mode") != 0, F.lit(True))  # mode 0: most dates repeat
    off = count.join(mode.select("series_id", "mode"), "series_id").groupBy("series_id").agg(F.sum(F.when(uneven, F.col("c")).otherwise(0)).alias("off"))
    x = series.select("series_id").distinct().join(mode, "series_id", "left").join(off, "series_id", "left")
    monthly = F.coalesce(F.col("months") > 0.9 * F.col("n"), F.lit(False))
    odd = F.coalesce((F.col("off") > 0.05 * F.col("n")) | (F.col("n") - F.col("mode_n") > 0.5 * F.col("n")), F.lit(False))
    return x.select("series_id", F.when(monthly, 30 * day).otherwise(F.coalesce("mode", F.lit(day))).cast("long").alias("step_ms"), (odd & ~monthly).alias("irregular"), monthly.alias("monthly"))


def step_label(step_ms: Column, monthly: Column) -> Column:
    h, m = 3_600_000, 60_000
    whole = lambda u: step_ms % u == 0
    text = lambda u, s: F.concat((step_ms / u).cast("long").cast("string"), F.lit(s))
    return F.when(monthly, "1mo").when(whole(24 * h), text(24 * h, "d")).when(whole(h), text(h, "h")).when(whole(m), text(m, "min")).otherwise(text(1, "ms"))


def checks(series: DataFrame) -> DataFrame:
    """(series_id, level, message) rows: what would stop an evaluation (error), and what may mislead it (warning)."""
    dup = series.groupBy("series_id").agg((F.count("ts") - F.count_distinct("ts")).alias("dups"), F.count_if(F.col("ts").isNull()).alias("undated"))
    x = summary(series).join(dup, "series_id").join(step(series.where("ts is not null")), "series_id", "left")
    rules = [
        ("error", F.col("undated") > 0, "dates that can't be read"), ("error", F.col("overlap") < 2, "fewer than two complete pairs"), ("warning", F.col("dups") > 0, "repeated dates"), ("warning", F.col("irregular"), "irregular time step"),
        ("warning", F.col("obs_missing") > 0.5 * F.col("n"), "more than half of the observations are missing"), ("warning", (F.col("obs_negative") > 0) | (F.col("sim_negative") > 0), "negative values"),
        ("warning", (F.col("overlap") >= 2) & ((F.col("overlap") < 30) | (F.col("overlap") < 0.1 * F.col("n"))), "little overlap"),
    ]
    found = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(level).alias("level"), F.lit(text).alias("message"))) for level, c, text in rules]))
    return x.select("series_id", F.explode(found).alias("f")).select("series_id", "f.level", "f.message")


# Plot data


def moving_average(series: DataFrame, n: int, c: str = "obs") -> DataFrame:
    """Mean of the values there are among the last n rows."""
    return series.withColumn("y", F.avg(c).over(by_time().rowsBetween(-(n - 1), 0)))


def derivative(series: DataFrame, c: str = "obs") -> DataFrame:
    return series.withColumn("y", F.col(c) - F.lag(c).over(by_time()))


def cumulative(series: DataFrame, c: str = "obs", rows: int = ranges.RANGE) -> DataFrame:
    """Running sums in time order, range by range of the dates; ``rows`` a range."""
    x = ranges.with_ranges(series, ["series_id"], F.unix_micros(F.col("ts").cast("timestamp")), rows)
    x = ranges.running(x, ["series_id"], "range_", [F.col("ts")], {"y": F.col(c)})
    return x.withColumn("y", F.when(F.col(c).isNotNull(), F.col("y"))).drop("range_")


def from_mean(series: DataFrame, n: int = 1, c: str = "obs") -> DataFrame:
    x = moving_average(series, n, c)
    return x.withColumn("y", F.col("y") - F.avg("y").over(whole()))


def exceedance(series: DataFrame, c: str = "obs", rows: int = ranges.RANGE) -> DataFrame:
    """The flow-duration curve by Weibull's plotting positions, 100 i / (n + 1). Distinct values are ranked range by range, ``rows`` a
    range, and take as many positions as rows have them."""
    key, x = ["series_id"], series.where(F.col(c).isNotNull())
    ranked = ranges.ranked_values(x.select("series_id", F.col(c).alias("value")), key, rows)
    placed = ranges.meet(ranked, x.groupBy(*key).agg(F.count("*").alias("n")), key)
    last = F.col("n") - F.col("before")
    each = placed.withColumn("i", F.explode(F.sequence(last - F.col("c") + 1, last)))
    return each.select("series_id", F.col("i").cast("int").alias("i"), F.col("value").alias("q"), (100.0 * F.col("i") / (F.col("n") + 1)).alias("p"))


def quantile_pairs(series: DataFrame) -> DataFrame:
    """Quantiles .01 to .99 of obs and of sim, each over its own values."""
    p = F.array(*[F.lit(i / 100) for i in range(1, 100)])
    q = series.groupBy("series_id").agg(F.percentile("obs", p).alias("o"), F.percentile("sim", p).alias("s"))
    z = q.select("series_id", F.posexplode(F.arrays_zip("o", "s")).alias("i", "z"))
    return z.select("series_id", (F.col("i") + 1).alias("percent"), F.col("z.o").alias("obs_q"), F.col("z.s").alias("sim_q"))


def doy_climatology(series: DataFrame) -> DataFrame:
    """Medians by day of year, and the middle half of obs."""
    q = F.percentile("obs", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    g = series.groupBy("series_id", F.dayofyear("ts").alias("doy")).agg(q.alias("q"), F.median("sim").alias("sim_median"))
    return g.select("series_id", "doy", F.col("q")[0].alias("obs_q25"), F.col("q")[1].alias("obs_median"), F.col("q")[2].alias("obs_q75"), "sim_median")


def year_by_doy(series: DataFrame, c: str = "obs") -> DataFrame:
    """(series_id, year, doy, value): the last row of each day, also if its value is missing."""
    g = series.groupBy("series_id", F.year("ts").alias("year"), F.dayofyear("ts").alias("doy"))
    return g.agg(F.max(F.struct("ts", F.col(c).alias("v"))).alias("last")).select("series_id", "year", "doy", F.col("last.v").alias("value"))


def year_matrix(series: DataFrame, c: str = "obs") -> DataFrame:
    """A row a year, a column for each of 366 days."""
    return year_by_doy(series, c).groupBy("series_id", "year").pivot("doy", list(range(1, 367))).agg(F.first("value"))


def threshold_line(series: DataFrame, threshold: float, log_axis: bool = False) -> DataFrame:
    y = F.lit(float(threshold))
    return series.select("series_id", "ts", (F.when(y > 0, F.log10(y)) if log_axis else y).alias("y"))


def colour_floor(x: DataFrame, c: str = "r") -> DataFrame:
    """The lower end of a colour scale for correlations: a twentieth below the least one, from -1 to 0.9; 0 if there is none."""
    low = F.min(finite(F.col(c)))
    return x.groupBy("series_id").agg(F.when(low.isNull(), 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.floor(low * 20) / 20 - 0.05, F.lit(0.9)))).alias("floor"))
