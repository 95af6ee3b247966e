"""Registered queries over the engine's operators, with SQL for the value check."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cells
from ..functions.stats import uniform_draw
from ..operators import bootstrap, classical, frame, matching, plots, ranges, ranking, sandbox, shape, timing, units
from . import oracles as sql
from ..sources import sinks, tables
from ..sources.datasets import DataSets
from ..sources.scratch import scratch_path, written
from .config import EvalConfig, Perturbation, TimingConfig, timing_defaults
from .derived import by_brand, by_flag, by_supplier, hourly, messy, one_record, table
from .panel import evaluate, full_panel, skill_rows
from .registry import C2M, CORRELATION, EFFICIENCIES, ERROR_NORMS, ESSENTIALS, FDC, TIMING_SUMMARY, UserMetric, displayed, metric_registry, preset, rows, search, user_metrics
from .stored import evaluate_stored, stale

Query = Callable[[SparkSession, str], DataFrame]
DAILY = TimingConfig()
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _add(name: str, query: Query, oracle: str | None = None) -> None:
    _QUERIES[name] = query
    if oracle:
        _SQL[name] = oracle


def _rounded(df: DataFrame, *keep: str) -> DataFrame:
    """Doubles to six digits, so that the order of a sum does not show."""
    return _to_digits(df, 6, *keep)


def _to_digits(df: DataFrame, digits: int, *keep: str) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


def _ids(group: list[tuple]) -> list[str]:
    return [m[0] for m in group]


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return frame.paired(by_flag(spark, sf))


def _wide(ids: list[str], policy: str = "pairwise", transform: str = "none", source: Callable = by_flag) -> Query:
    return lambda spark, sf: _rounded(classical.wide_panel(classical.transformed(frame.paired(source(spark, sf), policy), transform)).select("series_id", *ids))


def _panels() -> None:
    groups = {"error_norms": ERROR_NORMS, "correlation": CORRELATION, "efficiency": EFFICIENCIES, "fdc": FDC}
    every = [i for g in groups.values() for i in _ids(g)]
    _add("panel_classical", _wide(every), sql.wide(every))
    for name, g in groups.items():
        _add(f"panel_{name}", _wide(_ids(g)), sql.wide(_ids(g)))
    _add("panel_by_brand", _wide(every, source=by_brand), sql.wide(every, sql.pairs(sql.BRAND)))
    # A series of all orders, in ranges of 2000 values and blocks of 2000 places: no task has it whole.
    orders = "by_order AS (SELECT l_orderkey, sum(l_quantity)::DOUBLE AS obs, floor(((sum(l_extendedprice::DECIMAL(12,2)) * 100)::BIGINT + 75) / 150) / 1000 AS sim FROM lineitem GROUP BY l_orderkey), pairs AS (SELECT 'all' AS series_id, l_orderkey AS k, obs, sim FROM by_order)"

    def one_long(spark: SparkSession, sf: str) -> DataFrame:
        cents = (F.sum(F.col("l_extendedprice").cast("decimal(12,2)")) * 100).cast("long")
        x = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").cast("double").alias("obs"), (F.floor((cents + 75) / 150) / 1000).alias("sim"))
        return ranges.numbered(x.withColumn("series_id", F.lit("all")), ["series_id"], F.col("l_orderkey"), 2000)

    _add("panel_one_long_series", lambda s, d: _rounded(classical.wide_panel(one_long(s, d), long=2000).select("series_id", *every)), sql.wide(every, orders))
    # Many short series, more with a larger table. Five digits: medians of values with four have a fifth, which no rounding meets.
    _add("panel_by_supplier", lambda s, d: _to_digits(classical.wide_panel(frame.paired(by_supplier(s, d))).select("series_id", *every), 5), sql.wide(every, sql.pairs(sql.SUPPLIER), 5))
    some = ["me", "rmse", "nse", "kge2009", "pbias"]
    for p in ("pairwise", "zero", "mean"):
        _add(f"nan_policy_{p}", _wide(some, p), sql.wide(some, sql.pairs(policy=p)))
    some = ["me", "rmse", "nse", "r", "mdae", "kge2009"]
    for t in ("log", "sqrt", "inverse"):
        _add(f"transform_{t}", _wide(some, transform=t), sql.wide(some, sql.pairs(transform=t)))
    _add(
        "kge_components",
        lambda s, d: _rounded(classical.wide_panel(_pairs(s, d)).select("series_id", "kge_r", "kge_alpha", "kge_beta", "kge_gamma", "kge_shift")),
        f"WITH {sql.panel(sql.pairs())} SELECT series_id, round(r, 6) AS kge_r, round(ss / so, 6) AS kge_alpha, round(ms / mo, 6) AS kge_beta, round((ss / ms) / (so / mo), 6) AS kge_gamma, round((ms - mo) / so, 6) AS kge_shift FROM panel",
    )
    _add("c2m", lambda s, d: _rounded(classical.to_long(classical.wide_panel(_pairs(s, d)), C2M).select("series_id", "metric_id", classical.c2m(F.col("value")).alias("c2m"))), f"{sql.long(C2M)} SELECT series_id, metric_id, round(value / (2 - value), 6) AS c2m FROM long")

    def essentials(spark: SparkSession, sf: str) -> DataFrame:
        return _rounded(preset(classical.to_long(classical.wide_panel(_pairs(spark, sf)), every), "essentials").select("series_id", "metric_id", "value"))

    short = [i for i in every if i in ESSENTIALS]
    _add("preset_semi_join", essentials, f"{sql.long(short)} SELECT series_id, metric_id, round(value, 6) AS value FROM long")
    shown = ["nse", "pbias", "msle"]
    _add(
        "display_rounding",
        lambda s, d: displayed(classical.to_long(classical.wide_panel(_pairs(s, d)), shown), metric_registry(s)).drop("ordinal"),
        f"{sql.long(shown)} SELECT series_id, metric_id, floor(value * power(10, CASE metric_id WHEN 'nse' THEN 3 WHEN 'pbias' THEN 2 ELSE 4 END) + 0.5) / power(10, CASE metric_id WHEN 'nse' THEN 3 WHEN 'pbias' THEN 2 ELSE 4 END) AS shown FROM long",
    )
    _add("metric_search", lambda s, d: classical.to_long(classical.wide_panel(_pairs(s, d)), every).join(F.broadcast(search(metric_registry(s), "kling")), "metric_id", "left_semi").select("series_id", "metric_id", F.round("value", 6).alias("value")), f"{sql.long(['kge2009', 'kge2012', 'kge2021'])} SELECT series_id, metric_id, round(value, 6) AS value FROM long")
    bench = {"mean": "avg(obs) OVER (PARTITION BY series_id)", "persistence": "coalesce(lag(obs) OVER (PARTITION BY series_id ORDER BY k), obs)", "climatology": "avg(obs) OVER (PARTITION BY series_id, month(ts))"}
    for kind, b in bench.items():
        _add(f"benchmark_{kind}", lambda s, d, kind=kind: _rounded(classical.benchmark(_pairs(s, d), kind).select("series_id", "k", F.col("sim").alias("bench"))), f"WITH {sql.pairs()} SELECT series_id, k::INT AS k, round({b}, 6) AS bench FROM pairs")

    def skill(spark: SparkSession, sf: str) -> DataFrame:
        p = _pairs(spark, sf)
        m = classical.wide_panel(p).select("series_id", F.col("nse").alias("m"))
        b = classical.wide_panel(classical.benchmark(p, "climatology")).select("series_id", F.col("nse").alias("b"))
        return _rounded(m.join(b, "series_id").select("series_id", classical.skill(F.col("m"), F.col("b")).alias("skill")))

    _add("skill", skill, f"WITH {sql.pairs()}, c AS (SELECT *, avg(obs) OVER (PARTITION BY series_id) AS mo, {bench['climatology']} AS b FROM pairs), n AS (SELECT series_id, {sql.LOW_NSE} AS m, 1 - sum(power(b - obs, 2)) / sum(power(obs - mo, 2)) AS bn FROM c GROUP BY series_id) SELECT series_id, round(least(1, (m - bn) / (1 - bn)), 6) AS skill FROM n")
    _add("skill_rows", lambda s, d: _rounded(skill_rows(by_flag(s, d), EvalConfig(benchmark="climatology"))), sql.skills())
    _add("evaluate_mean_sqrt", lambda s, d: _rounded(evaluate(by_flag(s, d), EvalConfig("mean", "sqrt"), heavy=False)), f"{sql.long(every, sql.pairs(policy='mean', transform='sqrt'))} SELECT series_id, metric_id, round(value, 6) AS value FROM long")


def _frames() -> None:
    day = lambda x: F.to_timestamp(F.lit(x))
    cols = "series_id, ts, obs, sim"
    _add("window_filter", lambda s, d: frame.in_window(by_flag(s, d), day("1998-12-31"), day("1997-01-01")), f"WITH {sql.FLAG} SELECT {cols} FROM series WHERE ts BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1998-12-31'")
    _add("season_wrap", lambda s, d: frame.in_season(by_flag(s, d), 335, 59), f"WITH {sql.FLAG} SELECT {cols} FROM series WHERE dayofyear(ts) >= 335 OR dayofyear(ts) <= 59")
    means = "round(avg(obs), 6) AS obs, round(avg(sim), 6) AS sim"
    _add("resample_daily", lambda s, d: _rounded(frame.resampled(hourly(s, d), "day")), f"WITH {sql.HOURLY} SELECT series_id, date_trunc('day', ts)::TIMESTAMP AS ts, {means} FROM series GROUP BY 1, 2")
    _add("resample_monthly", lambda s, d: _rounded(frame.resampled(by_flag(s, d), "month")), f"WITH {sql.FLAG} SELECT series_id, date_trunc('month', ts)::TIMESTAMP AS ts, {means} FROM series GROUP BY 1, 2")
    _add("subset_composed", lambda s, d: _rounded(frame.subset(by_flag(s, d), (day("1996-01-01"), day("1999-12-31")), (60, 151), "month")), f"WITH {sql.FLAG} SELECT series_id, date_trunc('month', ts)::TIMESTAMP AS ts, {means} FROM series WHERE ts BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1999-12-31' AND dayofyear(ts) BETWEEN 60 AND 151 GROUP BY 1, 2")
    def committed(spark: SparkSession, sf: str) -> DataFrame:
        return frame.committed(by_flag(spark, sf), "spring", window=(day("1995-06-01"), day("2000-06-30")), season=(60, 151))

    _add("subset_commit", committed, f"WITH {sql.FLAG} SELECT {cols}, 'spring' AS dataset_id FROM series WHERE ts BETWEEN TIMESTAMP '1995-06-01' AND TIMESTAMP '2000-06-30' AND dayofyear(ts) BETWEEN 60 AND 151")

    def thresholds(spark: SparkSession, sf: str) -> DataFrame:
        x, months, area = by_flag(spark, sf), frame.resampled(by_flag(spark, sf), "month"), units.area_km2(100, "mi2")
        cases = [("cfs to l/s", units.converted_threshold(x, 50.0, "cfs", "ls")), ("mm a day to m3/s", units.converted_threshold(x, 2.0, "mm_day", "m3s", area)), ("mm a month to m3/s", units.converted_threshold(months, 30.0, "mm_step", "m3s", area, monthly=True))]
        return spark.createDataFrame(cases, "conversion string, threshold double").withColumn("threshold", F.round("threshold", 6))

    _add("threshold_rescale", thresholds, f"""WITH {sql.FLAG}, f AS (SELECT 'cfs to l/s' AS conversion, 50.0::DOUBLE AS t, 0.0283168 / 0.001 AS f FROM series UNION ALL SELECT 'mm a day to m3/s', 2.0, 258.9988 * 1000 / 86400 FROM series UNION ALL SELECT 'mm a month to m3/s', 30.0, 258.9988 * 1000 / (day(last_day(ts)) * 86400) FROM series)
SELECT conversion, CASE WHEN max(f) - min(f) <= 1e-9 * max(f) THEN round(any_value(t) * min(f), 6) END AS threshold FROM f GROUP BY conversion""")

    def defaults(spark: SparkSession, sf: str) -> DataFrame:
        distance, tolerance = timing_defaults(F.col("step_ms"))
        return frame.step(by_flag(spark, sf).unionByName(hourly(spark, sf))).select("series_id", distance.alias("min_distance"), tolerance.alias("tolerance"))

    _add("timing_defaults", defaults, f"WITH {sql.FLAG}, {sql.HOURLY.replace('series AS', 'hourly AS')}, every_ AS (SELECT series_id, ts FROM series UNION ALL SELECT series_id, ts FROM hourly), {sql.steps('every_')} SELECT series_id, CASE WHEN step_ms >= 22 * 3600000 THEN 5 ELSE 24 END AS min_distance, CASE WHEN step_ms >= 22 * 3600000 THEN 3 ELSE 24 END AS tolerance FROM steps_")

    def through_text(spark: SparkSession, sf: str) -> DataFrame:
        path = scratch_path(spark, "table")
        sinks.write_text(one_record(spark, sf).withColumnRenamed("ts", "Date"), path, ";")
        return tables.staged(tables.read_delimited(spark, path))[0]

    def through_awkward_text(spark: SparkSession, sf: str) -> DataFrame:
        """Dots in headers, two runs that differ in their unit only, quoted separators, quotes and line breaks."""
        path = scratch_path(spark, "table")
        note = F.concat(F.lit('first; "line"\n'), F.col("ts").cast("string"), F.lit(';\n"last"\n'))
        cells = one_record(spark, sf).select(F.col("ts").alias("Date"), note.alias("a note; of.some kind"), F.col("Observed").alias("obs.mean"), F.col("A").alias("run.1"), F.col("N").alias("run.1 [cfs]"))
        sinks.write_text(cells, path, ";")
        return tables.staged(tables.read_delimited(spark, path), ["date", "ignore", "observed", "run", "run"])[0]

    _add("text_awkward_round_trip", through_awkward_text, f"WITH {sql.RECORD} SELECT CASE series_id WHEN 'A' THEN 'run.1' ELSE 'run.1 (2)' END AS series_id, ts, obs, sim FROM record WHERE series_id IN ('A', 'N')")

    def through_project(spark: SparkSession, sf: str) -> DataFrame:
        path = scratch_path(spark, "project")
        runs = one_record(spark, sf).unpivot(["ts", "Observed"], ["A", "N", "R"], "series_id", "sim").withColumnRenamed("Observed", "obs")
        sinks.project_documents(runs, "all").write.text(path)
        return tables.read_project(spark, path)[0].select(F.substring_index("series_id", "/", -1).alias("series_id"), "ts", "obs", "sim")

    for name, query in (("text_round_trip", through_text), ("project_round_trip", through_project)):
        _add(name, query, f"WITH {sql.RECORD} SELECT series_id, ts, obs, sim FROM record")
    _add("validate_summary", lambda s, d: _rounded(frame.summary(by_flag(s, d))), f"WITH {sql.FLAG} SELECT series_id, count(*) AS n, " + ", ".join(f"count_if({c} IS NULL)::BIGINT AS {c}_missing, count_if({c} < 0)::BIGINT AS {c}_negative, round(min({c}), 6) AS {c}_min, round(avg({c}), 6) AS {c}_mean, round(max({c}), 6) AS {c}_max" for c in ("obs", "sim")) + ", count_if(obs IS NOT NULL AND sim IS NOT NULL)::BIGINT AS overlap FROM series GROUP BY series_id")

    def steps(spark: SparkSession, sf: str) -> DataFrame:
        x = by_flag(spark, sf).unionByName(hourly(spark, sf)).unionByName(frame.resampled(by_flag(spark, sf), "month").withColumn("series_id", F.concat(F.lit("monthly "), "series_id")))
        return frame.step(x).withColumn("label", frame.step_label(F.col("step_ms"), F.col("monthly")))

    hours = sql.HOURLY.replace("series AS", "hourly AS")
    _add("step_detect", steps, f"""WITH {sql.FLAG}, {hours}, every_ AS (SELECT series_id, ts FROM series UNION ALL SELECT series_id, ts FROM hourly UNION ALL SELECT DISTINCT 'monthly ' || series_id, date_trunc('month', ts)::TIMESTAMP FROM series),
g AS (SELECT series_id, epoch_ms(ts) - lag(epoch_ms(ts)) OVER (PARTITION BY series_id ORDER BY ts) AS gap FROM every_), c AS (SELECT series_id, gap, count(*) AS c FROM g WHERE gap IS NOT NULL GROUP BY ALL),
t AS (SELECT series_id, arg_max(gap, c * 1e12 - gap) AS mode, max(c) AS mode_n, sum(c) AS n, sum(CASE WHEN gap BETWEEN 28 * 86400000::BIGINT AND 31 * 86400000::BIGINT THEN c ELSE 0 END) AS months FROM c GROUP BY series_id),
o AS (SELECT series_id, any_value(mode) AS mode, any_value(mode_n) AS mode_n, any_value(n) AS n, any_value(months) AS months, sum(CASE WHEN gap % mode <> 0 THEN c ELSE 0 END) AS off FROM c JOIN t USING (series_id) GROUP BY series_id),
r AS (SELECT series_id, CASE WHEN months > 0.9 * n THEN 30 * 86400000::BIGINT ELSE mode END::BIGINT AS step_ms, months <= 0.9 * n AND (off > 0.05 * n OR n - mode_n > 0.5 * n) AS irregular, months > 0.9 * n AS monthly FROM o)
SELECT *, CASE WHEN monthly THEN '1mo' WHEN step_ms % 86400000 = 0 THEN (step_ms // 86400000)::VARCHAR || 'd' WHEN step_ms % 3600000 = 0 THEN (step_ms // 3600000)::VARCHAR || 'h' WHEN step_ms % 60000 = 0 THEN (step_ms // 60000)::VARCHAR || 'min' ELSE step_ms::VARCHAR || 'ms' END AS label FROM r""")
    def places(spark: SparkSession, sf: str) -> DataFrame:
        """Balances as positions and areas, some of them impossible or missing."""
        x = table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
        lat = F.when(F.col("c_custkey") % 11 != 0, F.col("c_acctbal") / 100)
        return frame.valid_location(x.select(F.col("c_custkey").alias("dataset_id"), lat.alias("lat"), ((F.col("c_nationkey") - 12) * 16.0).alias("lon"), (F.col("c_acctbal") + 500).alias("area")))

    _add("valid_locations", places, "SELECT * FROM (SELECT c_custkey AS dataset_id, CASE WHEN c_custkey % 11 <> 0 THEN c_acctbal / 100 END AS lat, ((c_nationkey - 12) * 16)::DOUBLE AS lon, c_acctbal + 500 AS area FROM customer) WHERE (lat IS NULL OR abs(lat) <= 90) AND (lon IS NULL OR abs(lon) <= 180) AND (area IS NULL OR area > 0)")
    _add("validate_checks", lambda s, d: frame.checks(by_flag(s, d).unionByName(messy(s, d))), sql.CHECKS)

    def dedup(spark: SparkSession, sf: str) -> DataFrame:
        x = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("series_id"), F.date_trunc("day", F.col("l_shipdate").cast("timestamp")).alias("ts"), F.struct("l_orderkey", "l_linenumber").alias("row_no"), F.col("l_quantity").alias("obs"), F.col("l_extendedprice").alias("sim"))
        return frame.aligned(x).drop("row_no")

    _add("dedup_align", dedup, "SELECT l_returnflag AS series_id, date_trunc('day', l_shipdate)::TIMESTAMP AS ts, l_quantity AS obs, l_extendedprice AS sim FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_returnflag, date_trunc('day', l_shipdate) ORDER BY l_orderkey, l_linenumber) = 1")
    _add("unit_convert_volumetric", lambda s, d: _rounded(units.converted(by_flag(s, d), "cfs", "ls")), f"WITH {sql.FLAG} SELECT series_id, ts, round(obs * 0.0283168 / 0.001, 6) AS obs, round(sim * 0.0283168 / 0.001, 6) AS sim FROM series")
    _add("unit_convert_depth_monthly", lambda s, d: _rounded(units.converted(frame.resampled(by_flag(s, d), "month"), "mm_step", "m3s", units.area_km2(100, "mi2"), monthly=True)), f"WITH {sql.FLAG} SELECT series_id, date_trunc('month', ts)::TIMESTAMP AS ts, round(avg(obs) * 258.9988 * 1000 / (day(last_day(any_value(ts))) * 86400), 6) AS obs, round(avg(sim) * 258.9988 * 1000 / (day(last_day(any_value(ts))) * 86400), 6) AS sim FROM series GROUP BY series_id, date_trunc('month', ts)")
    _add("visible_runs", lambda s, d: frame.visible_runs(by_flag(s, d), by_flag(s, d).groupBy("series_id").agg((F.count("*") > 100).alias("visible")).withColumn("visible", F.col("visible") & (F.col("series_id") != "N"))), f"WITH {sql.FLAG} SELECT {cols} FROM series WHERE series_id <> 'N' AND series_id IN (SELECT series_id FROM series GROUP BY 1 HAVING count(*) > 100)")

    def to_wide(spark: SparkSession, sf: str) -> DataFrame:
        x = by_flag(spark, sf).select("ts", F.col("series_id").alias("run_id"), "sim")
        return frame.long_runs(frame.wide_runs(x, ["A", "N", "R"], ("ts",)), ["A", "N", "R"], ("ts",)).where("sim is not null")

    _add("wide_and_long", to_wide, f"WITH {sql.FLAG} SELECT ts, series_id AS run_id, sim FROM series WHERE sim IS NOT NULL")


def _plots() -> None:
    w = "OVER (PARTITION BY series_id ORDER BY ts"
    y = lambda df: _rounded(df.select("series_id", "ts", "y"))
    head = f"WITH {sql.FLAG} SELECT series_id, ts"
    _add("moving_average", lambda s, d: y(frame.moving_average(by_flag(s, d), 7)), f"{head}, round(avg(obs) {w} ROWS 6 PRECEDING), 6) AS y FROM series")
    _add("derivative", lambda s, d: y(frame.derivative(by_flag(s, d))), f"{head}, round(obs - lag(obs) {w}), 6) AS y FROM series")
    _add("cumulative", lambda s, d: y(frame.cumulative(by_flag(s, d))), f"{head}, round(CASE WHEN obs IS NOT NULL THEN sum(obs) {w} ROWS UNBOUNDED PRECEDING) END, 6) AS y FROM series")
    _add("departure", lambda s, d: y(frame.from_mean(by_flag(s, d), 3)), f"WITH {sql.FLAG}, a AS (SELECT series_id, ts, avg(obs) {w} ROWS 2 PRECEDING) AS a FROM series) SELECT series_id, ts, round(a - avg(a) OVER (PARTITION BY series_id), 6) AS y FROM a")
    _add("fdc_weibull", lambda s, d: _rounded(frame.exceedance(by_flag(s, d))), f"WITH {sql.FLAG}, r AS (SELECT series_id, obs AS q, row_number() OVER (PARTITION BY series_id ORDER BY obs DESC)::INT AS i, count(*) OVER (PARTITION BY series_id) AS n FROM series WHERE obs IS NOT NULL) SELECT series_id, i, q, round(100.0::DOUBLE * i / (n + 1), 6) AS p FROM r")
    _add("qq", lambda s, d: _rounded(frame.quantile_pairs(by_flag(s, d))), f"WITH {sql.FLAG}, q AS (SELECT series_id, quantile_cont(obs, [i / 100.0::DOUBLE for i in range(1, 100)]) AS o, quantile_cont(sim, [i / 100.0::DOUBLE for i in range(1, 100)]) AS s FROM series GROUP BY series_id) SELECT series_id, unnest(range(1, 100))::INT AS percent, round(unnest(o), 6) AS obs_q, round(unnest(s), 6) AS sim_q FROM q")
    _add("doy_climatology", lambda s, d: _rounded(frame.doy_climatology(by_flag(s, d))), f"WITH {sql.FLAG} SELECT series_id, dayofyear(ts)::INT AS doy, round(quantile_cont(obs, 0.25), 6) AS obs_q25, round(median(obs), 6) AS obs_median, round(quantile_cont(obs, 0.75), 6) AS obs_q75, round(median(sim), 6) AS sim_median FROM series GROUP BY 1, 2")
    _add("year_doy", lambda s, d: frame.year_by_doy(hourly(s, d)), f"WITH {sql.HOURLY} SELECT series_id, year(ts)::INT AS year, dayofyear(ts)::INT AS doy, arg_max(obs, ts) AS value FROM series GROUP BY 1, 2, 3")
    _add("year_doy_matrix", lambda s, d: frame.year_matrix(by_flag(s, d)), f"WITH {sql.FLAG} SELECT series_id, year(ts)::INT AS year, " + ", ".join(f'max(CASE WHEN dayofyear(ts) = {i} THEN obs END) AS "{i}"' for i in range(1, 367)) + " FROM series GROUP BY 1, 2")
    ends = "SELECT series_id, least(0, min(least(obs, sim))) AS lo, max(greatest(obs, sim)) AS hi FROM pairs GROUP BY series_id"
    cell = lambda v, n: f"least({n - 1}, coalesce(floor(({v} - lo) / nullif(hi - lo, 0) * {n}), 0))::INT"
    # Sums, as means of four digits may end in a half.
    _add("scatter_cells", lambda s, d: plots.scatter_cells(_pairs(s, d), 60).withColumns({c: F.round(F.col(c) * F.col("n"), 4) for c in ("obs", "sim")}), f"WITH {sql.pairs()}, axis AS ({ends}) SELECT series_id, {cell('obs', 60)} AS x, {cell('sim', 60)} AS y, count(*) AS n, round(sum(obs), 4) AS obs, round(sum(sim), 4) AS sim FROM pairs JOIN axis USING (series_id) GROUP BY ALL")
    _add("heat_cells", lambda s, d: _rounded(plots.heat_cells(hourly(s, d), 61)), f"WITH {sql.HOURLY}, days AS (SELECT series_id, year(ts)::INT AS year, dayofyear(ts) AS doy, arg_max(obs, ts) AS v FROM series GROUP BY ALL) SELECT series_id, year, floor((doy - 1) * 61 / 366)::INT AS column, count(v) AS n, round(avg(v), 6) AS value FROM days GROUP BY ALL")
    at = cell("epoch_us(ts)::DOUBLE", 300)
    _add(
        "trace_cells", lambda s, d: _rounded(plots.trace_cells(by_brand(s, d), 300)),
        f"WITH {sql.BRAND}, have AS (SELECT * FROM series WHERE obs IS NOT NULL), axis AS (SELECT series_id, min(epoch_us(ts))::DOUBLE AS lo, max(epoch_us(ts))::DOUBLE AS hi FROM have GROUP BY series_id) SELECT series_id, {at} AS column, count(*) AS n, "
        "round(arg_min(obs, ts), 6) AS first, round(arg_max(obs, ts), 6) AS last, round(min(obs), 6) AS low, round(max(obs), 6) AS high FROM have JOIN axis USING (series_id) GROUP BY ALL",
    )
    _add("threshold_line", lambda s, d: _rounded(frame.threshold_line(by_flag(s, d), 50.0, True)), f"WITH {sql.FLAG} SELECT series_id, ts, round(log10(50.0::DOUBLE), 6) AS y FROM series")
    _add("colour_floor", lambda s, d: _rounded(frame.colour_floor(timing.lag_sweep(_pairs(s, d)))), f"{sql.SWEEP} SELECT series_id, round(greatest(-1, least(floor(min(r) * 20) / 20 - 0.05, 0.9)), 6)::DOUBLE AS floor FROM sweep GROUP BY series_id")


def _timing() -> None:
    found = lambda p: timing.events(p, timing.thresholds(p, DAILY), DAILY)
    simulated = lambda p: timing.events(p, timing.thresholds(p, DAILY), DAILY, "sim")
    long_ks = lambda df: df.select(*[F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes])
    _add("events_detect", lambda s, d: long_ks(found(_pairs(s, d))), f"{sql.EVENTS} SELECT * FROM events_")
    _add("event_errors", lambda s, d: long_ks(_rounded(timing.event_errors(p := _pairs(s, d), found(p), 3).select("series_id", "event_no", "peak_lag", "peak_mag_err_pct", "volume_err_pct"))), f"{sql.ERRORS} SELECT series_id, event_no, peak_lag, round(peak_mag_err_pct, 6) AS peak_mag_err_pct, round(volume_err_pct, 6) AS volume_err_pct FROM errors")
    _add("event_metrics", lambda s, d: _rounded(timing.event_metrics(timing.event_errors(p := _pairs(s, d), found(p), 3))), f"{sql.ERRORS} SELECT series_id, round(avg(volume_err_pct), 6) AS event_vol, round(avg(peak_mag_err_pct), 6) AS event_peak, median(peak_lag)::DOUBLE AS event_lag FROM errors GROUP BY series_id")
    kge = "1 - sqrt(power(r - 1, 2) + power(a - 1, 2) + power(b - 1, 2))"
    _add("lag_sweep", lambda s, d: _rounded(timing.lag_sweep(_pairs(s, d))), f"{sql.SWEEP} SELECT series_id, lag, round(nse, 6) AS nse, round({kge}, 6) AS kge, round(r, 6) AS r, round(w1, 6) AS w1 FROM sweep")
    _add("lag_best", lambda s, d: timing.best_lag(timing.lag_sweep(_pairs(s, d))), f"{sql.SWEEP} SELECT series_id, lag AS lag_best FROM sweep QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY nse DESC, lag) = 1")
    _add("w1", lambda s, d: _rounded(timing.wasserstein1(_pairs(s, d))), f"{sql.MASS} SELECT series_id, round(sum(abs(fo - fs)), 6) AS w1 FROM (SELECT *, max(k) OVER (PARTITION BY series_id) AS last FROM f) WHERE k < last GROUP BY series_id")
    _add("w2sq", lambda s, d: timing.wasserstein2sq(_pairs(s, d)).select("series_id", F.round("w2sq", 4).alias("w2sq")), f"""{sql.MASS}, u AS (SELECT series_id, fo AS u FROM f UNION ALL SELECT series_id, fs FROM f), d AS (SELECT series_id, u, u - lag(u, 1, 0) OVER (PARTITION BY series_id ORDER BY u) AS du FROM u),
h AS (SELECT d.series_id, du, o.k AS ko, s.k AS ks FROM (SELECT series_id, du, u - du / 2 AS m FROM d WHERE du > 0) d ASOF JOIN f o ON d.series_id = o.series_id AND d.m <= o.fo ASOF JOIN f s ON d.series_id = s.series_id AND d.m <= s.fs) SELECT series_id, round(sum(du * power(ko - ks, 2)), 4) AS w2sq FROM h GROUP BY series_id""")
    _add("diagnostic_efficiency", lambda s, d: _rounded(timing.diagnostic_efficiency(_pairs(s, d))), sql.DE)
    _add("ar1", lambda s, d: _rounded(timing.ar1(_pairs(s, d))), f"WITH {sql.pairs()}, c AS (SELECT series_id, obs - avg(obs) OVER (PARTITION BY series_id) AS a, k FROM pairs), l AS (SELECT *, lag(a) OVER (PARTITION BY series_id ORDER BY k) AS b FROM c) SELECT series_id, round(greatest(0, least(0.999, sum(a * b) / sum(a * a))), 6)::DOUBLE AS ar1 FROM l GROUP BY series_id")
    _add("decimated", lambda s, d: timing.decimated(_pairs(s, d), 1000, 400), f"WITH {sql.pairs()}, n AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM pairs), d AS (SELECT *, CASE WHEN n > 1000 THEN ceil(n / 400.0)::INT ELSE 1 END AS stride FROM n) SELECT series_id, (k // stride)::INT AS k, ts, obs, sim, stride FROM d WHERE k % stride = 0 AND k < (n // stride) * stride")
    _add("peak_timing", lambda s, d: _rounded(shape.peak_timing(shape.peak_table(_pairs(s, d), DAILY))), f"{sql.PEAKS} SELECT series_id, round(avg(abs(lag)), 6) AS peak_lag_abs, round(avg(lag), 6) AS peak_lag_signed, count_if(NOT resolved)::BIGINT AS unresolved FROM peaks GROUP BY series_id")
    _add("peak_table", lambda s, d: shape.peak_table(_pairs(s, d), DAILY), f"{sql.PEAKS} SELECT * FROM peaks")
    _add("event_threat", lambda s, d: _rounded(matching.event_threat(found(p := _pairs(s, d)), simulated(p), 3)), sql.THREAT)
    _add("series_distance", lambda s, d: _rounded(matching.series_distance(p := _pairs(s, d), found(p), simulated(p), DAILY)), sql.DISTANCE)
    _add("dtw", lambda s, d: shape.warping(timing.decimated(_pairs(s, d)), DAILY))
    _add("dtw_monthly", lambda s, d: _rounded(shape.warping(frame.paired(frame.resampled(by_flag(s, d), "month")), DAILY)), sql.DTW)
    _add("dtw_path_ties", lambda s, d: shape.ties(shape.warping_path(timing.decimated(p := _pairs(s, d)), DAILY), p))
    _add("xwt_by_scale", lambda s, d: shape.cross_wavelet(_pairs(s, d)))
    _add("xwt", lambda s, d: shape.cross_wavelet_lag(shape.cross_wavelet(_pairs(s, d))))
    told = "CASE WHEN unresolved > 0 THEN unresolved || ' unresolved peaks' END, CASE WHEN n > 6000 THEN 'warping ran on every d-th pair' END, CASE WHEN dry THEN 'observed flow is not perennial' END, CASE WHEN events IS NULL THEN 'no events' END"
    _add(
        "notes", lambda s, d: timing.notes(p := _pairs(s, d), shape.peak_timing(shape.peak_table(p, DAILY)), found(p)).select("series_id", F.concat_ws("; ", "notes").alias("notes")),
        f"{sql.PEAKS}, unresolved_ AS (SELECT series_id, count_if(NOT resolved) AS unresolved FROM peaks GROUP BY series_id), found_ AS (SELECT series_id, count(*) AS events FROM ({sql.EVENTS} SELECT * FROM events_) GROUP BY series_id), "
        f"each_ AS (SELECT series_id, count(*) AS n, bool_or(obs <= 0) AS dry FROM pairs GROUP BY series_id) SELECT series_id, concat_ws('; ', {told}) AS notes FROM each_ LEFT JOIN unresolved_ USING (series_id) LEFT JOIN found_ USING (series_id)",
    )
    def summary(spark: SparkSession, sf: str) -> DataFrame:
        p = _pairs(spark, sf)
        seen = found(p)
        frames = [shape.peak_timing(shape.peak_table(p, DAILY)), timing.event_metrics(timing.event_errors(p, seen, 3)), timing.wasserstein1(p), timing.diagnostic_efficiency(p), matching.series_distance(p, seen, simulated(p), DAILY)]
        long = None
        for f in frames:
            part = classical.to_long(_rounded(f), [c for c in f.columns if c in TIMING_SUMMARY])
            long = part if long is None else long.unionByName(part)
        return sinks.timing_summary(long, metric_registry(spark), ["A", "N", "R"]).drop("ordinal")

    # Whole summary but for warping and wavelets, which SQL does not have.
    parts = {"peak_timing": ("peak_lag_abs", "peak_lag_signed"), "event_metrics": ("event_peak", "event_vol", "event_lag"), "w1": ("w1",), "diagnostic_efficiency": ("de",), "series_distance": ("sd_occ", "sd_amp", "sd_time")}
    told = {r[1]: (r[2], r[4], r[8]) for r in rows()}
    values = " UNION ALL ".join(f"SELECT series_id, '{i}' AS metric_id, '{told[i][0]}' AS label, {told[i][1]}::INT AS optimum, coalesce(printf('%.{told[i][2]}f', floor({i} * 1e{told[i][2]} + 0.5) / 1e{told[i][2]}), 'n/a') AS shown FROM ({_SQL[q]})" for q, ids in parts.items() for i in ids)
    _add("timing_summary", summary, f"SELECT metric_id, label, optimum, max(CASE WHEN series_id = 'A' THEN shown END) AS A, max(CASE WHEN series_id = 'N' THEN shown END) AS N, max(CASE WHEN series_id = 'R' THEN shown END) AS R FROM ({values}) GROUP BY ALL")
    _add("report_events", lambda s, d: long_ks(_rounded(sinks.report_tables(classical.to_long(classical.wide_panel(p := _pairs(s, d)), ["nse"]), metric_registry(s), timing.event_errors(p, found(p), 3), ["A", "N", "R"])["events"].select("series_id", "event_no", "peak_lag", "peak_mag_err_pct", "volume_err_pct"))), f"{sql.ERRORS} SELECT series_id, event_no, peak_lag, round(peak_mag_err_pct, 6) AS peak_mag_err_pct, round(volume_err_pct, 6) AS volume_err_pct FROM errors WHERE event_no < 12")
    _add("panel_full", lambda s, d: full_panel(_pairs(s, d), DAILY))


def _runs() -> None:
    moved = Perturbation(shift=3, scale=1.25, dampen=0.4, offset=2.0)
    base = f"WITH {sql.pairs()}, n AS (SELECT *, max(k) OVER (PARTITION BY series_id) AS last, avg(sim) OVER (PARTITION BY series_id) AS m FROM pairs), "
    src = "q AS (SELECT a.series_id, a.k, a.obs, a.m + (b.sim - a.m) * 1.25 * 0.6 + 2 AS sim FROM n a JOIN pairs b ON a.series_id = b.series_id AND b.k = greatest(0, least(a.k - 3, a.last)))"
    pick = lambda df: _rounded(df.select("series_id", "k", "obs", "sim"))
    _add("perturb", lambda s, d: pick(sandbox.perturbed(_pairs(s, d), moved)), f"{base}{src} SELECT series_id, k::INT AS k, obs, round(sim, 6) AS sim FROM q")
    noisy = Perturbation(noise=5.0, seed=42)
    _add("perturb_uniform", lambda s, d: pick(sandbox.perturbed(_pairs(s, d), noisy)), f"WITH {sql.pairs()} SELECT series_id, k::INT AS k, obs, round(sim + ({sql.draw('k', 42)} * 2 - 1) * 5, 6) AS sim FROM pairs")
    _add("perturb_gaussian", lambda s, d: _rounded(sandbox.perturbed(_pairs(s, d), Perturbation(noise=5.0, noise_kind="gaussian")).select("series_id", "k", "sim")), f"WITH {sql.pairs()}, {sql.normals(42)} SELECT series_id, k::INT AS k, round(sim + 5 * z, 6) AS sim FROM pairs JOIN z ON j = k")
    _add("prng_uniform", lambda s, d: table(s, d, "orders").select("o_orderkey", uniform_draw(F.col("o_orderkey"), 7).alias("u")), f"SELECT o_orderkey, {sql.draw('o_orderkey', 7)} AS u FROM orders")

    def against(spark: SparkSession, sf: str) -> DataFrame:
        p = _pairs(spark, sf)
        both = p.unionByName(sandbox.perturbed(p, moved).withColumn("series_id", F.concat("series_id", F.lit(" moved"))))
        return _rounded(classical.wide_panel(both).select("series_id", "nse", "rmse", "pbias"))

    three = ["nse", "rmse", "pbias"]
    plain = lambda x: x.replace("pairs AS (", "plain_pairs AS (").replace("FROM pairs", "FROM plain_pairs").replace("JOIN pairs", "JOIN plain_pairs")
    again = f"{plain(base.removeprefix('WITH ') + src)}, pairs AS (SELECT series_id, k, obs, sim FROM plain_pairs UNION ALL SELECT series_id || ' moved', k, obs, sim FROM q)"
    _add("sandbox_compare", against, sql.wide(three, again))
    draw = sql.draw("b * blocks + blk", 12345)
    few = f"""WITH {sql.pairs()}, c AS (SELECT series_id, count(*) AS n, greatest(3, floor(cbrt(count(*)) + 0.5))::BIGINT AS len FROM pairs GROUP BY series_id), e AS (SELECT *, ceil(n / len)::BIGINT AS blocks FROM c),
g AS (SELECT *, unnest(range(blocks)) AS blk FROM (SELECT *, unnest(range(20)) AS b FROM e)), h AS (SELECT *, floor({draw} * n)::BIGINT AS start FROM g), i AS (SELECT *, unnest(range(len)) AS j FROM h),
r AS (SELECT i.series_id, b, obs, sim FROM i JOIN pairs p ON p.series_id = i.series_id AND p.k = (start + j) % n WHERE blk * len + j < n), m AS (SELECT *, avg(obs) OVER (PARTITION BY series_id, b) AS mo FROM r),
v AS (SELECT series_id, b, {sql.LOW_NSE} AS nse, sqrt(avg(power(sim - obs, 2))) AS rmse, 100 * sum(obs - sim) / sum(obs) AS pbias FROM m GROUP BY ALL), l AS (UNPIVOT v ON nse, rmse, pbias INTO NAME metric_id VALUE value)
SELECT series_id, metric_id, round(quantile_cont(value, 0.025), 6) AS lo, round(quantile_cont(value, 0.975), 6) AS hi FROM l GROUP BY ALL"""
    _add("bootstrap_ci_small", lambda s, d: _rounded(bootstrap.confidence_intervals(_pairs(s, d), b=20, ids=three)), few)
    every = [i for g in (ERROR_NORMS, CORRELATION, EFFICIENCIES, FDC) for i in _ids(g)]
    _add("bootstrap_ci", lambda s, d: _rounded(bootstrap.confidence_intervals(_pairs(s, d))), f"{sql.long(every, sql.resampled_pairs(500, 12345))} SELECT split_part(series_id, '#', 1) AS series_id, metric_id, CASE WHEN count(value) >= 400 THEN round(quantile_cont(value, 0.025), 6) END AS lo, CASE WHEN count(value) >= 400 THEN round(quantile_cont(value, 0.975), 6) END AS hi FROM long GROUP BY ALL")
    intervals = "CASE WHEN count(value) >= 400 THEN round(quantile_cont(value, 0.025), 6) END AS lo, CASE WHEN count(value) >= 400 THEN round(quantile_cont(value, 0.975), 6) END AS hi"
    _add("bootstrap_ci_sums", lambda s, d: _rounded(bootstrap.confidence_intervals(_pairs(s, d), ids=list(bootstrap.ADDITIVE))), f"{sql.long(list(bootstrap.ADDITIVE), sql.resampled_pairs(500, 12345))} SELECT split_part(series_id, '#', 1) AS series_id, metric_id, {intervals} FROM long GROUP BY ALL")

    def through_export(spark: SparkSession, sf: str) -> DataFrame:
        """The exported table with intervals, as one file, read again: text holds all digits of a value."""
        p, path, runs = _pairs(spark, sf), scratch_path(spark, "metrics"), ["A", "N", "R"]
        long = classical.to_long(classical.wide_panel(p), every)
        head = sinks.export_head("flags", p.count(), "1d", "m3s", EvalConfig())
        sinks.write_metrics_file(long, metric_registry(spark), runs, path, head, bootstrap.confidence_intervals(p, b=20, ids=three))
        return _rounded(sinks.read_metrics_file(spark, path, runs))

    labels = "CASE metric_id " + " ".join(f"WHEN '{r[1]}' THEN '{r[2]}'" for r in rows() if r[1] in every) + " END"
    _add("metrics_export", through_export, f"{sql.long(every)}, ci AS ({few}) SELECT series_id, {labels} AS metric, round(value, 6) AS value, lo, hi FROM long LEFT JOIN ci USING (series_id, metric_id)")
    used = ["nse", "kge2009", "mae", "pbias"]
    weights = {"nse": 1.0, "kge2009": 2.0, "mae": 1.0}

    def brand_metrics(spark: SparkSession, sf: str) -> DataFrame:
        x = classical.to_long(classical.wide_panel(frame.paired(by_brand(spark, sf))), used)
        return x.select(F.substring("series_id", 1, 7).alias("dataset_id"), F.col("series_id").alias("run"), "metric_id", "value")

    scored = f"""{sql.long(used, sql.pairs(sql.BRAND))}, c AS (SELECT substr(series_id, 1, 7) AS dataset_id, series_id AS run, metric_id, value, CASE WHEN metric_id IN ('nse', 'kge2009') THEN (value / (2 - value) + 1) / 2 ELSE -abs(value) END AS raw FROM long),
mm AS (SELECT *, min(raw) OVER w AS lo, max(raw) OVER w AS hi FROM c WINDOW w AS (PARTITION BY dataset_id, metric_id)), scores AS (SELECT *, CASE WHEN hi - lo < 1e-15 THEN 1 ELSE (raw - lo) / (hi - lo) END AS score FROM mm)"""
    _add("rank_scores", lambda s, d: _rounded(ranking.scored(brand_metrics(s, d), metric_registry(s)).select("dataset_id", "run", "metric_id", "score")), f"{scored} SELECT dataset_id, run, metric_id, round(score, 6) AS score FROM scores")
    composite = f"{scored}, k AS (SELECT dataset_id, run, sum(score * CASE metric_id WHEN 'kge2009' THEN 2 ELSE 1 END) / 4 AS composite FROM scores WHERE metric_id <> 'pbias' GROUP BY ALL), ranks AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY composite DESC, run)::INT AS rank FROM k)"
    _add("rank_composite", lambda s, d: _rounded(ranking.ranked(ranking.scored(brand_metrics(s, d), metric_registry(s)), weights).drop("per_metric")), f"{composite} SELECT dataset_id, run, round(composite, 6) AS composite, rank FROM ranks")

    def recommend(spark: SparkSession, sf: str) -> DataFrame:
        x = ranking.scored(brand_metrics(spark, sf), metric_registry(spark))
        return _rounded(ranking.recommended(x, ranking.ranked(x, weights), weights))

    _add("recommendation", recommend, f"{composite}, p AS (SELECT s.dataset_id, s.run, metric_id, score, row_number() OVER (PARTITION BY s.dataset_id ORDER BY score DESC, metric_id)::INT AS place FROM scores s JOIN ranks r ON s.dataset_id = r.dataset_id AND s.run = r.run WHERE rank = 1 AND metric_id <> 'pbias') SELECT dataset_id, run, place, metric_id, round(score, 6) AS score FROM p WHERE place <= 2")
    _add("best_run", lambda s, d: _rounded(ranking.best_runs(brand_metrics(s, d), metric_registry(s))), f"{scored} SELECT dataset_id, metric_id, run, round(value, 6) AS value FROM scores QUALIFY row_number() OVER (PARTITION BY dataset_id, metric_id ORDER BY raw DESC, run) = 1")


def _cells() -> None:
    def numbers(spark: SparkSession, sf: str) -> DataFrame:
        x, kind = F.round("l_extendedprice", 2), F.col("l_orderkey") % 6
        plain, grouped = F.format_string("%.2f", x), F.format_number(x, 2)
        text = F.when(kind == 0, plain).when(kind == 1, F.replace(plain, F.lit("."), F.lit(","))).when(kind == 2, grouped).when(kind == 3, F.translate(grouped, ",.", ".,")).when(kind == 4, "n/a").otherwise(F.concat(plain, F.lit("d")))
        return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", cells.bound(text, lambda x: cells.value_cell(x)).alias("value"))

    _add("parse_numeric", numbers, "SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 6 < 4 THEN round(l_extendedprice, 2) END AS value FROM lineitem")

    def dates(spark: SparkSession, sf: str) -> DataFrame:
        t, kind = F.col("l_shipdate").cast("timestamp"), F.col("l_orderkey") % 6
        f = lambda p: F.date_format(t, p)
        text = F.when(kind == 0, f("yyyy-MM-dd")).when(kind == 1, f("dd/MM/yyyy")).when(kind == 2, f("d-MMM-yyyy")).when(kind == 3, f("yyyy-DDD")).when(kind == 4, f("MMMM d, yyyy")).otherwise(F.lit("2001-02-30"))
        when = cells.bound(text, lambda x: F.coalesce(cells.julian_date(x), cells.iso_date(x), cells.named_date(x), cells.numeric_date(x, "dmy")))
        return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", when.alias("ts"))

    _add("parse_dates", dates, "SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 6 < 5 THEN date_trunc('day', l_shipdate)::TIMESTAMP END AS ts FROM lineitem")
    def given_order(spark: SparkSession, sf: str) -> DataFrame:
        t, kind = F.col("l_shipdate").cast("timestamp"), F.col("l_orderkey") % 9
        f = lambda p: F.date_format(t, p)
        shapes = ["yy-MM-dd", "yyyy/M/d", "yy.M.d", "dd.MMM.yyyy", "MMM-dd-yyyy", "MMM/d/yyyy", "MMMM d yy HH:mm", "yyyy-MM-dd", "MMM-yyyy"]
        text = F.when(kind == 0, f(shapes[0]))
        for i, p in enumerate(shapes[1:], 1):
            text = text.when(kind == i, f(p))
        return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", cells.bound(text, lambda x: cells.parsed_date(x, "ymd")).alias("ts"))

    _add("parse_dates_given_order", given_order, "SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 9 < 8 THEN date_trunc('day', l_shipdate)::TIMESTAMP END AS ts FROM lineitem")
    _add(
        "calendar",
        lambda s, d: by_flag(s, d).select("series_id", "ts", F.dayofyear("ts").alias("doy"), F.day(F.last_day("ts")).alias("days"), cells.pivot_year(F.year("ts") % 100).alias("year"), cells.shown_stamp(F.col("ts"), F.lit(86_400_000)).alias("stamp"), cells.shown_number(F.col("obs"), 2).alias("shown")),
        f"WITH {sql.FLAG} SELECT series_id, ts, dayofyear(ts)::INT AS doy, day(last_day(ts))::INT AS days, year(ts)::INT AS year, strftime(ts, '%Y-%m-%d') AS stamp, coalesce(printf('%.2f', obs), 'n/a') AS shown FROM series",
    )
    _add("csv_guard", lambda s, d: table(s, d, "events").select("event_id", cells.safe_cell(F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("="), "event_type")).when(F.col("event_id") % 3 == 1, (-F.col("event_id")).cast("string")).otherwise(F.col("event_type"))).alias("cell")), "SELECT event_id, CASE event_id % 3 WHEN 0 THEN '''=' || event_type WHEN 1 THEN (-event_id)::VARCHAR ELSE event_type END AS cell FROM events")


def _kept() -> None:
    """Metrics of a user's own, and results that are kept."""
    near = UserMetric("near_share", "Share of pairs within a fifth", lambda: {"near": F.sum((F.abs("e") * 5 <= F.col("obs")).cast("int")), "n": F.count("*")}, lambda c: c["near"] / c["n"], 1, "max")
    high_error = UserMetric("high_mae", "Mean absolute error above the mean", lambda: {"mae": F.avg(F.when(F.col("obs") > F.col("mo"), F.abs("e")))}, lambda c: c["mae"], unitful=True)
    both = ["near_share", "high_mae"]
    values = f"WITH {sql.pairs()}, m AS (SELECT *, avg(obs) OVER (PARTITION BY series_id) AS mo FROM pairs), u AS (SELECT series_id, count_if(abs(sim - obs) * 5 <= obs) / count(*) AS near_share, avg(CASE WHEN obs > mo THEN abs(sim - obs) END) AS high_mae FROM m GROUP BY series_id)"

    def panel(spark: SparkSession, sf: str) -> DataFrame:
        with user_metrics(near, high_error):
            return _rounded(classical.to_long(classical.wide_panel(_pairs(spark, sf)), both))

    def ranks(spark: SparkSession, sf: str) -> DataFrame:
        with user_metrics(near, high_error):
            long = classical.to_long(classical.wide_panel(_pairs(spark, sf)), both).select(F.lit("all").alias("dataset_id"), F.col("series_id").alias("run"), "metric_id", "value")
            scores = ranking.scored(long, metric_registry(spark))
        return _rounded(ranking.ranked(scores, {"near_share": 1.0, "high_mae": 2.0}).select("run", "composite", "rank"))

    _add("user_metrics", panel, f"{values} SELECT series_id, unnest(['near_share', 'high_mae']) AS metric_id, round(unnest([near_share, high_mae]), 6) AS value FROM u")
    _add(
        "user_metric_ranks", ranks,
        f"{values}, x AS (SELECT series_id AS run, (near_share - min(near_share) OVER ()) / (max(near_share) OVER () - min(near_share) OVER ()) AS a, 1 - (high_mae - min(high_mae) OVER ()) / (max(high_mae) OVER () - min(high_mae) OVER ()) AS b FROM u) "
        "SELECT run, round((a + 2 * b) / 3, 6) AS composite, (row_number() OVER (ORDER BY (a + 2 * b) / 3 DESC, run))::INT AS rank FROM x",
    )

    def kept(spark: SparkSession, sf: str) -> DataFrame:
        """Results of all brands are kept, then one brand's series is changed: only its metrics are made anew."""
        path, first = scratch_path(spark, "results"), written(by_brand(spark, sf), "series")
        evaluate_stored(first, path)
        changed = first.withColumn("sim", F.when(F.col("series_id") == "Brand#11", F.col("sim") * 2).otherwise(F.col("sim")))
        anew = written(stale(changed, path).select("series_id", F.lit(True).alias("anew")), "anew")
        out = evaluate_stored(changed, path).join(anew, "series_id", "left")
        return _rounded(out.select("series_id", "metric_id", "value", F.coalesce("anew", F.lit(False)).alias("anew")))

    every = [i for g in (ERROR_NORMS, CORRELATION, EFFICIENCIES, FDC) for i in _ids(g)]
    doubled = f"{sql.BRAND.replace('series AS', 'given AS', 1)}, series AS (SELECT series_id, ts, obs, CASE WHEN series_id = 'Brand#11' THEN sim * 2 ELSE sim END AS sim FROM given)"
    _add("stored_results", kept, f"{sql.long(every, sql.pairs(doubled))} SELECT series_id, metric_id, round(value, 6) AS value, series_id = 'Brand#11' AS anew FROM long")


def _sets() -> None:
    """Data sets in the catalogue, and a grid of perturbations."""
    first = dt.datetime(1996, 1, 1), dt.datetime(1998, 12, 31)

    def sets(spark: SparkSession, sf: str) -> DataFrame:
        """Saved, duplicated, the copy edited, a monthly subset committed; both names and the subset are read from the catalogue."""
        name = f"freshet_{uuid.uuid4().hex}"
        d = DataSets(spark, name)
        d.save("daily", by_flag(spark, sf))
        d.duplicate("daily", "copy")
        d.save("copy", d.read("copy").withColumn("sim", F.col("sim") * 2))
        d.commit("months", "copy", window=tuple(F.lit(x) for x in first), to="month")
        parts = [d.read(n).select(F.lit(n).alias("dataset_id"), F.lit(v.version).alias("version"), F.lit(v.step_ms).cast("long").alias("step_ms"), "series_id", "ts", "obs", "sim") for n in d.names() for v in [d.version(n)]]
        return _rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]))

    _add(
        "dataset_versions", sets,
        f"""WITH {sql.FLAG} SELECT 'daily' AS dataset_id, 1::INT AS version, 86400000::BIGINT AS step_ms, series_id, ts, round(obs, 6) AS obs, round(sim, 6) AS sim FROM series
UNION ALL SELECT 'copy', 2, 86400000, series_id, ts, round(obs, 6), round(sim * 2, 6) FROM series
UNION ALL SELECT 'months', 1, 2592000000, series_id, date_trunc('month', ts)::TIMESTAMP, round(avg(obs), 6), round(avg(sim * 2), 6) FROM series WHERE ts BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-12-31' GROUP BY ALL""",
    )

    settings = {"late": Perturbation(shift=3), "early": Perturbation(shift=-7), "damped": Perturbation(shift=12, scale=1.25, dampen=0.4, offset=2.0), "noisy": Perturbation(shift=1, noise=5.0)}
    ids = ("nse", "kge2009", "r", "rmse", "pbias", "lag_best", "w1")
    moved = f"""{sql.pairs().replace("pairs AS", "plain_pairs AS")}, base AS (SELECT series_id, k, ts, obs, max(k) OVER (PARTITION BY series_id) AS last, avg(obs) OVER (PARTITION BY series_id) AS m FROM plain_pairs),
settings(setting, shift, gain, added, noise) AS (VALUES ('base', 0, 1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE), ('late', 3, 1, 0, 0), ('early', -7, 1, 0, 0), ('damped', 12, 1.25 * 0.6, 2, 0), ('noisy', 1, 1, 0, 5)),
pairs AS (SELECT setting || '/' || a.series_id AS series_id, a.k, a.ts, a.obs, a.m + (b.obs - a.m) * gain + added + CASE WHEN noise > 0 THEN ({sql.draw('a.k', 42)} * 2 - 1) * noise ELSE 0 END AS sim
  FROM base a CROSS JOIN settings JOIN base b ON b.series_id = a.series_id AND b.k = greatest(0, least(a.k - shift, a.last)))"""
    values = " UNION ALL ".join(f"SELECT series_id, '{i}' AS metric_id, {sql.METRICS[i]} AS value FROM panel" for i in ids[:5])
    values += " UNION ALL SELECT series_id, 'lag_best', arg_max(lag, (nse, -lag))::DOUBLE FROM sweep WHERE nse IS NOT NULL GROUP BY series_id UNION ALL SELECT series_id, 'w1', w1 FROM sweep WHERE lag = 0"
    _add(
        "sandbox_grid", lambda s, d: _rounded(sandbox.compared(_pairs(s, d), settings, DAILY, synthetic=True, ids=ids)),
        f"WITH {sql.panel(moved)}{sql.SWEEP.split(sql.pairs(), 1)[1]}, v AS ({values}) SELECT split_part(v.series_id, '/', 2) AS series_id, setting, metric_id, round(value, 6) AS value, CASE WHEN metric_id = 'lag_best' THEN shift END::INT AS injected FROM v JOIN settings ON setting = split_part(v.series_id, '/', 1)",
    )


for _build in (_panels, _frames, _plots, _timing, _runs, _cells, _kept, _sets):
    _build()


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
