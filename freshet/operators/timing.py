"""Timing and shape measures that joins, windows and aggregations express. Positions count pairs, not calendar steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.stats import finite, over, pearson, simpson_weight
from ..plans.config import TimingConfig
from . import ranges
from .classical import flow_duration


#: Places of a block of the lag sweep.
LAG_BLOCK = 32_768


def by_place() -> WindowSpec:
    return Window.partitionBy("series_id").orderBy("k")


def whole() -> WindowSpec:
    return Window.partitionBy("series_id")


def thresholds(pairs: DataFrame, cfg: TimingConfig) -> DataFrame:
    """(series_id, threshold) of the observed side."""
    t = F.percentile("obs", F.lit(cfg.threshold / 100)) if cfg.threshold_kind == "percentile" else F.max(F.lit(float(cfg.threshold)))
    return pairs.groupBy("series_id").agg(t.alias("threshold"))


def events(pairs: DataFrame, threshold: DataFrame, cfg: TimingConfig, c: str = "obs", rows: int = ranges.BLOCK) -> DataFrame:
    """(series_id, event_no, start_k, end_k, peak_k, peak_q): runs above the threshold; runs closer than min_distance are one, and
    its peak is the higher one, the first of equals.

    Events are found in blocks of ``rows`` places. A block's first event goes on with the last one before the block if that is near;
    one row a block (first start, last end, number of events) tells, and numbers the events of the series."""
    apart = max(cfg.min_distance, 2)
    x = pairs.join(threshold, "series_id").where((F.col(c) > F.col("threshold")) & (F.col("k") >= cfg.warmup)).select("series_id", "k", F.col(c).alias("q"), ranges.block_of(rows=rows).alias("block"))
    order = Window.partitionBy("series_id", "block").orderBy("k")
    far = F.coalesce(F.col("k") - F.lag("k").over(order) >= apart, F.lit(True))
    x = x.withColumn("far", far.cast("long")).withColumn("event", F.sum("far").over(order))
    top = F.max(F.struct("q", (-F.col("k")).alias("less"))).alias("top")
    parts = x.groupBy("series_id", "block", "event").agg(F.min("k").alias("start_k"), F.max("k").alias("end_k"), top)
    by_block = parts.groupBy("series_id", "block").agg(F.min("start_k").alias("start"), F.max("end_k").alias("end"), F.max("event").alias("count"))
    blocks = Window.partitionBy("series_id").orderBy("block")
    goes_on = F.coalesce(F.col("start") - F.lag("end").over(blocks) < apart, F.lit(False)).cast("long")
    numbers = by_block.withColumn("on", goes_on).select("series_id", "block", (F.sum(F.col("count") - F.col("on")).over(blocks.rowsBetween(Window.unboundedPreceding, 0)) - F.col("count")).alias("before"))
    merged = parts.join(numbers, ["series_id", "block"]).withColumn("event_no", F.col("before") + F.col("event") - 1)
    merged = merged.groupBy("series_id", "event_no").agg(F.min("start_k").alias("start_k"), F.max("end_k").alias("end_k"), F.max("top").alias("top"))
    return merged.select("series_id", "event_no", "start_k", "end_k", (-F.col("top.less")).alias("peak_k"), F.col("top.q").alias("peak_q"))


def event_errors(pairs: DataFrame, found: DataFrame, tolerance: int) -> DataFrame:
    """Per observed event: lag and size of the simulated peak in the event's window, volume over the event. A few rows an event
    meet the pairs by position: an equi-join on positions that each event lists."""
    at = found.withColumn("k", F.explode(F.sequence(F.greatest(F.lit(0), F.col("start_k") - tolerance), F.col("end_k") + tolerance)))
    x = at.join(pairs.select("series_id", "k", "obs", "sim"), ["series_id", "k"])
    inside = F.col("k").between(F.col("start_k"), F.col("end_k"))
    g = x.groupBy("series_id", "event_no", "start_k", "end_k", "peak_k", "peak_q").agg(
        F.max(F.struct("sim", (-F.col("k")).alias("less"))).alias("top"), F.sum(F.when(inside, F.col("obs"))).alias("vol_o"), F.sum(F.when(inside, F.col("sim"))).alias("vol_s")
    )
    return g.select(
        "series_id", "event_no", "start_k", "end_k", "peak_k", "peak_q", (-F.col("top.less") - F.col("peak_k")).alias("peak_lag"),
        over(100 * (F.col("top.sim") - F.col("peak_q")), F.col("peak_q")).alias("peak_mag_err_pct"), over(100 * (F.col("vol_s") - F.col("vol_o")), F.col("vol_o")).alias("volume_err_pct"),
    )


def event_metrics(errors: DataFrame) -> DataFrame:
    return errors.groupBy("series_id").agg(F.avg("volume_err_pct").alias("event_vol"), F.avg("peak_mag_err_pct").alias("event_peak"), F.median("peak_lag").alias("event_lag"))


KINDS = {pa.string(): "string", pa.int32(): "int", pa.int64(): "long", pa.float64(): "double"}
SWEEP = pa.schema([("series_id", pa.string()), ("lag", pa.int32()), ("n", pa.int64()), *[(c, pa.float64()) for c in ("a", "b", "ab", "aa", "bb", "see", "to", "ts_", "least", "lo_", "hi_", "gap")]])


def _lagged_sums(own: np.ndarray, k: np.ndarray, cols: dict[str, np.ndarray], mean: tuple[float, float], lags: range, edges: dict[int, dict]) -> Iterator[tuple]:
    """What the pairs of one block (own) add to each lag's sums; rows lie in order of k, with neighbours on both sides."""
    here = np.flatnonzero(own)
    for lag in lags:
        at = here + lag
        fits = (at >= 0) & (at < len(k))
        i, j = here[fits], at[fits]
        if not len(i):
            continue
        o, s = cols["obs"][i], cols["sim"][j]
        a, b, e, edge = o - mean[0], s - mean[1], s - o, edges[lag]
        gap = None
        if edge["to"] and edge["ts"]:
            inner = k[i] < edge["last"]
            gap = float(np.abs((cols["po"][i] - edge["o"]) / edge["to"] - (cols["ps"][j] - edge["s"]) / edge["ts"])[inner].sum())
        sums = a.sum(), b.sum(), a @ b, a @ a, b @ b, e @ e, o.sum(), s.sum(), min(o.min(), s.min()), o.min(), o.max(), gap
        yield lag, len(i), *(None if v is None or v != v else float(v) for v in sums)  # a series without a transform has no values


def lag_sweep(pairs: DataFrame, lo: int = -30, hi: int = 30, rows: int = LAG_BLOCK) -> DataFrame:
    """(series_id, lag, nse, kge, r, w1): obs at t against sim at t + lag, over the overlap; masses below 0 have no w1.

    Pairs are dealt by blocks of ``rows`` places that also hold the neighbours within the lags, so a block adds to each lag's sums on its
    own, and a row a block and lag is left to aggregate: moments about the series' means, moved to the overlap's own afterwards,
    and gaps between running sums, which start at the overlap's edge (its sums come from the few pairs at a series' ends)."""
    most, key = max(abs(lo), abs(hi)), ["series_id"]
    sizes = pairs.groupBy(*key).agg(F.count("*").alias("n"), F.avg("obs").alias("mo"), F.avg("sim").alias("ms"))
    x = pairs.select("series_id", F.col("k").cast("long").alias("k"), "obs", "sim").withColumn("block", ranges.block_of(rows=rows))
    x = ranges.running(x, key, "block", [F.col("k")], {"po": F.col("obs"), "ps": F.col("sim")}).drop("block")
    ends = x.join(sizes.select("series_id", "n"), key).where((F.col("k") <= most) | (F.col("k") >= F.col("n") - 1 - most))
    ends = ends.groupBy("series_id", "n").agg(F.map_from_entries(F.collect_list(F.struct("k", F.struct("po", "ps")))).alias("at"))
    sums = lambda k, c: F.coalesce(F.try_element_at(F.col("at"), k)[c], F.lit(0.0))

    def edges(lag: Column) -> Column:
        first, last, zero = F.greatest(F.lit(0), -lag), F.col("n") - 1 - F.greatest(F.lit(0), lag), F.greatest(F.lit(0), lag)
        before_o, before_s = sums(first - 1, "po"), sums(zero - 1, "ps")
        return F.struct(lag.alias("lag"), last.alias("last"), before_o.alias("o"), before_s.alias("s"), (sums(last, "po") - before_o).alias("to"), (sums(last + lag, "ps") - before_s).alias("ts"))

    edged = sizes.join(ends.select("series_id", F.transform(F.sequence(F.lit(lo).cast("long"), F.lit(hi).cast("long")), edges).alias("edges")), key)
    of_block = edged.withColumn("block_", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / rows)))).select(F.col("series_id").alias("id_"), F.col("block_").alias("at_"), "mo", "ms", "edges")
    near = ranges.neighbours(x, key, most, most, rows).select("series_id", "block_", "k", "own_", "obs", "sim", "po", "ps")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(left) and len(right):
            left, about = left.sort_by("k"), right.select(["mo", "ms", "edges"]).slice(0, 1).to_pylist()[0]
            cols = {c: left[c].to_numpy().astype(float) for c in ("obs", "sim", "po", "ps")}
            known = {e["lag"]: e for e in about["edges"]}
            sums = _lagged_sums(left["own_"].to_numpy(), left["k"].to_numpy(), cols, (about["mo"], about["ms"]), range(lo, hi + 1), known)
            out = [(left["series_id"][0].as_py(), *r) for r in sums]
        return pa.table({f.name: pa.array([r[i] for r in out], f.type) for i, f in enumerate(SWEEP)})

    each = near.groupBy("series_id", "block_").cogroup(of_block.groupBy("id_", "at_")).applyInArrow(run, ", ".join(f"{f.name} {KINDS[f.type]}" for f in SWEEP))
    plain = [F.sum(c).alias(c) for c in ("n", "a", "b", "ab", "aa", "bb", "see", "to", "ts_", "gap")]
    g = each.groupBy("series_id", "lag").agg(*plain, F.min("least").alias("least"), F.min("lo_").alias("lo_"), F.max("hi_").alias("hi_"))
    g = g.join(sizes.select("series_id", F.col("mo").alias("at_o"), F.col("ms").alias("at_s")), key)
    n = F.col("n")
    mo, ms = F.col("at_o") + F.col("a") / n, F.col("at_s") + F.col("b") / n
    flat = F.col("lo_") >= F.col("hi_")
    cov, vo, vs = F.col("ab") - F.col("a") * F.col("b") / n, F.when(flat, 0.0).otherwise(F.col("aa") - F.col("a") * F.col("a") / n), F.greatest(F.lit(0.0), F.col("bb") - F.col("b") * F.col("b") / n)
    r = pearson(cov, vo, vs, mo, ms, n)
    kge = finite(1 - F.sqrt(F.pow(r - 1, F.lit(2)) + F.pow(over(F.sqrt(vs), F.sqrt(vo)) - 1, F.lit(2)) + F.pow(over(ms, mo) - 1, F.lit(2))))
    good = (F.col("least") >= 0) & (F.col("to") > 0) & (F.col("ts_") > 0)
    return g.select("series_id", "lag", F.when(~flat, 1 - over(F.col("see"), vo)).alias("nse"), kge.alias("kge"), r.alias("r"), F.when(good, F.col("gap")).alias("w1"))


def best_lag(sweep: DataFrame) -> DataFrame:
    """The lag of the best NSE, the first of equals; none if no lag has one."""
    return sweep.groupBy("series_id").agg(F.max(F.when(F.col("nse").isNotNull(), F.struct("nse", (-F.col("lag")).alias("less")))).alias("b")).select("series_id", (-F.col("b.less")).alias("lag_best"))


def _masses(pairs: DataFrame, rows: int) -> DataFrame:
    """(series_id, k, last, fo, fs): both sides' running shares of their sums, in blocks of places; series without masses are absent."""
    key = ["series_id"]
    sizes = pairs.groupBy(*key).agg(F.min(F.least("obs", "sim")).alias("low"), F.sum("obs").alias("to"), F.sum("sim").alias("ts_"), F.max("k").alias("last"))
    sizes = sizes.where("low >= 0 and `to` > 0 and ts_ > 0")
    x = pairs.select("series_id", "k", "obs", "sim", ranges.block_of(rows=rows).alias("block")).join(sizes, key)
    x = ranges.running(x, key, "block", [F.col("k")], {"fo": F.col("obs") / F.col("to"), "fs": F.col("sim") / F.col("ts_")})
    return x.select("series_id", "k", "last", "fo", "fs")


def _of_all(pairs: DataFrame, result: DataFrame) -> DataFrame:
    return pairs.select("series_id").distinct().join(result, "series_id", "left")


def wasserstein1(pairs: DataFrame, rows: int = ranges.BLOCK) -> DataFrame:
    gap = F.when(F.col("k") < F.col("last"), F.abs(F.col("fo") - F.col("fs"))).otherwise(0.0)
    return _of_all(pairs, _masses(pairs, rows).groupBy("series_id").agg(F.sum(gap).alias("w1")))


def wasserstein2sq(pairs: DataFrame, rows: int = ranges.BLOCK) -> DataFrame:
    """The integral of the squared gap of both inverse distribution functions: both sets of breakpoints in one order, and between
    two breakpoints the first position of either side whose sum reaches the later one. Breakpoints are dealt by ranges; a row a range
    tells what lies before and after it."""
    c = _masses(pairs, rows)
    u = c.select("series_id", "last", F.inline(F.array(F.struct(F.col("fo").alias("u"), F.col("k").alias("ko"), F.lit(None).cast("int").alias("ks")), F.struct(F.col("fs").alias("u"), F.lit(None).cast("int").alias("ko"), F.col("k").alias("ks")))))
    u = ranges.with_ranges(u, ["series_id"], F.col("u"), rows)
    piece = Window.partitionBy("series_id").orderBy("range_")
    later = Window.partitionBy("series_id").orderBy(F.desc("range_")).rowsBetween(Window.unboundedPreceding, -1)
    around = u.groupBy("series_id", "range_").agg(F.max("u").alias("hi"), F.min("ko").alias("lo_o"), F.min("ks").alias("lo_s"))
    around = around.select("series_id", "range_", F.lag("hi").over(piece).alias("hi_before"), F.min("lo_o").over(later).alias("o_after"), F.min("lo_s").over(later).alias("s_after"))
    order = Window.partitionBy("series_id", "range_").orderBy("u", F.coalesce("ko", "ks"), F.isnull("ko"))
    # The first position ahead, as a running value over the reverse order: a frame that ends at the partition's end would be quadratic.
    # Sums over blocks may round a position without mass under the one before it; the least position is right all the same.
    ahead = Window.partitionBy("series_id", "range_").orderBy(F.desc("u"), F.coalesce("ko", "ks").desc(), F.isnull("ko").desc()).rowsBetween(Window.unboundedPreceding, 0)
    x = u.withColumns({"before": F.lag("u").over(order), "o": F.min("ko").over(ahead), "s": F.min("ks").over(ahead)}).join(around, ["series_id", "range_"])
    du = F.least(F.col("u"), F.lit(1.0)) - F.least(F.coalesce("before", "hi_before", F.lit(0.0)), F.lit(1.0))
    gap = F.coalesce("o", "o_after", "last") - F.coalesce("s", "s_after", "last")
    return _of_all(pairs, x.groupBy("series_id").agg(F.sum(du * gap * gap).alias("w2sq")))


def _near_zero(x: Column) -> Column:
    return F.when(F.abs(x) < 0.001, 0.0).otherwise(x)


def diagnostic_efficiency(pairs: DataFrame) -> DataFrame:
    """de, de_const, de_dyn, phi, phi_fdc and non_perennial from the flow-duration curves' relative bias."""
    b = F.when(F.col("s") == F.col("o"), 0.0).otherwise(F.try_divide(F.col("s") - F.col("o"), F.col("o")))
    x = flow_duration(pairs).withColumn("b", b).where("b is not null")
    x = x.withColumn("j", F.row_number().over(Window.partitionBy("series_id").orderBy("i")) - 1).withColumns({"n": F.count("*").over(whole()), "mean": F.avg("b").over(whole())})
    res, n, j = F.col("b") - F.col("mean"), F.col("n"), F.col("j")
    mid = F.floor(n / 2)
    low, m2 = j - mid, n - mid
    g = x.groupBy("series_id").agg(
        F.avg("b").alias("raw"), F.sum(F.abs(res) * simpson_weight(j, n) * F.try_divide(F.lit(1.0), n - 1)).alias("area"),
        F.sum(F.when(j < mid, res * simpson_weight(j, mid) * F.try_divide(F.lit(0.5), mid - 1))).alias("high"), F.sum(F.when(j >= mid, res * simpson_weight(low, m2) * F.try_divide(F.lit(0.5), m2 - 1))).alias("low"),
    )
    st = pairs.groupBy("series_id").agg(F.avg("obs").alias("mo"), F.avg("sim").alias("ms"))
    o, s = F.col("obs") - F.col("mo"), F.col("sim") - F.col("ms")
    c = pairs.join(st, "series_id").groupBy("series_id", "mo", "ms").agg(F.sum(o * s).alias("cov"), F.sum(o * o).alias("vo"), F.sum(s * s).alias("vs"), F.count("*").alias("n"), F.max((F.col("obs") <= 0).cast("int")).alias("dry"))
    r = pearson(F.col("cov"), F.col("vo"), F.col("vs"), F.col("mo"), F.col("ms"), F.col("n"))
    const, dyn = _near_zero(F.col("raw")), _near_zero(F.coalesce("area", F.lit(0.0)))
    h, lo = F.coalesce("high", F.lit(0.0)), F.coalesce("low", F.lit(0.0))
    way = F.when(((h > 0) & (lo < 0)) | ((h == 0) & (lo < 0)) | ((h > 0) & (lo == 0)), -1.0).when(((h < 0) & (lo > 0)) | ((h == 0) & (lo > 0)) | ((h < 0) & (lo == 0)), 1.0).otherwise(0.0)
    cap = lambda v: F.least(_near_zero(v), F.lit(3.1414))
    de = finite(F.sqrt(const * const + dyn * dyn + F.pow(r - 1, F.lit(2))))
    return c.join(g, "series_id").select("series_id", de.alias("de"), const.alias("de_const"), dyn.alias("de_dyn"), cap(F.atan2(const, dyn * way)).alias("phi"), cap(F.atan2(const, dyn)).alias("phi_fdc"), (F.col("dry") == 1).alias("non_perennial"))


def ar1(series: DataFrame, c: str = "obs") -> DataFrame:
    """Lag-1 autocorrelation between 0 and 0.999."""
    x = series.withColumn("m", F.avg(c).over(whole())).withColumn("before", F.lag(c).over(by_place()))
    a = F.col(c) - F.col("m")
    g = x.groupBy("series_id").agg(F.sum(a * (F.col("before") - F.col("m"))).alias("num"), F.sum(a * a).alias("den"))
    return g.select("series_id", F.greatest(F.lit(0.0), F.least(F.lit(0.999), over(F.col("num"), F.col("den")))).alias("ar1"))


def decimated(pairs: DataFrame, most: int = 6000, to: int = 4000) -> DataFrame:
    """Every d-th pair of series longer than ``most``, d = ceil(n / to), and k counted anew."""
    x = pairs.withColumn("n", F.count("*").over(whole())).withColumn("d", F.when(F.col("n") > most, F.ceil(F.col("n") / to)).otherwise(1))
    x = x.where((F.col("k") % F.col("d") == 0) & (F.col("k") < F.floor(F.col("n") / F.col("d")) * F.col("d")))
    return x.select("series_id", (F.col("k") / F.col("d")).cast("int").alias("k"), "ts", "obs", "sim", F.col("d").cast("int").alias("stride"))


def notes(pairs: DataFrame, unresolved: DataFrame, found: DataFrame, transform: str = "none", most: int = 6000) -> DataFrame:
    """(series_id, notes): what a reader of a panel should know."""
    x = pairs.groupBy("series_id").agg(F.count("*").alias("n"), F.max((F.col("obs") <= 0).cast("int")).alias("dry"))
    x = x.join(unresolved.select("series_id", "unresolved"), "series_id", "left").join(found.groupBy("series_id").agg(F.count("*").alias("events")), "series_id", "left")
    texts = [F.when(F.col("unresolved") > 0, F.concat(F.col("unresolved").cast("string"), F.lit(" unresolved peaks"))), F.when(F.col("n") > most, "warping ran on every d-th pair"), F.when(F.col("dry") == 1, "observed flow is not perennial"), F.when(F.col("events").isNull(), "no events"), F.lit(f"{transform} transform" if transform != "none" else None)]
    return x.select("series_id", F.array_compact(F.array(*texts)).alias("notes"))
