"""The 45 classical metrics, in one of two ways to the same values.

Input: pairs (series_id, k, obs, sim), both values finite. Short series take one exchange by series, to as many tasks as their pairs need:
windows give each pair its neighbours, ranks and places by observed value, simulated value and error; quantiles and flow-duration sums are read off the
places, and one aggregation makes every sum a metric needs. Once a series has more than LONG pairs no window spans a series: sums are
plain aggregations, the value before comes from blocks of places that overlap by one, and ranks, quantiles and flow-duration sums come
from the distinct values of each side, ranked range by range. Everything a metric shares with another is computed once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import finite, js_round, over, pearson
from ..plans.registry import user_sums, user_values
from ..sources.scratch import deleted, written
from . import ranges

EPS = 0.01
#: Pairs of a series beyond which it is spread over tasks, and pairs of short series that a task takes.
LONG, TASK = 2_000_000, 131_072


def _square(x: Column) -> Column:
    return x * x


def placed(pairs: DataFrame) -> DataFrame:
    """Each pair with its series' n, mo and ms (means), the obs before it, and by obs, sim, error e and abs(e): its place from 0
    (at_o, at_s, at_e, at_a); average ranks ro and rs. All windows share one partitioning."""
    w = Window.partitionBy("series_id")
    peers = lambda c: w.orderBy(c).rangeBetween(Window.currentRow, Window.currentRow)
    rank = lambda c: F.rank().over(w.orderBy(c)) + (F.count("*").over(peers(c)) - 1) / 2
    place = lambda c: F.row_number().over(w.orderBy(c)) - 1
    x = pairs.select("series_id", "k", "obs", "sim", (F.col("sim") - F.col("obs")).alias("e"))
    x = x.withColumns({"n": F.count("*").over(w), "mo": F.avg("obs").over(w), "ms": F.avg("sim").over(w)}).withColumn("before", F.lag("obs").over(w.orderBy("k")))
    x = x.withColumns({"ro": rank("obs"), "at_o": place("obs")}).withColumns({"rs": rank("sim"), "at_s": place("sim")})
    return x.withColumn("at_e", place("e")).withColumn("a", F.abs("e")).withColumn("at_a", place("a"))


def _between(at: Column, x: Column, q: float) -> list[Column]:
    """Aggregates for the quantile q of x, whose places from 0 are ``at``: the value at or below it, and the one above."""
    h = (F.col("n") - 1) * F.lit(q)
    return [F.max(F.when(at == F.floor(h), x)), F.max(F.when(at == F.ceil(h), x))]


#: Quantiles of obs, sim, error and absolute error, and the shares of the flow-duration curve's ends.
QUANTILES = {"o": (0.25, 0.75, 1 - 0.2, 1 - 0.7, 0.5), "s": (1 - 0.2, 1 - 0.7, 0.5), "e": (0.5,), "a": (0.5,)}
HIGH, LOW = 0.02, 0.3


def _plain_sums() -> dict[str, Column]:
    """Aggregates over pairs with e, n, mo and ms that no order matters to, those of registered metrics among them."""
    o, s, e, mo, ms, n = (F.col(c) for c in ("obs", "sim", "e", "mo", "ms", "n"))
    a, b = o - mo, s - ms
    ratio = F.when((o > 0) & (s > 0), F.ln(F.try_divide(s, o)))
    rel, eps = F.abs(F.try_divide(e, o)), mo * EPS
    lo, ls = _ln(o + eps), _ln(s + eps)
    reach = F.abs(s - mo) + F.abs(a)
    return {
        "n": F.max(n), "mo": F.max(mo), "ms": F.max(ms), "so": F.stddev_pop(o), "ss": F.stddev_pop(s),
        "min_o": F.min(o), "max_o": F.max(o), "min_any": F.min(F.least(o, s)), "zero_o": F.max((o == 0).cast("int")), "zero_both": F.max(((o == 0) & (s == 0)).cast("int")),
        "me": F.avg(e), "mae": F.avg(F.abs(e)), "mse": F.avg(e * e), "see": F.sum(e * e), "sae": F.sum(F.abs(e)), "sum_o": F.sum(o), "abs_o": F.sum(F.abs(o)),
        "cov": F.sum(a * b), "vo": F.sum(a * a), "vs": F.sum(b * b), "dev_o": F.sum(F.abs(a)),
        "reach2": F.sum(_square(reach)), "reach1": F.sum(reach), "reach_rel": F.sum(_square(F.try_divide(reach, mo))), "rel2": F.sum(_square(F.try_divide(e, o))), "dev_rel": F.sum(_square(F.try_divide(a, mo))),
        "mle": F.avg(ratio), "male": F.avg(F.abs(ratio)), "msle": F.avg(ratio * ratio),
        "mape": 100 * F.avg(rel), "smape": 100 * F.avg(F.coalesce(F.try_divide(F.abs(e), (F.abs(o) + F.abs(s)) / 2), F.lit(0.0))),
        "maape": F.avg(F.when(o == 0, F.pi() / 2).otherwise(F.atan(rel))),
        "log_see": F.sum(_square(lo - ls)), "log_vo": F.var_pop(lo) * F.count("*"), "log_bad": F.max((lo.isNull() | ls.isNull()).cast("int")),
    } | user_sums()


def _rank_sums() -> dict[str, Column]:
    ra, rb = F.col("ro") - (F.col("n") + 1) / 2, F.col("rs") - (F.col("n") + 1) / 2
    return {"rank_cov": F.sum(ra * rb), "rank_vo": F.sum(ra * ra), "rank_vs": F.sum(rb * rb)}


def _ends() -> tuple[Column, Column]:
    """Places in falling order: those of the curve's high end lie before the first, those of its low end from the second on."""
    n = F.col("n")
    return F.greatest(F.lit(1), js_round(n * F.lit(HIGH))), F.floor(n * F.lit(1 - LOW))


def series_sums(x: DataFrame) -> DataFrame:
    """One row a series from ``placed`` pairs: extremes, quantiles, and the sums that the metrics are made of."""
    o, s, e, n, eps = F.col("obs"), F.col("sim"), F.col("e"), F.col("n"), F.col("mo") * EPS
    lo, ls = _ln(o + eps), _ln(s + eps)
    top, tail = _ends()
    down_o, down_s = n - 1 - F.col("at_o"), n - 1 - F.col("at_s")
    tail_o, tail_s = down_o >= tail, down_s >= tail
    aggregates = _plain_sums() | _rank_sums() | {
        "step": F.avg(F.abs(o - F.col("before"))), "top_o": F.sum(F.when(down_o < top, o)), "top_s": F.sum(F.when(down_s < top, s)),
        "low_o": F.sum(F.when(tail_o, lo)), "low_min_o": F.min(F.when(tail_o, lo)), "low_s": F.sum(F.when(tail_s, ls)), "low_min_s": F.min(F.when(tail_s, ls)), "low_n": F.sum(tail_o.cast("int")),
        "low_bad": F.max(((tail_o & lo.isNull()) | (tail_s & ls.isNull())).cast("int")),
    }
    sides = {"o": ("at_o", o), "s": ("at_s", s), "e": ("at_e", e), "a": ("at_a", F.col("a"))}
    for side, (at, value) in sides.items():
        for i, q in enumerate(QUANTILES[side]):
            aggregates |= {f"{side}{i}_{end}": v for end, v in zip(("lo", "hi"), _between(F.col(at), value, q), strict=True)}
    return _with_quantiles(x.groupBy("series_id").agg(*[v.alias(k) for k, v in aggregates.items()]))


def _with_quantiles(g: DataFrame) -> DataFrame:
    """Quantiles from the values around them, and the ends of the flow-duration curve."""

    def quantile(side: str, i: int, q: float) -> Column:
        below, above, h = F.col(f"{side}{i}_lo"), F.col(f"{side}{i}_hi"), (F.col("n") - 1) * F.lit(q)
        return below + (above - below) * (h - F.floor(h))

    below, above = F.col("a0_lo"), F.col("a0_hi")
    below_o, below_s = F.col("low_o") - F.col("low_n") * F.col("low_min_o"), F.col("low_s") - F.col("low_n") * F.col("low_min_s")
    return g.withColumns({
        "qo": F.array(*[quantile("o", i, q) for i, q in enumerate(QUANTILES["o"])]), "qs": F.array(*[quantile("s", i, q) for i, q in enumerate(QUANTILES["s"])]),
        "mde": quantile("e", 0, 0.5), "mdae": quantile("a", 0, 0.5), "mdse": (below * below + above * above) / 2,
        "fhv": over(100 * (F.col("top_s") - F.col("top_o")), F.col("top_o")), "flv": F.when(F.col("low_bad") == 0, over(-100 * (below_s - below_o), below_o)),
    })


def long_series_sums(pairs: DataFrame, rows: int = ranges.RANGE) -> DataFrame:
    """What ``series_sums`` and ``curve_distance`` give, with no more than a block or a range of a series in one task. The pairs and
    their ranked values are written while it runs; a row a series is left."""
    key = ["series_id"]
    pairs = written(pairs.select("series_id", "k", "obs", "sim"), "pairs")
    sizes = pairs.groupBy(*key).agg(F.count("*").alias("n"), F.avg("obs").alias("mo"), F.avg("sim").alias("ms"))
    # A series' size and means are given to each of its pieces, so that no join sends all its rows to one task.
    piece = ranges.block_of(rows=rows)
    blocks = pairs.select("series_id", piece.alias("block_")).distinct().join(sizes, key)
    x = pairs.select("series_id", "k", "obs", "sim", (F.col("sim") - F.col("obs")).alias("e"), piece.alias("block_")).join(blocks, ["series_id", "block_"]).drop("block_")
    plain = x.groupBy(*key).agg(*[v.alias(k) for k, v in _plain_sums().items()])

    near = ranges.neighbours(pairs.select("series_id", "k", "obs"), key, 1, 0, rows)
    before = F.lag("obs").over(Window.partitionBy("series_id", "block_").orderBy("k"))
    steps = near.withColumn("step", F.when(F.col("own_"), F.abs(F.col("obs") - before))).groupBy(*key).agg(F.avg(F.when(F.col("own_"), F.col("step"))).alias("step"))

    sides = {"o": F.col("obs"), "s": F.col("sim"), "e": F.col("e"), "a": F.abs("e")}
    values = x.select("series_id", F.inline(F.array(*[F.struct(F.lit(side).alias("side"), v.alias("value")) for side, v in sides.items()])))
    ranked = ranges.ranked_values(values, ["series_id", "side"], rows, write=True)
    places = sizes.withColumn("block_", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / rows))))
    placed_ = ranked.withColumn("block_", ranges.block_of("before", rows)).join(places, ["series_id", "block_"]).drop("block_")
    n, value, top, tail, log = F.col("n"), F.col("value"), *_ends(), _ln(F.col("value") + F.col("mo") * EPS)
    is_ = lambda side: F.col("side") == side
    in_tail = (F.col("before") < n - tail) & (F.col("side").isin("o", "s"))
    curve = {"low_n": F.sum(F.when(is_("o"), ranges.sum_of_places(F.lit(1), F.lit(0), n - tail))), "low_bad": F.max((in_tail & log.isNull()).cast("int"))}
    for side in ("o", "s"):
        curve |= {
            f"top_{side}": F.sum(F.when(is_(side), ranges.sum_of_places(value, n - top, n))), f"low_{side}": F.sum(F.when(is_(side), ranges.sum_of_places(log, F.lit(0), n - tail))),
            f"low_min_{side}": F.min(F.when(is_(side) & in_tail, log)),
        }
    for side, qs in QUANTILES.items():
        for i, q in enumerate(qs):
            h = (n - 1) * F.lit(q)
            curve |= {f"{side}{i}_{end}": F.max(F.when(is_(side), ranges.at_place(at, value))) for end, at in (("lo", F.floor(h)), ("hi", F.ceil(h)))}
    curves = placed_.groupBy(*key).agg(*[v.alias(k) for k, v in curve.items()])

    # Ranks: each pair meets its values' ranks. A value that many pairs have is one row, and the join may split its pairs.
    of = lambda side, c, name: ranked.where(is_(side)).select("series_id", F.col("value").alias(c), (F.col("before") + (F.col("c") + 1) / 2).alias(name))
    both = x.select("series_id", "obs", "sim", "n").join(of("o", "obs", "ro"), ["series_id", "obs"]).join(of("s", "sim", "rs"), ["series_id", "sim"])
    ranks = both.groupBy(*key).agg(*[v.alias(k) for k, v in _rank_sums().items()])

    # The curves' gap: both sides' values as shares of their sums, in one order.
    mean = F.when(is_("o"), F.col("mo")).otherwise(F.col("ms"))
    share = placed_.where(F.col("side").isin("o", "s")).select("series_id", F.try_divide("value", n * mean).alias("v"), F.when(is_("o"), F.col("c")).otherwise(-F.col("c")).alias("d"))
    share = share.groupBy("series_id", "v").agg(F.sum("d").alias("d"), F.count("v").alias("have"), F.count("*").alias("rows"))
    ranged = ranges.running(ranges.with_ranges(share, key, F.col("v"), rows), key, "range_", [F.col("v")], {"sum": F.col("d")})
    first = ranged.groupBy("series_id", "range_").agg(F.min("v").alias("first"))
    after = first.select("series_id", "range_", F.lead("first").over(Window.partitionBy(*key).orderBy("range_")).alias("after"))
    lead = F.coalesce(F.lead("v").over(Window.partitionBy("series_id", "range_").orderBy("v")), F.col("after"))
    gaps = ranged.join(after, ["series_id", "range_"]).withColumn("gap", F.abs("sum") * (lead - F.col("v")))
    l1 = gaps.groupBy(*key).agg(F.sum("gap").alias("l1"), F.sum("have").alias("have"), F.sum("rows").alias("rows"))
    l1 = l1.select("series_id", F.when(F.col("have") == F.col("rows"), F.coalesce("l1", F.lit(0.0))).alias("fdc_l1"))
    out = written(_with_quantiles(ranges.joined([plain, steps, curves, ranks], key)).join(l1, key), "sums")
    deleted(pairs, ranked)
    return out


def pair_counts(pairs: DataFrame) -> tuple[int, int]:
    """The pairs of the longest series, and of all."""
    longest, total = pairs.groupBy("series_id").agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n")).first()
    return longest or 0, total or 0


def curve_distance(x: DataFrame) -> DataFrame:
    """(series_id, fdc_l1): the sum of the gaps between both sides' sorted values, as shares of their sums. That is the area between
    the two distributions: both sides' values in one order, each step times how many more of one side lie below it."""
    share = lambda v, m: F.try_divide(F.col(v), F.col("n") * F.col(m))
    both = x.select("series_id", F.inline(F.array(F.struct(share("obs", "mo").alias("v"), F.lit(1).alias("d")), F.struct(share("sim", "ms").alias("v"), F.lit(-1).alias("d")))))
    w = Window.partitionBy("series_id").orderBy("v")
    gap = F.abs(F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0))) * (F.lead("v").over(w) - F.col("v"))
    g = both.select("series_id", "v", gap.alias("gap")).groupBy("series_id").agg(F.sum("gap").alias("l1"), F.count("v").alias("have"), F.count("*").alias("n"))
    return g.select("series_id", F.when(F.col("have") == F.col("n"), F.col("l1")).alias("fdc_l1"))


def flow_duration(pairs: DataFrame) -> DataFrame:
    """(series_id, i, o, s): both sides in falling order, side by side; i counts from 0."""
    by = lambda c: F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc(c))) - 1
    left = pairs.select("series_id", by("obs").alias("i"), F.col("obs").alias("o"))
    return left.join(pairs.select("series_id", by("sim").alias("i"), F.col("sim").alias("s")), ["series_id", "i"])


def _ln(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def wide_panel(pairs: DataFrame, long: int | None = LONG) -> DataFrame:
    """One row a series with a column for each classical metric, and kge parts (r, variability, bias) for the three KGEs. One job
    counts pairs: if a series has more than ``long``, series are spread over tasks (None: no job, no series is). Else whole series are
    dealt to tasks of about TASK pairs, so that more series make more tasks, not larger ones."""
    longest, total = (0, 0) if long is None else pair_counts(pairs)
    if long is not None and longest > long:
        joined = long_series_sums(pairs, min(long, ranges.RANGE))
    else:
        tasks = -(-total // TASK)
        x = placed(pairs.repartition(tasks, "series_id") if tasks > 1 else pairs)
        joined = series_sums(x).join(curve_distance(x), "series_id")
    return from_sums(joined, user_values())


def from_sums(joined: DataFrame, more: dict[str, Column]) -> DataFrame:
    """The panel from one row a series with the columns of ``series_sums`` and fdc_l1, and ``more`` metrics over the same row. A metric
    whose sums are NULL is NULL."""
    c = {n: F.col(n) for n in joined.columns}
    n, mo, ms, so, ss = c["n"], c["mo"], c["ms"], c["so"], c["ss"]
    eps = mo * EPS
    rmse, flat = F.sqrt(c["mse"]), c["min_o"] == c["max_o"]
    r = pearson(c["cov"], c["vo"], c["vs"], mo, ms, n)
    rank_mean = (n + 1) / 2
    spearman = pearson(c["rank_cov"], c["rank_vo"], c["rank_vs"], rank_mean, rank_mean, n)
    slope = over(c["cov"], c["vo"])
    beta, alpha, cv = over(ms, mo), over(ss, so), over(over(ss, ms), over(so, mo))
    shift = over(ms - mo, so)
    np_alpha = 1 - 0.5 * c["fdc_l1"]
    kge = lambda r, v, b: finite(1 - F.sqrt(_square(r - 1) + _square(v - 1) + _square(b)))
    one_less = lambda a, b: 1 - over(a, b)
    positive = c["min_any"] > 0
    no_zero = c["zero_o"] == 0
    slopes = [_ln(q + eps) for q in (c["qs"][0], c["qs"][1], c["qo"][2], c["qo"][3])]
    med_o = _ln(c["qo"][4] + eps)
    m = {
        "me": c["me"], "mae": c["mae"], "mdae": c["mdae"], "mse": c["mse"], "rmse": rmse, "rsr": over(rmse, so), "nrmse_mean": over(rmse, mo), "nrmse_range": over(rmse, c["max_o"] - c["min_o"]), "nrmse_iqr": over(rmse, c["qo"][1] - c["qo"][0]),
        "mape": F.when(no_zero, c["mape"]), "smape": c["smape"], "maape": F.when(c["zero_both"] == 0, c["maape"]), "mapd": over(100 * c["sae"], c["abs_o"]),
        "msle": F.when(positive, c["msle"]), "mle": F.when(positive, c["mle"]), "male": F.when(positive, c["male"]), "rmsle": F.when(positive, F.sqrt(c["msle"])), "mde": c["mde"], "mdse": c["mdse"], "mase": over(c["mae"], c["step"]),
        "r": r, "r2": r * r, "wr2": F.when(r.isNotNull(), F.when(F.abs(slope) <= 1, F.abs(slope) * r * r).otherwise(over(r * r, F.abs(slope)))), "spearman": spearman,
        "d": one_less(c["see"], c["reach2"]), "d1": one_less(c["sae"], c["reach1"]), "dr": F.when(c["sae"] <= 2 * c["dev_o"], one_less(c["sae"], 2 * c["dev_o"])).otherwise(over(2 * c["dev_o"], c["sae"]) - 1), "drel": F.when(no_zero, one_less(c["rel2"], c["reach_rel"])),
        "lm_index": F.when(~flat, one_less(c["sae"], c["dev_o"])), "nse": F.when(~flat, one_less(c["see"], c["vo"])), "nse_mod": F.when(~flat, one_less(c["sae"], c["dev_o"])), "nse_rel": F.when(no_zero & ~flat, one_less(c["rel2"], c["dev_rel"])), "lognse": F.when((c["log_bad"] == 0) & ~flat, one_less(c["log_see"], c["log_vo"])),
        "kge2009": kge(r, alpha, beta - 1), "kge2012": kge(r, cv, beta - 1), "kge2021": kge(r, alpha, shift), "kgenp": kge(spearman, np_alpha, beta - 1), "ve": one_less(c["sae"], c["sum_o"]), "pbias": over(-100 * c["me"] * n, c["sum_o"]), "beta_nse": shift, "alpha": alpha,
        "fhv": c["fhv"], "flv": c["flv"], "fms": over(100 * ((slopes[0] - slopes[1]) - (slopes[2] - slopes[3])), slopes[2] - slopes[3]), "fmm": over(100 * (_ln(c["qs"][2] + eps) - med_o), med_o),
    }
    parts = {"kge_r": r, "kge_alpha": alpha, "kge_beta": beta, "kge_gamma": cv, "kge_shift": shift}
    return joined.select("series_id", "n", *[finite(v).alias(k) for k, v in (m | more).items()], *[v.alias(k) for k, v in parts.items()])


def metric_ids(wide: DataFrame) -> list[str]:
    return [c for c in wide.columns if c not in ("series_id", "n") and not c.startswith("kge_")]


def to_long(wide: DataFrame, ids: list[str]) -> DataFrame:
    """(series_id, metric_id, value)"""
    return wide.unpivot(["series_id"], [F.col(i).cast("double").alias(i) for i in ids], "metric_id", "value")


def transformed(pairs: DataFrame, kind: str) -> DataFrame:
    """Both sides under log, sqrt or inverse, with eps = 0.01 * mean(obs). Series in which a value has no finite transform
    get NULL values throughout, as nothing is paired anew and no metric may skip the gap."""
    if kind == "none":
        return pairs
    w = Window.partitionBy("series_id")
    eps = F.avg("obs").over(w) * EPS
    f = {"log": lambda v: _ln(v + F.col("eps")), "sqrt": lambda v: F.when(v >= 0, F.sqrt(v)), "inverse": lambda v: F.try_divide(F.lit(1.0), v + F.col("eps"))}[kind]
    x = pairs.withColumn("eps", eps).withColumns({"obs": f(F.col("obs")), "sim": f(F.col("sim"))}).drop("eps")
    bad = F.max((F.col("obs").isNull() | F.col("sim").isNull()).cast("int")).over(w) == 1
    return x.withColumns({c: F.when(~bad, F.col(c)) for c in ("obs", "sim")})


def c2m(e: Column) -> Column:
    """The bounded form of an efficiency."""
    return over(e, 2 - e)


def benchmark(pairs: DataFrame, kind: str) -> DataFrame:
    """``pairs`` with sim replaced by a benchmark of obs: its mean, the value before, or its mean of the calendar month."""
    w = Window.partitionBy("series_id")
    if kind == "mean":
        b = F.avg("obs").over(w)
    elif kind == "persistence":
        b = F.lag("obs", 1).over(w.orderBy("k"))
        b = F.when(F.row_number().over(w.orderBy("k")) == 1, F.col("obs")).otherwise(b)
    elif kind == "climatology":
        b = F.coalesce(F.avg("obs").over(Window.partitionBy("series_id", F.month("ts"))), F.avg("obs").over(w))
    else:
        raise ValueError(f"no such benchmark: {kind}")
    return pairs.withColumn("sim", b)


def skill(model: Column, bench: Column, optimum: float = 1.0) -> Column:
    """1 for a perfect model, 0 for one no better than the benchmark."""
    return F.least(F.lit(1.0), over(model - bench, F.lit(optimum) - bench))
