"""Moving-block bootstrap of the classical metrics.

Any draw of the generator can be had on its own, so replicates are rows: each block's start comes from its draw number. Metrics that are
made of sums and extremes need a row a block: a table has those of the block at each place of the series, around the circle, and a
replicate adds up the rows of its blocks. Metrics that need ranks or quantiles, or the replicate's own mean within an absolute value, take
the pairs themselves: blocks are joined to them by position, and (series, replicate) is the series of one large panel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import uniform_draw
from .classical import from_sums, metric_ids, to_long, transformed, wide_panel

#: Metrics of sums and extremes of the pairs alone.
ADDITIVE = (
    "me", "mae", "mse", "rmse", "rsr", "nrmse_mean", "nrmse_range", "mape", "smape", "maape", "mapd", "msle", "mle", "male", "rmsle",
    "r", "r2", "wr2", "nse", "nse_rel", "kge2009", "kge2012", "kge2021", "ve", "pbias", "beta_nse", "alpha",
)


def block_length(n: Column) -> Column:
    return F.greatest(F.lit(3), F.floor(F.cbrt(n.cast("double")) + 0.5)).cast("long")


def _starts(sizes: DataFrame, b: int, length: int | None, seed: int) -> DataFrame:
    """(series_id, n, len, blocks, b, block, start): where each block of each replicate starts, from (series_id, n)."""
    x = sizes.withColumn("len", F.lit(length).cast("long") if length else block_length(F.col("n"))).withColumn("blocks", F.ceil(F.col("n") / F.col("len")))
    # Few rows until here: they are dealt to as many tasks as a shuffle has, as each makes all blocks of a replicate.
    tasks = int(x.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = x.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(b - 1)))).repartition(tasks, "series_id", "b")
    x = x.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    start = F.floor(uniform_draw(F.col("b") * F.col("blocks") + F.col("block"), seed) * F.col("n"))
    # Never NULL, or a join on it would repeat the generator's whole expression in a filter.
    return x.withColumn("start", F.coalesce(start, F.lit(0).cast("long")))


def replicates(pairs: DataFrame, b: int = 500, length: int | None = None, seed: int = 12345) -> DataFrame:
    """(series_id, b, k, ts, obs, sim): b circular resamples of each series in blocks."""
    x = _starts(pairs.groupBy("series_id").agg(F.count("*").alias("n")), b, length, seed)
    x = x.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("len") - 1))).withColumn("to_k", F.col("block") * F.col("len") + F.col("j")).where("to_k < n")
    x = x.select("series_id", "b", "to_k", ((F.col("start") + F.col("j")) % F.col("n")).alias("k"))
    return x.join(pairs.select("series_id", F.col("k").cast("long").alias("k"), "ts", "obs", "sim"), ["series_id", "k"]).select("series_id", "b", F.col("to_k").alias("k"), "ts", "obs", "sim")


def _parts() -> tuple[dict[str, Column], dict[str, Column], dict[str, Column]]:
    """What a pair adds to sums, least values and largest values; o and s are taken from the series' means mo and ms, so that squares
    lose no digits."""
    o, s = F.col("obs"), F.col("sim")
    e, a, b = s - o, o - F.col("mo"), s - F.col("ms")
    ratio, rel = F.when((o > 0) & (s > 0), F.ln(F.try_divide(s, o))), F.abs(F.try_divide(e, o))
    sums = {
        "rows": F.lit(1), "a": a, "c": b, "aa": a * a, "bb": b * b, "ab": a * b, "see": e * e, "sae": F.abs(e), "abs_o": F.abs(o), "ratio": ratio, "ratio_abs": F.abs(ratio), "ratio2": ratio * ratio, "rel": rel, "rel2": rel * rel,
        "smape": F.coalesce(F.try_divide(F.abs(e), (F.abs(o) + F.abs(s)) / 2), F.lit(0.0)), "maape": F.when(o == 0, F.pi() / 2).otherwise(F.atan(rel)),
    }
    low = {"min_o": o, "min_s": s, "min_any": F.least(o, s)}
    high = {"max_o": o, "max_s": s, "zero_o": (o == 0).cast("int"), "zero_both": ((o == 0) & (s == 0)).cast("int")}
    return sums, low, high


def block_table(pairs: DataFrame, length: int | None = None) -> DataFrame:
    """(series_id, start, and for each part its value over the whole block from there, and t_... over the shorter last block of a
    replicate). A pair is part of as many blocks as one has places, so this has n rows a series from n * length."""
    means = pairs.groupBy("series_id").agg(F.count("*").alias("n"), F.avg("obs").alias("mo"), F.avg("sim").alias("ms"))
    means = means.withColumn("len", F.lit(length).cast("long") if length else block_length(F.col("n"))).withColumn("rest", F.col("n") - (F.ceil(F.col("n") / F.col("len")) - 1) * F.col("len"))
    sums, low, high = _parts()
    x = pairs.join(means, "series_id")
    x = x.select("series_id", F.col("k").cast("long").alias("k"), "n", "rest", "len", *[v.alias(k) for k, v in (sums | low | high).items()])
    x = x.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("len") - 1))).withColumn("start", F.pmod(F.col("k") - F.col("j"), F.col("n")))
    tail = lambda k: F.when(F.col("j") < F.col("rest"), F.col(k))
    made = [f(of(k)).alias(name + k) for names, f in ((sums, F.sum), (low, F.min), (high, F.max)) for k in names for name, of in (("", F.col), ("t_", tail))]
    return x.groupBy("series_id", "start").agg(*made)


def additive_panel(pairs: DataFrame, b: int = 500, length: int | None = None, seed: int = 12345) -> DataFrame:
    """The panel of each replicate, ADDITIVE metrics only: (series_id, b, metrics). A row a block, not a row a pair, is moved."""
    sizes = pairs.groupBy("series_id").agg(F.count("*").alias("n"), F.avg("obs").alias("mo"), F.avg("sim").alias("ms"))
    sums, low, high = _parts()
    last = F.col("block") == F.col("blocks") - 1
    x = _starts(sizes.select("series_id", "n"), b, length, seed).join(block_table(pairs, length), ["series_id", "start"])
    kinds = ((sums, F.sum), (low, F.min), (high, F.max))
    g = x.groupBy("series_id", "b").agg(*[f(F.when(last, F.col(f"t_{k}")).otherwise(F.col(k))).alias(k) for names, f in kinds for k in names])
    g = g.join(sizes.select("series_id", F.col("mo").alias("o0"), F.col("ms").alias("s0")), "series_id")
    n = F.col("rows")
    of = lambda k: F.col(k) / n
    flat_o, flat_s = F.col("min_o") == F.col("max_o"), F.col("min_s") == F.col("max_s")
    spread = lambda sq, k, flat: F.when(flat, 0.0).otherwise(F.greatest(F.lit(0.0), F.col(sq) - F.col(k) * F.col(k) / n))
    g = g.withColumns({
        "n": n, "mo": F.when(flat_o, F.col("min_o")).otherwise(F.col("o0") + of("a")), "ms": F.when(flat_s, F.col("min_s")).otherwise(F.col("s0") + of("c")), "vo": spread("aa", "a", flat_o), "vs": spread("bb", "c", flat_s),
        "cov": F.when(flat_o | flat_s, 0.0).otherwise(F.col("ab") - F.col("a") * F.col("c") / n),
    })
    values = {k: F.col(k) for k in ("n", "mo", "ms", "vo", "vs", "cov", "min_o", "max_o", "min_any", "zero_o", "zero_both", "see", "sae", "abs_o", "rel2")}
    values |= {"so": F.sqrt(F.col("vo") / n), "ss": F.sqrt(F.col("vs") / n), "me": F.col("ms") - F.col("mo"), "mae": of("sae"), "mse": of("see"), "sum_o": n * F.col("mo"), "dev_rel": F.try_divide("vo", F.col("mo") * F.col("mo"))}
    values |= {"mle": of("ratio"), "male": of("ratio_abs"), "msle": of("ratio2"), "mape": 100 * of("rel"), "smape": 100 * of("smape"), "maape": of("maape")}
    none = {k: F.lit(None).cast("double") for k in ("mde", "mdae", "mdse", "fhv", "flv", "fdc_l1", "step", "reach2", "reach1", "reach_rel", "dev_o", "rank_cov", "rank_vo", "rank_vs", "log_see", "log_vo", "log_bad")}
    none |= {k: F.lit(None).cast("array<double>") for k in ("qo", "qs")}
    named = g.select(F.struct("series_id", "b").alias("series_id"), *[v.alias(k) for k, v in (values | none).items()])
    return from_sums(named, {}).select("series_id.*", *ADDITIVE)


def confidence_intervals(pairs: DataFrame, b: int = 500, length: int | None = None, alpha: float = 0.05, seed: int = 12345, transform: str = "none", ids: list[str] | None = None) -> DataFrame:
    """(series_id, metric_id, lo, hi): percentile intervals; none if under 80 % of the replicates, or under 20, have the metric. Where
    all ``ids`` are ADDITIVE and there is no transform (which knows the replicate's mean), no replicate's pairs are made."""
    if ids and transform == "none" and set(ids) <= set(ADDITIVE):
        long = to_long(additive_panel(pairs, b, length, seed), list(ids))
    else:
        r = replicates(pairs, b, length, seed).withColumn("series_id", F.concat_ws("\x1f", "series_id", "b")).drop("b")
        wide = wide_panel(transformed(r, transform), long=None)
        long = to_long(wide, ids or metric_ids(wide)).withColumn("series_id", F.element_at(F.split("series_id", "\x1f"), 1))
    q = F.percentile("value", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    g = long.groupBy("series_id", "metric_id").agg(q.alias("q"), F.count("value").alias("have"))
    ok = (F.col("have") >= 0.8 * b) & (F.col("have") >= 20)
    return g.select("series_id", "metric_id", F.when(ok, F.col("q")[0]).alias("lo"), F.when(ok, F.col("q")[1]).alias("hi"))
