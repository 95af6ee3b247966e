"""Matching observed with simulated events, as running counts, equi-joins and folds over small clusters.

Events of a side are apart and in order, so those that an observed event overlaps have consecutive numbers, first to last,
and both only grow from event to event. Observed events whose numbers overlap form a cluster; an event can take another's
match only within its cluster, so a match is a fold over a cluster's few events, never over a series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.config import TimingConfig

KEYS = ["series_id", "event_no"]


def overlapping(seen: DataFrame, made: DataFrame, tolerance: int) -> DataFrame:
    """``seen`` (series_id, event_no, start_k, end_k, ...) with first and last, the numbers of the events of ``made`` that each overlaps
    within the tolerance (first > last: none), and its cluster."""
    count = Window.partitionBy("series_id").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, 0)

    def running(points: DataFrame, asks: Column, ends: bool, name: str) -> DataFrame:
        """For each event of ``seen``, how many of ``points`` lie before its place (``ends``) or up to it."""
        one = points.select("series_id", F.col("at").cast("long").alias("at"), F.lit(1 if ends else 0).alias("asks"), F.lit(None).cast("long").alias("event_no"))
        all_ = one.unionByName(seen.select("series_id", asks.cast("long").alias("at"), F.lit(0 if ends else 1).alias("asks"), F.col("event_no").cast("long").alias("event_no")))
        counted = all_.withColumn(name, F.count_if(F.col("event_no").isNull()).over(count))
        return counted.where("event_no is not null").select(*KEYS, name)

    before = running(made.select("series_id", F.col("end_k").alias("at")), F.col("start_k") - tolerance, True, "first")
    until = running(made.select("series_id", F.col("start_k").alias("at")), F.col("end_k") + tolerance, False, "until")
    x = seen.join(before, KEYS).join(until, KEYS).withColumn("last", F.col("until") - 1).drop("until")
    w = Window.partitionBy("series_id").orderBy("event_no")
    apart = (F.col("first") > F.coalesce(F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))).cast("int")
    return x.withColumn("cluster", F.sum(apart).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def _totals(seen: DataFrame, made: DataFrame, hits: DataFrame) -> DataFrame:
    """(series_id, hits, misses, false_alarms, score) of every series with an event."""
    count = lambda df, name: df.groupBy("series_id").agg(F.count("*").alias(name))
    x = count(seen, "a").join(count(made, "b"), "series_id", "full").join(hits, "series_id", "left").na.fill(0, ["a", "b", "hits"])
    hit = F.col("hits")
    return x.select("series_id", hit.cast("long").alias("hits"), (F.col("a") - hit).cast("long").alias("misses"), (F.col("b") - hit).cast("long").alias("false_alarms"), F.try_divide(hit, F.col("a") + F.col("b") - hit).alias("score"))


def event_threat(seen: DataFrame, made: DataFrame, tolerance: int) -> DataFrame:
    """hits, misses, false alarms and threat score of each series: each observed event takes the first free simulated one that it
    overlaps, in order."""
    x = overlapping(seen, made, tolerance).where("first <= last")
    of = x.groupBy("series_id", "cluster").agg(F.array_sort(F.collect_list(F.struct("event_no", "first", "last"))).alias("asks"))

    def take(state: Column, ask: Column) -> Column:
        mine = F.greatest(ask["first"], state["taken"] + 1)
        fits = mine <= ask["last"]
        return F.struct(F.when(fits, mine).otherwise(state["taken"]).alias("taken"), (state["hits"] + fits.cast("long")).alias("hits"))

    start = F.struct(F.lit(-1).cast("long").alias("taken"), F.lit(0).cast("long").alias("hits"))
    hits = of.select("series_id", F.aggregate("asks", start, take)["hits"].alias("hits")).groupBy("series_id").agg(F.sum("hits").alias("hits"))
    return _totals(seen, made, hits).withColumnRenamed("score", "event_threat")


def nearest_matches(seen: DataFrame, made: DataFrame, tolerance: int) -> DataFrame:
    """(series_id, event_no, other): each observed event takes, in order, the free simulated one of those it overlaps whose peak is
    nearest, the earlier of equals."""
    x = overlapping(seen, made, tolerance).where("first <= last")
    asks = x.select("series_id", "cluster", "event_no", "peak_k", F.explode(F.sequence("first", "last")).alias("other"))
    peaks = made.select("series_id", F.col("event_no").cast("long").alias("other"), F.col("peak_k").alias("other_peak"))
    near = asks.join(peaks, ["series_id", "other"]).select("series_id", "cluster", "event_no", F.struct(F.abs(F.col("other_peak") - F.col("peak_k")).cast("long").alias("gap"), "other").alias("choice"))
    each = near.groupBy("series_id", "cluster", "event_no").agg(F.array_sort(F.collect_list("choice")).alias("choices"))
    of = each.groupBy("series_id", "cluster").agg(F.array_sort(F.collect_list(F.struct(F.col("event_no").cast("long").alias("event_no"), "choices"))).alias("asks"))
    kind = "array<struct<event_no: bigint, other: bigint>>"

    def take(done: Column, ask: Column) -> Column:
        free = F.filter(ask["choices"], lambda c: ~F.exists(done, lambda d: d["other"] == c["other"]))
        return F.when(F.size(free) > 0, F.concat(done, F.array(F.struct(ask["event_no"].alias("event_no"), F.get(free, F.lit(0))["other"].alias("other"))))).otherwise(done)

    done = of.select("series_id", F.explode(F.aggregate("asks", F.array().cast(kind), take)).alias("m"))
    return done.select("series_id", "m.event_no", "m.other")


def series_distance(pairs: DataFrame, seen: DataFrame, made: DataFrame, cfg: TimingConfig, points: int = 20) -> DataFrame:
    """sd_occ, sd_amp, sd_time, sd_abs_time: matched events compared at equal relative places of rise and recession."""
    matches = nearest_matches(seen, made, cfg.tolerance)
    other = made.select("series_id", F.col("event_no").cast("long").alias("other"), *[F.col(f"{c}_k").alias(f"{c}_s") for c in ("start", "peak", "end")])
    both = matches.join(seen.select("series_id", F.col("event_no").cast("long").alias("event_no"), "start_k", "peak_k", "end_k"), KEYS).join(other, ["series_id", "other"])
    limb = lambda a, b: F.struct(*[F.col(c).cast("double").alias(n) for c, n in ((f"{a}_k", "x0"), (f"{b}_k", "x1"), (f"{a}_s", "y0"), (f"{b}_s", "y1"))])
    limbs = both.select(*KEYS, F.posexplode(F.array(limb("start", "peak"), limb("peak", "end"))).alias("limb", "l")).withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(points)))).withColumn("u", F.col("place") / F.lit(float(points)))
    t, v = F.col("l.x0") + F.col("u") * (F.col("l.x1") - F.col("l.x0")), F.col("l.y0") + F.col("u") * (F.col("l.y1") - F.col("l.y0"))
    at = limbs.select("series_id", t.alias("t"), v.alias("v"), F.floor(t).alias("k"), F.floor(v).alias("j"))
    w = Window.partitionBy("series_id").orderBy("k")
    known = lambda c, k, name: pairs.select("series_id", F.col("k").cast("long").alias(k), F.col(c).alias(name), F.lead(c).over(w).alias(f"{name}_next"))
    x = at.join(known("obs", "k", "o"), ["series_id", "k"]).join(known("sim", "j", "s"), ["series_id", "j"])
    value = lambda c, place, k: F.col(c) + F.when(F.col(place) > F.col(k), (F.col(f"{c}_next") - F.col(c)) * (F.col(place) - F.col(k))).otherwise(0.0)
    q, r = value("o", "t", "k"), value("s", "v", "j")
    g = x.groupBy("series_id").agg(F.avg(F.when(q != 0, 100 * (r - q) / q)).alias("sd_amp"), F.avg(F.col("v") - F.col("t")).alias("sd_time"), F.avg(F.abs(F.col("v") - F.col("t"))).alias("sd_abs_time"))
    hits = matches.groupBy("series_id").agg(F.count("*").alias("hits"))
    return pairs.select("series_id").distinct().join(_totals(seen, made, hits), "series_id", "left").join(g, "series_id", "left").select("series_id", F.col("score").alias("sd_occ"), "sd_amp", "sd_time", "sd_abs_time")
