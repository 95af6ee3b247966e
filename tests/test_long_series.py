"""Series cut into many pieces give what they give whole."""

import math
import random

import pytest
from pyspark.sql import functions as F

from freshet.operators import classical, frame, ranges, timing
from freshet.plans.config import TimingConfig

SCHEMA = "series_id string, k int, ts timestamp, obs double, sim double"


@pytest.fixture(scope="module")
def pairs(spark):
    r = random.Random(8)
    rows = []
    for name, n, levels in (("long", 700, 0), ("tied", 500, 4), ("short", 5, 0), ("one", 1, 0), ("flat", 60, 1), ("negative", 90, 0), (None, 40, 0)):
        level = 3.0
        for k in range(n):
            level = max(0.6, level + r.uniform(-1, 1)) if not levels else float(r.randrange(levels))
            sim = level + r.uniform(-0.5, 1.5) if not levels else float(r.randrange(levels))
            rows.append((name, k, None, -level if name == "negative" and k % 7 == 0 else level, sim))
    rows += [("zero", k, None, 0.0, 0.0) for k in range(30)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_seconds(F.col("k") * 86400))
    df = df.repartition(3).persist()
    yield df
    df.unpersist()


def table(df, *key):
    return {tuple(r[c] for c in key): {c: v for c, v in r.asDict().items() if c not in key} for r in df.collect()}


def same(a, b):
    assert a.keys() == b.keys() and a
    for k in a:
        for c in a[k]:
            u, v = a[k][c], b[k][c]
            assert u == v or (isinstance(u, float) and v is not None and math.isclose(u, v, rel_tol=1e-8, abs_tol=1e-9)), (k, c, u, v)


def test_classical_panel_by_ranges(pairs):
    named = pairs.where("series_id is not null")
    same(table(classical.wide_panel(named, long=None), "series_id"), table(classical.wide_panel(named, long=37), "series_id"))


def test_events_cut_at_any_place(pairs):
    named = pairs.where("series_id is not null")
    for distance in (1, 4):
        cfg = TimingConfig(min_distance=distance)
        level = timing.thresholds(named, cfg)
        whole = table(timing.events(named, level, cfg, rows=10_000), "series_id", "event_no")
        for rows in (1, 7, 50):
            same(whole, table(timing.events(named, level, cfg, rows=rows), "series_id", "event_no"))


def test_wasserstein_by_blocks(pairs):
    named = pairs.where("series_id is not null")
    for f in (timing.wasserstein1, timing.wasserstein2sq):
        same(table(f(named), "series_id"), table(f(named, rows=13), "series_id"))
    assert table(timing.wasserstein1(named), "series_id")[("negative",)] == {"w1": None}


def test_lag_sweep_by_blocks(pairs):
    some = pairs.where("series_id in ('long', 'short', 'one', 'flat', 'negative')")
    whole = table(timing.lag_sweep(some, -5, 4), "series_id", "lag")
    same(whole, table(timing.lag_sweep(some, -5, 4, rows=3), "series_id", "lag"))
    rows = sorted((r.k, r.obs, r.sim) for r in some.where("series_id = 'long'").collect())
    for lag in (-5, 0, 3):
        cut = [(rows[k][1], rows[k + lag][2]) for k in range(len(rows)) if 0 <= k + lag < len(rows)]
        mean = sum(o for o, _ in cut) / len(cut)
        nse = 1 - sum((s - o) ** 2 for o, s in cut) / sum((o - mean) ** 2 for o, _ in cut)
        po = ps = gap = 0.0
        for o, s in cut[:-1]:
            po, ps = po + o / sum(x for x, _ in cut), ps + s / sum(x for _, x in cut)
            gap += abs(po - ps)
        assert math.isclose(whole[("long", lag)]["nse"], nse, rel_tol=1e-9) and math.isclose(whole[("long", lag)]["w1"], gap, rel_tol=1e-7)


def test_running_sums_and_curve(pairs):
    same(table(frame.cumulative(pairs), "series_id", "k"), table(frame.cumulative(pairs, rows=17), "series_id", "k"))
    same(table(frame.exceedance(pairs), "series_id", "i"), table(frame.exceedance(pairs, rows=17), "series_id", "i"))
    sums = table(frame.cumulative(pairs, rows=11), "series_id", "k")
    total = 0.0
    for r in sorted(pairs.where("series_id is null").collect(), key=lambda r: r.k):
        total += r.obs
        assert math.isclose(sums[(None, r.k)]["y"], total, rel_tol=1e-9)
    curve = [r.q for r in frame.exceedance(pairs, rows=9).where("series_id = 'tied'").orderBy("i").collect()]
    assert curve == sorted((r.obs for r in pairs.where("series_id = 'tied'").collect()), reverse=True)


def test_places_and_ranges(spark):
    x = spark.range(1000).select(F.lit("a").alias("g"), (F.col("id") * 7919 % 1000 % 300).alias("v"))
    cut = ranges.with_ranges(x, ["g"], F.col("v"), 50)
    spans = cut.groupBy("range_").agg(F.min("v").alias("a"), F.max("v").alias("b"), F.count("*").alias("n")).orderBy("range_").collect()
    assert len(spans) > 10 and all(p.b < q.a for p, q in zip(spans, spans[1:])) and max(s.n for s in spans) < 200
    ranked = ranges.ranked_values(x.select("g", F.col("v").alias("value")), ["g"], 40).collect()
    values = sorted(r.v for r in x.collect())
    assert all(r.before == sum(v < r.value for v in values) and r.c == values.count(r.value) for r in ranked) and len(ranked) == 300
    k = [(r.v, r.k) for r in ranges.numbered(x, ["g"], F.col("v"), 40).collect()]
    assert sorted(k) == sorted((v, i) for i, v in enumerate(values))
    assert ranges.with_ranges(x.limit(0), ["g"], F.col("v")).count() == 0


def test_no_task_has_a_long_series_whole(spark, pairs, monkeypatch):
    """Joins of many rows with a row a series are made piece by piece, so that none is one task's."""
    largest = lambda df: df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    some, seen, write = pairs.where("series_id in ('long', 'tied')"), {}, ranges.written

    def watched(df, name):
        seen[name] = (largest(df), df.count())
        return write(df, name)

    monkeypatch.setattr(ranges, "written", watched)
    confs = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in confs}
    try:
        for k, v in confs.items():
            spark.conf.set(k, v)
        monkeypatch.setattr(ranges, "DEAL", 100, raising=False)
        cut = ranges.with_ranges(some, ["series_id"], F.col("obs"), 50)
        assert largest(cut) < 700
        classical.long_series_sums(some.where("series_id = 'long'"), 37)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert seen["counts"][0] < seen["counts"][1] / 2
    ranged = lambda df: sorted((r.series_id, r.k, r.range_) for r in df.collect())
    dealt = ranged(cut)
    monkeypatch.setattr(ranges, "DEAL", 10_000)
    assert dealt == ranged(ranges.with_ranges(some, ["series_id"], F.col("obs"), 50)) and len({r for *_, r in dealt}) > 5


def test_more_short_series_make_more_tasks(pairs, monkeypatch):
    """Short series are dealt by their pairs, so a task's share does not grow with their number."""
    many = pairs.where("series_id = 'negative'").withColumn("series_id", F.explode(F.split(F.lit("abcdefghijklmnopqrstuvwx"), "")))
    whole = table(classical.wide_panel(many), "series_id")
    monkeypatch.setattr(classical, "TASK", 90, raising=False)
    dealt = classical.wide_panel(many)
    shares = dealt.groupBy(F.spark_partition_id()).count().collect()
    assert len(shares) > 8 and max(r["count"] for r in shares) < 8
    same(whole, table(dealt, "series_id"))
