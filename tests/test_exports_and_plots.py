"""One-file exports, plot cells, block sums of replicates, timing summary."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from freshet.operators import bootstrap, classical, plots
from freshet.plans.config import EvalConfig, TimingConfig
from freshet.plans.panel import full_panel
from freshet.plans.registry import candidates, metric_registry
from freshet.sources import sinks

DAY = dt.datetime(2001, 1, 1)
SCHEMA = "series_id string, k int, ts timestamp, obs double, sim double"


@pytest.fixture(scope="module")
def pairs(spark):
    r, rows = random.Random(3), []
    for name, n, make in (("plain", 130, lambda: (r.uniform(1, 9), r.uniform(1, 9))), ("zeros", 50, lambda: (float(r.randrange(3)), float(r.randrange(3)))), ("flat", 40, lambda: (2.5, r.uniform(0, 1))), ("even", 30, lambda: (r.uniform(1, 2), 1.1)), ("two", 2, lambda: (r.uniform(1, 9), r.uniform(1, 9))), ("below", 60, lambda: (r.uniform(-4, 2), r.uniform(-3, 3)))):
        rows += [(name, k, DAY + dt.timedelta(days=k), *make()) for k in range(n)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.mark.parametrize("length", [None, 1, 7])
def test_block_sums_give_the_panels_of_the_replicates(spark, pairs, length):
    rows = bootstrap.replicates(pairs, 6, length, 5).withColumn("series_id", F.concat_ws("#", "series_id", "b")).drop("b")
    want = {tuple(x.series_id.split("#")): x for x in classical.wide_panel(rows, long=None).collect()}
    got = {(x.series_id, str(x.b)): x for x in bootstrap.additive_panel(pairs, 6, length, 5).collect()}
    assert got.keys() == want.keys() and len(got) == 36
    for key, x in got.items():
        for m in bootstrap.ADDITIVE:
            assert (x[m] is None) == (want[key][m] is None), (key, m, x[m], want[key][m])
            assert x[m] is None or x[m] == pytest.approx(want[key][m], rel=1e-9, abs=1e-9), (key, m)


def test_intervals_by_either_way(spark, pairs):
    ids = ["nse", "mae", "r"]
    of = lambda ids: {(x.series_id, x.metric_id): (x.lo, x.hi) for x in bootstrap.confidence_intervals(pairs, 25, ids=ids).where(F.col("metric_id").isin("nse", "mae", "r")).collect()}
    sums, whole = of(ids), of([*ids, "mdae"])
    assert sums.keys() == whole.keys() and sums[("plain", "nse")][0] < sums[("plain", "nse")][1]
    for k in sums:
        assert sums[k] == (pytest.approx(whole[k], rel=1e-9, abs=1e-9) if whole[k][0] is not None else (None, None))


def test_metrics_file(spark, tmp_path):
    metrics = spark.createDataFrame([("a", "nse", 0.125), ("b.1", "nse", None), ("a", "w1", 3.0), ("b.1", "rmse", 1e-7), ("=run", "nse", 1.0)], "series_id string, metric_id string, value double")
    ci = spark.createDataFrame([("a", "nse", 0.1, 0.2), ("a", "w1", 1.0, 2.0)], "series_id string, metric_id string, lo double, hi double")
    head = sinks.export_head("d", 3, "1d", "cfs", EvalConfig("zero", "log"), dt.datetime(2020, 1, 2))
    path, runs = str(tmp_path / "m.csv"), ["a", "b.1", "=run"]
    for _ in range(2):  # a second time over the first file
        sinks.write_metrics_file(metrics, metric_registry(spark), runs, path, head, ci)
    lines = open(path).read().splitlines()
    assert lines[:5] == head and head[3] == "# settings: nan=zero; transform=log; benchmark=mean" and [x for x in tmp_path.iterdir() if x.suffix != ".crc"] == [tmp_path / "m.csv"]
    assert lines[5] == "metric,group,optimum,a,a ci95_lo,a ci95_hi,b.1,b.1 ci95_lo,b.1 ci95_hi,'=run,'=run ci95_lo,'=run ci95_hi"
    assert [x.split(",")[0] for x in lines[6:]] == ["Root mean squared error", "Nash-Sutcliffe efficiency", "Wasserstein-1 of mass"]
    assert lines[7] == "Nash-Sutcliffe efficiency,Efficiencies,1,0.125,0.1,0.2,,,,1.0,," and lines[8].endswith(",3.0,,,,,,,,")
    back = {(x.series_id, x.metric): x[2:] for x in sinks.read_metrics_file(spark, path, ["a", "b.1"]).collect()}
    assert back[("a", "Nash-Sutcliffe efficiency")] == (0.125, 0.1, 0.2) and back[("b.1", "Root mean squared error")] == (1e-7, None, None)
    sinks.write_metrics_file(metrics.limit(0), metric_registry(spark), ["a"], path, head, sep="\t")
    assert open(path).read().splitlines()[5:] == ["metric\tgroup\toptimum\ta"]


def test_markdown_file_is_in_order(spark, tmp_path):
    df = spark.range(3000).select((F.col("id") * 7919 % 3000).alias("n"), F.when(F.col("id") % 2 == 0, "a|b\nc").alias("te|xt")).repartition(7)
    sinks.write_markdown_file(df, str(tmp_path / "t.md"), ["n"])
    lines = open(tmp_path / "t.md").read().splitlines()
    assert lines[:2] == ["| n | te\\|xt |", "| --- | --- |"] and [int(x.split(" ")[1]) for x in lines[2:]] == list(range(3000))
    assert {x.split(" | ", 1)[1] for x in lines[2:]} == {"a\\|b c |", "n/a |"}


def test_plot_cells(spark):
    d = lambda i: DAY + dt.timedelta(days=i)
    p = spark.createDataFrame([("s", d(0), 0.0, 10.0), ("s", d(1), 4.9, 5.0), ("s", d(2), 4.0, 5.5), ("s", d(400), None, 1.0), ("one", d(0), 0.0, 0.0), (None, d(0), 1.0, -1.0)], "series_id string, ts timestamp, obs double, sim double")
    whole = p.where("obs is not null")
    assert sorted((x.x, x.y, x.n, x.obs) for x in plots.scatter_cells(whole, 2).where("series_id = 's'").collect()) == [(0, 1, 3, pytest.approx(8.9 / 3))]
    assert [tuple(x[1:4]) for x in plots.scatter_cells(whole, 4).where("series_id is null or series_id = 'one'").orderBy("series_id").collect()] == [(3, 0, 1), (0, 0, 1)]
    heat = {(x.year, x["column"]): (x.n, x.value) for x in plots.heat_cells(p, 183).where("series_id = 's'").collect()}
    assert heat == {(2001, 0): (2, 2.45), (2001, 1): (1, 4.0), (2002, 17): (0, None)}
    trace = {x["column"]: tuple(x[2:]) for x in plots.trace_cells(p, 2, "sim").where("series_id = 's'").collect()}
    assert trace == {0: (3, 10.0, 5.5, 5.0, 10.0), 1: (1, 1.0, 1.0, 1.0, 1.0)}
    assert plots.scatter_cells(whole.limit(0)).count() == plots.heat_cells(p.limit(0)).count() == plots.trace_cells(p.limit(0)).count() == 0


def test_summary_candidates_and_an_empty_cache(spark, pairs):
    known = metric_registry(spark)
    assert [(x.metric_id, x.weight) for x in candidates(known).orderBy("ordinal").collect()] == [("rmse", 0.0), ("r2", 0.0), ("nse", 1.0), ("kge2009", 1.0), ("ve", 0.0), ("pbias", 0.0), ("peak_lag_abs", 1.0), ("de", 0.0), ("dtw_warp", 0.0), ("w1", 1.0), ("xwt_lag", 0.0)]
    long = full_panel(pairs.where("series_id = 'plain'"), TimingConfig())
    values = {x.metric_id: x.value for x in long.collect()}
    assert len(values) == 63 and spark._jsparkSession.sharedState().cacheManager().isEmpty()
    table = sinks.timing_summary(long, known, ["plain", "none"]).orderBy("ordinal").collect()
    assert len(table) == 13 and all(x.none is None for x in table)
    w1 = next(x for x in table if x.metric_id == "w1")
    assert (w1.optimum, float(w1.plain)) == (0, pytest.approx(values["w1"], abs=0.006))
