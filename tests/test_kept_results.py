"""Metrics of a user's own, kept results, data sets in the catalogue, grids of perturbations."""

import datetime as dt
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from freshet.operators import bootstrap, classical, ranking, sandbox
from freshet.plans import stored
from freshet.plans.config import EvalConfig, Perturbation, TimingConfig
from freshet.plans.panel import evaluate
from freshet.plans.registry import UserMetric, metric_registry, register_metric, rows, user_metrics
from freshet.sources.datasets import DataSets

DAY = dt.datetime(2001, 1, 1)
SERIES = "series_id string, ts timestamp, obs double, sim double"


def series_of(spark, values):
    return spark.createDataFrame([(n, DAY + dt.timedelta(days=i), o, s) for n, (a, b) in values.items() for i, (o, s) in enumerate(zip(a, b))], SERIES)


def pairs_of(spark, values):
    return series_of(spark, values).withColumn("k", F.datediff("ts", F.lit("2001-01-01"))).select("series_id", "k", "ts", "obs", "sim")


@pytest.fixture(scope="module")
def three():
    r = np.random.default_rng(11)
    obs = (5 + 3 * np.sin(np.arange(300) / 20) + r.gamma(2, 1, 300)).round(3).tolist()
    return {n: (obs, [round(float(x * f + d), 3) for x, d in zip(obs, r.normal(0, 1, 300))]) for n, f in (("a", 1.0), ("b", 1.2), ("c", 0.7))}


HIT = UserMetric("hit", "Share of pairs within 1", lambda: {"in": F.sum((F.abs("e") <= 1).cast("int")), "n": F.count("*")}, lambda c: c["in"] / c["n"], 1, "max")


def test_user_metric_in_panel_ranking_and_bootstrap(spark, three):
    p = pairs_of(spark, three)
    want = {n: np.mean(np.abs(np.subtract(s, o)) <= 1) for n, (o, s) in three.items()}
    with user_metrics(HIT):
        short, long = (classical.wide_panel(p, long=x) for x in (None, 50))
        assert "hit" in classical.metric_ids(short)
        for got in (short, long):
            assert {r.series_id: r.hit for r in got.collect()} == pytest.approx(want)
        metrics = classical.to_long(short, ["hit"]).select(F.lit("x").alias("dataset_id"), F.col("series_id").alias("run"), "metric_id", "value")
        first = ranking.ranked(ranking.scored(metrics, metric_registry(spark)), {"hit": 1.0}).where("rank = 1").collect()[0]
        ci = {r.series_id: r for r in bootstrap.confidence_intervals(p, b=40, ids=["hit"]).collect()}
    assert first.run == max(want, key=want.get) and first.composite == 1.0
    assert all(r.metric_id == "hit" and r.lo <= want[n] <= r.hi for n, r in ci.items()) and len(ci) == 3
    assert "hit" not in classical.wide_panel(p).columns and all(r[1] != "hit" for r in rows())


@pytest.mark.parametrize("change", [{"metric_id": "nse"}, {"metric_id": "kge_x"}, {"direction": "up"}, {"digits": 9}])
def test_user_metrics_that_are_refused(change):
    with pytest.raises(ValueError):
        register_metric(UserMetric(**({"metric_id": "m", "label": "m", "sums": dict, "finish": lambda c: c} | change)))


def test_only_stale_series_are_made_anew(spark, three, tmp_path):
    path, cfg = str(tmp_path / "results"), EvalConfig()
    hundred = {f"s{i}": (o, [x + i for x in s]) for i, (o, s) in ((i, three["abc"[i % 3]]) for i in range(12))}
    base = series_of(spark, hundred | {"empty": ([None, None], [1.0, None])})
    as_rows = lambda df: {(r.series_id, r.metric_id): r.value for r in df.collect()}
    assert as_rows(stored.evaluate_stored(base, path)) == pytest.approx(as_rows(evaluate(base, cfg, heavy=False)), nan_ok=True)
    assert stored.stale(base.repartition(3), path).isEmpty()  # neither order nor the series without pairs
    changed = base.withColumn("sim", F.when((F.col("series_id") == "s7") & (F.dayofyear("ts") == 40), F.col("sim") + 1).otherwise(F.col("sim")))
    assert [r.series_id for r in stored.stale(changed, path).collect()] == ["s7"]
    written = {f for _, _, fs in os.walk(path) for f in fs}
    assert as_rows(stored.evaluate_stored(changed, path)) == pytest.approx(as_rows(evaluate(changed, cfg, heavy=False)), nan_ok=True)
    new = [os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f not in written and f.endswith(".parquet")]
    assert {r.content for r in spark.read.parquet(*new).select("content").distinct().collect()} == {r.content for r in stored.contents(changed).where("series_id = 's7'").collect()}
    assert stored.stale(base, path).isEmpty()  # going back costs nothing
    # Other settings, and a registered metric, are other results.
    assert stored.stale(base, path, EvalConfig(transform="sqrt")).count() == 13
    with user_metrics(HIT):
        assert stored.stale(base, path).count() == 13
        one = base.where("series_id = 's0'")
        assert ("s0", "hit") in as_rows(stored.evaluate_stored(one, path))
    assert stored.evaluate_stored(base.limit(0), path).count() == 0


def test_evaluation_reads_written_series(spark, three, tmp_path, monkeypatch):
    """A series that is costly to make is not made again by each job of an evaluation, nor by those that read the result."""
    base, seen = str(tmp_path / "given"), []
    series_of(spark, three).write.parquet(base)
    monkeypatch.setattr(stored, "evaluate", lambda s, *a: seen.extend(s.inputFiles()) or evaluate(s, *a))
    out = stored.evaluate_stored(spark.read.parquet(base), str(tmp_path / "results"))
    assert seen and not any("/given/" in f for f in [*seen, *out.inputFiles()])
    assert out.select("series_id").distinct().count() == 3


def test_contents_tell_series_apart(spark):
    a = [(None, DAY, 1.0, None), ("x", DAY, 1.0, None), ("y", DAY, None, 1.0), ("z", DAY, 1.0, None), ("z", DAY, 1.0, None), ("w", None, 1.0, None)]
    got = stored.contents(spark.createDataFrame(a, SERIES)).collect()
    assert len(got) == 5 and len({r.content for r in got}) == 5


def test_data_sets_in_the_catalogue(spark, three, tmp_path):
    d = DataSets(spark, "freshet_test", str(tmp_path / "sets"))
    base = series_of(spark, three | {"gaps": ([None, 1.0, None], [2.0, None, 3.0])})
    rows = lambda df: sorted(map(str, df.collect()))
    d.save("it's", base)
    copy = d.duplicate("it's", "copy")
    assert copy.files == d.version("it's").files and copy.parent == "it's@1" and rows(d.read("copy")) == rows(base)
    d.save("copy", d.read("copy").withColumn("sim", F.lit(0.0)))
    assert rows(d.read("it's")) == rows(base) == rows(d.read("copy", 1)) and d.read("copy").agg(F.max("sim")).collect()[0][0] == 0
    runs = DataSets(spark, "freshet_test", str(tmp_path / "sets"))  # another object sees the same
    runs.save("three", series_of(spark, three))
    months = runs.commit("months", "three", to="month")
    assert (months.step_ms, months.monthly, months.parent) == (30 * 86_400_000, True, "three@1") and d.version("three").step_ms == 86_400_000
    d.activate("copy")
    assert runs.active() == "copy" and d.names() == ["copy", "it's", "months", "three"] and [v.version for v in d.versions("copy")] == [1, 2]
    shared = d.version("it's").files
    d.remove("it's")
    assert os.path.exists(shared) and rows(d.read("copy", 1)) == rows(base)
    d.remove("copy")
    assert not os.path.exists(shared) and d.active() is None and d.names() == ["months", "three"]
    before = sorted(os.listdir(tmp_path / "sets"))
    for wrong, error in ((lambda: d.read("none"), KeyError), (lambda: d.commit("x", "three"), ValueError), (lambda: d.commit("x", "three", season=(1, 1)), ValueError), (lambda: d.duplicate("three", "months"), ValueError), (lambda: d.save("x", base.limit(0)), ValueError)):
        with pytest.raises(error):
            wrong()
    assert sorted(os.listdir(tmp_path / "sets")) == before and d.names() == ["months", "three"]
    for name in d.names():
        d.remove(name)
    spark.sql("DROP DATABASE freshet_test")


def test_grid_equals_single_perturbations_and_lags_come_back(spark):
    """Peaks are looked for within the tolerance, which must hold the largest shift."""
    t = np.arange(500)
    obs = (2 + sum(10 * np.exp(-((t - c) ** 2) / (2 * 6**2)) for c in (90, 210, 330, 420))).round(6).tolist()
    p = pairs_of(spark, {"one": (obs, obs), "two": (obs, [x * 1.5 for x in obs])})
    settings = {
        "late": Perturbation(shift=3), "early": Perturbation(shift=-5, scale=1.3), "plain": Perturbation(offset=2.0, dampen=0.5),
        "noisy": Perturbation(noise=0.5, seed=5), "normal": Perturbation(shift=2, noise=0.5, noise_kind="gaussian", seed=6),
    }
    got = {(r.series_id, r.k): r.sim for r in sandbox.grid(p, settings).collect()}
    for name, s in settings.items():
        for r in sandbox.perturbed(p, s).collect():
            assert got[name + sandbox.MARK + r.series_id, r.k] == pytest.approx(r.sim, abs=1e-12), (name, r)
    assert len(got) == 5 * 2 * 500
    found = {(r.series_id, r.setting, r.metric_id): r for r in sandbox.compared(p, {k: settings[k] for k in ("late", "early")}, TimingConfig(tolerance=6), synthetic=True).collect()}
    assert len(found) == 2 * 3 * 11
    for (_, setting, metric), r in found.items():
        shift = {"base": 0, "late": 3, "early": -5}[setting]
        if metric in ("lag_best", "peak_lag_abs"):
            assert r.value == r.injected == (abs(shift) if metric == "peak_lag_abs" else shift)
        elif metric == "xwt_lag":
            assert r.value == pytest.approx(r.injected, abs=0.5)
        else:
            assert r.injected is None
    assert found["one", "base", "nse"].value == 1.0 and found["one", "late", "nse"].value < 1
