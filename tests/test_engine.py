"""The evaluation engine against numpy, hand-made cases and identities."""

import itertools
import math
import zipfile

import golden
import numpy as np
import pytest
from pyspark.sql import functions as F

from freshet.functions import cells
from freshet.functions.stats import normal_draws, uniform_draw
from freshet.operators import bootstrap, classical, frame, matching, ranking, sandbox, shape, timing, units
from freshet.plans.config import Perturbation, TimingConfig
from freshet.plans.panel import full_panel
from freshet.plans.registry import metric_registry, rows
from freshet.sources import sinks, tables

PAIRS = "series_id string, k int, ts timestamp, obs double, sim double"


def pairs_of(spark, series):
    import datetime as dt

    day = dt.datetime(2001, 1, 1)
    return spark.createDataFrame([(n, i, day + dt.timedelta(days=i), float(o), float(s)) for n, (a, b) in series.items() for i, (o, s) in enumerate(zip(a, b))], PAIRS)


def pulses(shift, n=400):
    t = np.arange(n)
    f = lambda t: sum(10 * np.exp(-((t - c) ** 2) / (2 * 8**2)) for c in (80, 200, 320))
    o, s = f(t), f(t - shift)
    return np.where(o < 1e-6, 0, o), np.where(s < 1e-6, 0, s)


@pytest.fixture(scope="module")
def noisy():
    r = np.random.default_rng(7)
    o = np.maximum(0.05, 5 + 3 * np.sin(np.arange(365) / 20) + r.normal(0, 0.5, 365)).round(3)
    return {"a": (o, (o * 1.2 + r.normal(0, 0.4, 365)).clip(0.05).round(3)), "b": (o, np.roll(o, 3)), "c": (o, (o * 0.8 + 1).round(1))}


def test_classical_metrics_match_numpy(spark, noisy):
    got = {r.series_id: r for r in classical.wide_panel(pairs_of(spark, noisy)).collect()}
    for name, (o, s) in noisy.items():
        for m, v in golden.classical(np.asarray(o), np.asarray(s)).items():
            assert got[name][m] == pytest.approx(v, rel=1e-8, abs=1e-10), (name, m)


def test_identical_series_reach_every_optimum(spark):
    o = np.random.default_rng(4).gamma(2, 3, 120).round(2) + 0.1
    got = {r.metric_id: r.value for r in full_panel(pairs_of(spark, {"a": (o, o)}), TimingConfig()).collect()}
    best = {r[1]: r[4] for r in rows()}
    assert set(got) == set(best) and len(best) == 63
    for m, v in got.items():
        if v is not None:
            assert v == pytest.approx(best[m], abs=1e-9), m


@pytest.mark.parametrize("o,s", [([1, 1, 1, 1, 1], [1, 2, 3, 4, 5]), ([0, 0, 0, 0], [0, 0, 0, 0]), ([-1, 0, 1, 2], [1, -1, 0, 1]), ([1e12, 2e12, 3e12], [1e-12, 2e-12, 3e-12]), ([5], [5])])
def test_degenerate_series_are_null_not_infinite(spark, o, s):
    row = classical.wide_panel(pairs_of(spark, {"a": (o, s)})).collect()[0].asDict()
    assert all(v is None or not isinstance(v, float) or math.isfinite(v) for v in row.values())
    if len(set(o)) == 1:
        assert all(row[m] is None for m in ("nse", "r", "r2", "spearman", "kge2009", "rsr", "beta_nse", "alpha", "nse_mod", "lm_index"))


def test_shift_identities(spark):
    o, s = pulses(5)
    p = pairs_of(spark, {"a": (o, s)})
    cfg = TimingConfig(tolerance=10, min_distance=20)
    assert timing.wasserstein1(p).collect()[0].w1 == pytest.approx(5, abs=1e-3)
    assert timing.wasserstein2sq(p).collect()[0].w2sq == pytest.approx(25, abs=1e-2)
    assert timing.best_lag(timing.lag_sweep(p)).collect()[0].lag_best == 5
    peak = shape.peak_timing(shape.peak_table(p, cfg)).collect()[0]
    assert (peak.peak_lag_abs, peak.peak_lag_signed, peak.unresolved) == (5, 5, 0)
    assert shape.peak_table(p, cfg).count() == 3
    assert shape.warping(p, cfg).collect()[0].dtw_dist == pytest.approx(0, abs=1e-3)
    level = timing.thresholds(p, cfg)
    sd = matching.series_distance(p, timing.events(p, level, cfg), timing.events(p, level, cfg, "sim"), cfg).collect()[0]
    assert sd.sd_occ == 1 and sd.sd_time == pytest.approx(5, abs=0.6)
    e = timing.events(p, timing.thresholds(p, cfg), cfg)
    assert e.count() == 3 and timing.event_metrics(timing.event_errors(p, e, 10)).collect()[0].event_lag == 5
    assert matching.event_threat(e, timing.events(p, timing.thresholds(p, cfg), cfg, "sim"), 3).collect()[0].event_threat == 1


def test_unresolved_peaks_are_left_out(spark):
    o, s = pulses(12)
    table = shape.peak_table(pairs_of(spark, {"a": (o, s)}), TimingConfig(tolerance=5, min_distance=20))
    row = shape.peak_timing(table).collect()[0]
    assert row.unresolved == 3 and row.peak_lag_abs is None


def test_cross_wavelet_sign(spark):
    t = np.arange(512)
    p = pairs_of(spark, {"a": (np.sin(2 * np.pi * t / 32), np.sin(2 * np.pi * (t - 4) / 32))})
    assert shape.cross_wavelet_lag(shape.cross_wavelet(p)).collect()[0].xwt_lag == pytest.approx(4, abs=0.5)


def test_warping_matches_the_plain_recursion():
    r = np.random.default_rng(0)
    for _ in range(20):
        a, b = r.integers(0, 6, r.integers(2, 25)).astype(float), r.integers(0, 6, r.integers(2, 25)).astype(float)
        distance, path = shape.warp(a, b, 0.3)
        assert distance == golden.dtw(a, b, 0.3)
        assert np.abs(a[path[:, 0]] - b[path[:, 1]]).sum() == pytest.approx(distance)
        assert (np.diff(path, axis=0) >= 0).all() and (np.diff(path, axis=0).sum(1) >= 1).all()


def test_generator_is_the_sequential_one(spark):
    want = list(itertools.islice(golden.mulberry(12345), 2000))
    assert [r.u for r in spark.range(2000).select(uniform_draw(F.col("id"), 12345).alias("u")).collect()] == want
    u, noise = golden.mulberry(42), []
    while len(noise) < 5000:
        x, y = 2 * next(u) - 1, 2 * next(u) - 1
        if 0 < (r := x * x + y * y) < 1:
            noise += [x * (f := np.sqrt(-2 * np.log(r) / r)), y * f]
    got = [r.z for r in normal_draws(spark, 42, 4999, 512).orderBy("j").collect()]
    assert np.allclose(got, noise[:4999], rtol=1e-12) and abs(np.mean(got)) < 0.05 and abs(np.std(got) - 1) < 0.05


def test_event_matching_is_the_greedy_one(spark):
    """Random events, many of them touching, against loops in order."""
    rng = np.random.default_rng(7)
    seen, made, want = [], [], {}
    for series in range(25):
        sides = []
        for _ in range(2):
            at, events = 0, []
            for _ in range(int(rng.integers(0, 30))):
                start = at + int(rng.integers(1, 7))
                end = start + int(rng.integers(0, 12))
                events.append((start, end, int(rng.integers(start, end + 1))))
                at = end
            sides.append(events)
        a, b = sides
        seen += [(f"s{series}", i, *e) for i, e in enumerate(a)]
        made += [(f"s{series}", i, *e) for i, e in enumerate(b)]
        used, near, pairs_ = set(), set(), set()
        for i, (s, e, p) in enumerate(a):
            over = [j for j, (t, f, _) in enumerate(b) if s - 2 <= f and t - 2 <= e]
            used |= set([j for j in over if j not in used][:1])
            free = sorted((abs(b[j][2] - p), j) for j in over if j not in near)
            if free:
                near.add(free[0][1])
                pairs_.add((f"s{series}", i, free[0][1]))
        want[f"s{series}"] = (len(used), len(a), len(b), pairs_)
    kind = "series_id string, event_no long, start_k int, end_k int, peak_k int"
    x, y = spark.createDataFrame(seen, kind), spark.createDataFrame(made, kind)
    got = {r.series_id: (r.hits, r.hits + r.misses, r.hits + r.false_alarms) for r in matching.event_threat(x, y, 2).collect()}
    assert got == {k: v[:3] for k, v in want.items() if v[1] + v[2]}
    assert {tuple(r) for r in matching.nearest_matches(x, y, 2).collect()} == set().union(*(v[3] for v in want.values()))


def test_bootstrap_repeats_and_brackets(spark, noisy):
    p = pairs_of(spark, {"a": noisy["a"]})
    ids = ["nse", "rmse"]
    a, b = (sorted(map(tuple, bootstrap.confidence_intervals(p, b=40, seed=7, ids=ids).collect())) for _ in range(2))
    assert [x[:2] for x in a] == [x[:2] for x in b] and np.allclose([x[2:] for x in a], [x[2:] for x in b], rtol=1e-12)  # sums vary in the last digit
    nse = classical.wide_panel(p).collect()[0].nse
    lo, hi = next((x[2], x[3]) for x in a if x[1] == "nse")
    assert lo <= nse <= hi
    few = bootstrap.confidence_intervals(p, b=10, ids=ids).collect()
    assert all(r.lo is None for r in few)


def test_ranking(spark):
    m = [("d", r, k, v) for r, vs in {"x": (0.9, 0.8, 1.0), "y": (0.5, 0.9, None), "z": (0.5, 0.9, 3.0)}.items() for k, v in zip(("nse", "kge2009", "w1"), vs)]
    df = spark.createDataFrame(m, "dataset_id string, run string, metric_id string, value double")
    reg = metric_registry(spark)
    s = ranking.scored(df, reg)
    score = {(r.run, r.metric_id): r.score for r in s.collect()}
    assert score["x", "nse"] == 1 and score["z", "w1"] == 0 and score["y", "w1"] is None
    order = [r.run for r in ranking.ranked(s).orderBy("rank").collect()]
    assert order[0] == "x" and order == ["x", "y", "z"]
    assert {r.metric_id: r.run for r in ranking.best_runs(df, reg).collect()} == {"nse": "x", "kge2009": "y", "w1": "x"}
    assert ranking.recommended(s, ranking.ranked(s)).count() == 2


def test_perturbation(spark):
    o = [1.0, 2, 3, 4, 5, 6]
    p = pairs_of(spark, {"a": (o, o)})
    got = [r.sim for r in sandbox.perturbed(p, Perturbation(shift=2, offset=1)).orderBy("k").collect()]
    assert got == [2, 2, 2, 3, 4, 5]
    got = [r.sim for r in sandbox.perturbed(p, Perturbation(scale=2, dampen=0.5)).orderBy("k").collect()]
    assert got == pytest.approx(o)
    u = list(itertools.islice(golden.mulberry(42), 6))
    got = [r.sim for r in sandbox.perturbed(p, Perturbation(noise=1.0)).orderBy("k").collect()]
    assert got == pytest.approx([x + 2 * d - 1 for x, d in zip(o, u)])
    assert sandbox.perturbed(p, Perturbation(noise=1.0, noise_kind="gaussian")).count() == 6


def one(spark, texts, f):
    return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(f(F.col("t"))).collect()]


def test_numeric_cells(spark):
    cases = {"1.5": 1.5, "1,5": 1.5, "1,234": 1234, "1,234.5": 1234.5, "1.234,5": 1234.5, "1,234,567": 1234567, "1,2,3": None, "1.2.3": None, "1.2,3,4": None, "1e3": 1000, "-2.5E-1": -0.25, "abc": None, "0x10": None, "1d": None, "  7 ": 7, "": None, "NA": None, "N/a": None, "---": None, "missing": None, "-9999": None}
    assert one(spark, list(cases), lambda c: cells.value_cell(c, -9999)) == list(cases.values())


def test_dates(spark):
    import datetime as dt

    d = dt.datetime
    assert one(spark, ["2001-03-04", "2001-3-4 05:06", "2001-02-30", "2001-03-04T10:75"], cells.iso_date) == [d(2001, 3, 4), d(2001, 3, 4, 5, 6), None, None]
    assert one(spark, ["04/03/2001", "2001/03/04", "4.3.01", "4-3-75"], lambda c: cells.numeric_date(c, "dmy")) == [d(2001, 3, 4), d(2001, 3, 4), d(2001, 3, 4), d(1975, 3, 4)]
    assert one(spark, ["5-Mar-2001", "March 5, 2001", "5-Sept-01", "May-2020", "5-Foo-2001"], cells.named_date) == [d(2001, 3, 5), d(2001, 3, 5), d(2001, 9, 5), None, None]
    assert one(spark, ["2001-365", "2001366", "2000-366", "2001-000"], cells.julian_date) == [d(2001, 12, 31), None, d(2000, 12, 31), None]
    kind = lambda *t: cells.date_format_of(spark.createDataFrame([(x,) for x in t], "t string"), "t")
    assert [kind("13/01/2001", "01/02/2001"), kind("01/13/2001"), kind("01/02/2001"), kind("2001-365"), kind("2001-01-02"), kind("5-Mar-2001")] == ["dmy", "mdy", "ambiguous", "julian", "iso", "month-name"]


def test_shown_numbers_and_guards(spark):
    df = spark.createDataFrame([(0, -0.001), (1, 1.005), (2, None), (3, float("nan")), (4, float("inf")), (5, -1.5)], "i int, v double").orderBy("i")
    assert [r[0] for r in df.select(cells.shown_number(F.col("v"), 2)).collect()][2:] == ["n/a", "n/a", "n/a", "-1.50"]
    assert one(spark, ["=1+1", "-5", "-x", "@a", "plain", "+1e3"], cells.safe_cell) == ["'=1+1", "-5", "'-x", "'@a", "plain", "+1e3"]


def series_of(spark, values):
    import datetime as dt

    return spark.createDataFrame([("a", dt.datetime.fromisoformat(t), o, s) for t, o, s in values], "series_id string, ts timestamp, obs double, sim double")


def test_frames(spark):
    x = series_of(spark, [("2001-01-01", 1.0, None), ("2001-01-02", None, 2.0), ("2001-01-03", float("nan"), 3.0), ("2001-01-04", 4.0, 4.0), ("2001-02-05", 5.0, float("inf"))])
    assert [(r.k, r.obs) for r in frame.paired(x).collect()] == [(0, 4.0)]
    assert frame.paired(x, "zero").count() == 5
    assert sorted(r.obs for r in frame.paired(x, "mean").collect()) == pytest.approx([1, 10 / 3, 10 / 3, 4, 5])
    assert frame.in_season(x, 36, 1).count() == 2 and frame.in_window(x, F.to_timestamp(F.lit("2001-01-04")), F.to_timestamp(F.lit("2001-01-02"))).count() == 3
    monthly = {r.ts.month: (r.obs, r.sim) for r in frame.resampled(frame.cleaned(x), "month").collect()}
    assert monthly == {1: (2.5, 3.0), 2: (5.0, None)}
    first = frame.aligned(spark.createDataFrame([("a", 1, 2.0, 1), ("a", 1, 3.0, 0), ("a", None, 1.0, 2)], "series_id string, t int, obs double, row_no int").withColumn("ts", F.timestamp_seconds("t")))
    assert [r.obs for r in first.collect()] == [3.0]
    with pytest.raises(ValueError):
        frame.committed(x, "new")
    levels = {(r.level, r.message) for r in frame.checks(x).collect()}
    assert ("error", "fewer than two complete pairs") in levels


@pytest.mark.parametrize("dates,label,irregular", [(["2001-01-01", "2001-01-02", "2001-01-03"], "1d", False), (["2001-01-01", "2001-02-01", "2001-03-01", "2001-04-01"], "1mo", False), (["2001-01-01 00:00", "2001-01-01 06:00", "2001-01-01 12:00"], "6h", False), (["2001-01-01"], "1d", False), (["2001-01-01", "2001-01-02", "2001-01-09", "2001-01-10 05:00"], "1d", True)])
def test_steps(spark, dates, label, irregular):
    r = frame.step(series_of(spark, [(d, 1.0, 1.0) for d in dates])).withColumn("label", frame.step_label(F.col("step_ms"), F.col("monthly"))).collect()[0]
    assert (r.label, r.irregular) == (label, irregular)


def test_units(spark):
    x = series_of(spark, [("2001-02-01", 1.0, 2.0)])
    assert units.converted(x, "m3s", "ls").collect()[0].obs == pytest.approx(1000)
    assert units.converted(x, "mm_day", "m3s", 86.4).collect()[0].obs == pytest.approx(1)
    feb = units.converted(x, "mm_step", "m3s", 1.0, monthly=True).collect()[0].obs
    assert feb == pytest.approx(1000 / (28 * 86400))
    with pytest.raises(ValueError):
        units.converted(x, "mm_day", "mm_day")
    assert units.converted_threshold(x, 2.0, "m3s", "ls") == pytest.approx(2000)
    assert not units.compatible("dimensionless", "m3s", True) and units.area_km2(1, "mi2") == 2.589988


def test_text_tables(spark, tmp_path):
    (tmp_path / "t.csv").write_text("﻿date;obs [cfs];run one;note\r\n13/01/2001;1,5;2;x\r\n\r\n14/01/2001;NA;3;y\r\n13/01/2001;9;9;z\r\n")
    table = tables.read_delimited(spark, str(tmp_path / "t.csv"))
    assert tables.guessed_roles(table.columns) == ["date", "observed", "run", "run"] and tables.unit_of("obs [cfs]") == ("obs", "cfs")
    series, _ = tables.staged(table, ["date", "observed", "run", "ignore"])
    assert sorted((r.ts.day, r.obs, r.sim, r.series_id) for r in series.collect()) == [(13, 1.5, 2.0, "run one"), (14, None, 3.0, "run one")]
    with pytest.raises(ValueError):
        tables.staged(table, ["date", "ignore", "run", "ignore"])
    assert tables.from_grid(spark, [("2001-01-01", 1, 2), ("", None, "")]).count() == 1
    grid = tables.from_paste(spark, "2001-01-01\t1\t2\r\n\t\t\n2001-01-02\t3\n", 2).collect()
    assert [tuple(r) for r in grid] == [("2001-01-01", "1", "2", ""), ("2001-01-02", "3", "", "")]


def test_text_with_quoted_breaks_dots_and_equal_names(spark, tmp_path):
    (tmp_path / "q.csv").write_text('Date,sim.1,note,sim.1,,SIM.1\n2001-01-01,1,"a\nb, ""c""",2,x,3,beyond\n\n2001-01-02,4\n" ",,\n')
    table = tables.read_delimited(spark, str(tmp_path / "q.csv"))
    assert table.columns == ["Date", "sim.1", "note", "sim.1 (2)", "column 5", "SIM.1 (3)"]
    assert [tuple(r) for r in table.collect()] == [("2001-01-01", "1", 'a\nb, "c"', "2", "x", "3"), ("2001-01-02", "4", None, None, None, None)]
    series, found = tables.staged(table, ["date", "observed", "ignore", "run", "ignore", "run"])
    assert sorted((r.series_id, r.ts.day, r.obs, r.sim) for r in series.collect()) == [("SIM.1 (3)", 1, 1.0, 3.0), ("SIM.1 (3)", 2, 4.0, None), ("sim.1 (2)", 1, 1.0, 2.0), ("sim.1 (2)", 2, 4.0, None)]
    assert {r.level for r in found.collect()} == {"error"}
    (tmp_path / "r.csv").write_text("date,o,run a,run a [cfs]\n2001-01-01,1,2,3\n2001-01-02,1,2,3\n")
    both = tables.staged(tables.read_delimited(spark, str(tmp_path / "r.csv")), ["date", "observed", "run", "run"])[0]
    assert {(r.series_id, r.sim) for r in both.collect()} == {("run a", 2.0), ("run a (2)", 3.0)}
    for empty in ("", "\n\n"):
        (tmp_path / "e.csv").write_text(empty)
        assert tables.read_delimited(spark, str(tmp_path / "e.csv")).count() == 0


def test_workbooks(spark, tmp_path):
    """Shared and inline strings, dates as numbers with a date style, a blank row, a short first sheet and a later one."""
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = lambda rows: f"<worksheet {ns}><sheetData>{rows}</sheetData></worksheet>"
    body = '<row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>obs</t></is></c></row><row/><row><c r="A3" s="1"><v>36892</v></c><c r="B3"><v>1.5</v></c></row><row><c r="A4" s="2"><v>36893.25</v></c></row>'
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Date</t></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", sheet('<row><c r="A1"><v>1</v></c></row>'))
        z.writestr("xl/worksheets/sheet2.xml", sheet(body))
        z.writestr("xl/worksheets/sheet10.xml", sheet(body))
    table = tables.read_workbook(spark, str(tmp_path / "w.xlsx"))
    assert [tuple(r) for r in table.collect()] == [("2001-01-01 00:00:00", "1.5"), ("2001-01-02 06:00:00", "")] and table.columns == ["Date", "obs"]
    assert tables.workbook_notes(spark, str(tmp_path / "w.xlsx")) == ["1 other sheets with data are left out"]


def test_project_round_trip(spark, tmp_path):
    x = series_of(spark, [("2001-01-01", 1.0, 2.0), ("2001-01-02", None, 3.0)])
    sinks.project_documents(x).write.text(str(tmp_path / "p"))
    back, skipped = tables.read_project(spark, str(tmp_path / "p"))
    assert sorted((r.ts.day, r.obs, r.sim) for r in back.collect()) == [(1, 1.0, 2.0), (2, None, 3.0)] and skipped.count() == 0
    (tmp_path / "bad.json").write_text('{"schemaVersion":1,"datasets":[{"id":"q","dates":[1,2],"observed":{"values":[1]},"runs":[]}]}')
    assert tables.read_project(spark, str(tmp_path / "bad.json"))[1].collect()[0].reason.startswith("observed")
    (tmp_path / "old.json").write_text('{"schemaVersion":2,"datasets":[]}')
    with pytest.raises(ValueError):
        tables.read_project(spark, str(tmp_path / "old.json"))


def test_exports(spark, noisy, tmp_path):
    wide = classical.wide_panel(pairs_of(spark, {"a": noisy["a"]}))
    long, reg = classical.to_long(wide, classical.metric_ids(wide)), metric_registry(spark)
    table = sinks.metric_table(long, reg, ["a"])
    assert table.count() == 45
    sinks.write_text(table, str(tmp_path / "m"))
    assert spark.read.option("header", True).csv(str(tmp_path / "m")).count() == 45
    sinks.write_markdown(table.limit(3), str(tmp_path / "md"))
    assert spark.read.text(str(tmp_path / "md")).count() == 5


def test_entry_names_match():
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and "panel_classical" in q


def test_workbook(spark, tmp_path):
    import zipfile

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cell = lambda ref, text: f'<c r="{ref}" t="inlineStr"><is><t>{text}</t></is></c>'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>date</t></si><si><t>obs</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1">{cell("A1", "only one row")}</row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row r="2">{cell("A2", "2001-01-01")}<c r="B2"><v>1.5</v></c></row><row r="3"></row><row r="4">{cell("A4", "2001-01-02")}</row></sheetData></worksheet>')
    table = tables.read_workbook(spark, str(tmp_path / "b.xlsx"))
    assert table.columns == ["date", "obs"] and [tuple(r) for r in table.collect()] == [("2001-01-01", "1.5"), ("2001-01-02", "")]


def test_table_helpers(spark, noisy):
    p = pairs_of(spark, {"a": noisy["a"], "b": noisy["b"]})
    meta = spark.createDataFrame([("a", True, 91.0, 0.0, 1.0), ("b", False, 10.0, 20.0, 5.0)], "series_id string, visible boolean, lat double, lon double, area double")
    assert {r.series_id for r in frame.visible_runs(p, meta).select("series_id").distinct().collect()} == {"a"}
    assert [r.series_id for r in frame.valid_location(meta).collect()] == ["b"]
    assert frame.committed(p, "new", season=(1, 31)).count() == 62
    e = timing.event_errors(p, timing.events(p, timing.thresholds(p, TimingConfig()), TimingConfig()), 3)
    wide = classical.wide_panel(p)
    long, reg = classical.to_long(wide, ["nse", "rmse"]), metric_registry(spark)
    parts = sinks.report_tables(long, reg, e, ["a", "b"], chunk=1, events=2)
    assert set(parts) == {"metrics_1", "metrics_2", "events"} and parts["events"].count() <= 4
    assert sinks.plot_rows({"obs": p, "sim": p}, "ts", "obs").count() == 4 * 365
    ci = spark.createDataFrame([("a", "nse", 0.1, 0.2)], "series_id string, metric_id string, lo double, hi double")
    assert sinks.with_intervals(long, ci).where("lo is not null").count() == 1
