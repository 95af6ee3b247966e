"""Registered queries cover whole series, not a prefix."""

import datetime as dt

from freshet.operators import frame
from freshet.plans import catalog


def test_validate_checks_covers_all_days(spark, tmp_path):
    day = dt.datetime(1995, 1, 2)
    line = lambda flag, i, q, part=1, number=1: (i, part, number, flag, day + dt.timedelta(days=i), q, 100.0, 0.0)
    rows = [line("A", i, -1.0 if i == 900 else 5.0) for i in range(1000)]  # negative long after the first weeks
    rows += [line("N", i + (i * i if i > 60 else 0), 5.0) for i in range(200)]  # steps grow after two months
    rows += [line("R", i, 5.0, 5, 7) for i in range(20)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_linenumber long, l_returnflag string, l_shipdate timestamp, l_quantity double, l_extendedprice double, l_discount double").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {tuple(r) for r in catalog.queries()["validate_checks"](spark, str(tmp_path)).collect()}
    of_parts = {x for x in got if x[0].startswith("part")}
    assert got - of_parts == {("A", "warning", "negative values"), ("N", "warning", "irregular time step"), ("R", "warning", "little overlap")}
    assert of_parts == {("part 1", "warning", "repeated dates"), ("part 1", "warning", "negative values"), ("part 5", "error", "dates that can't be read"), ("part 5", "warning", "little overlap")}


def test_all_seven_checks(spark):
    day = lambda i: dt.datetime(2001, 1, 1) + dt.timedelta(days=i)
    rows = [("few", day(i), 1.0 if i == 0 else None, 1.0) for i in range(40)] + [("few", None, 1.0, None)]
    rows += [("odd", day(i * i), -1.0, 1.0) for i in range(20)] + [("odd", day(0), 1.0, 1.0)]
    rows += [("good", day(i), 1.0, 1.0) for i in range(40)]
    got = {tuple(r) for r in frame.checks(spark.createDataFrame(rows, "series_id string, ts timestamp, obs double, sim double")).collect()}
    assert got == {
        ("few", "error", "dates that can't be read"), ("few", "error", "fewer than two complete pairs"), ("few", "warning", "more than half of the observations are missing"),
        ("odd", "warning", "repeated dates"), ("odd", "warning", "irregular time step"), ("odd", "warning", "negative values"), ("odd", "warning", "little overlap"),
    }
