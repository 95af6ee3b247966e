"""Plot data whose size is bounded by the cells of a picture, not by the pairs: scatter, annual heat map, long traces.

Each makes one row a cell by an aggregation with partial sums; where the axes come from the data, one row a series tells them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import finite
from . import frame, ranges


def _cell(v: Column, lo: Column, hi: Column, cells: int) -> Column:
    """The cell, from 0, of a value on an axis from lo to hi; the end belongs to the last cell, and an axis of one point has one cell."""
    at = F.floor(F.try_divide(v - lo, hi - lo) * cells)
    return F.least(F.coalesce(at, F.lit(0)), F.lit(cells - 1)).cast("int")


def scatter_cells(pairs: DataFrame, cells: int = 200) -> DataFrame:
    """(series_id, x, y, n, obs, sim): a 1:1 plot as cells of one axis for both sides, from 0 (or the least value, if negative) to the
    largest value: how many pairs lie in each cell that has any, and their means."""
    axis = pairs.groupBy("series_id").agg(F.least(F.lit(0.0), F.min(F.least("obs", "sim"))).alias("lo"), F.max(F.greatest("obs", "sim")).alias("hi"))
    x = ranges.meet(pairs.select("series_id", "obs", "sim"), axis, ["series_id"])
    at = lambda c: _cell(F.col(c), F.col("lo"), F.col("hi"), cells)
    return x.groupBy("series_id", at("obs").alias("x"), at("sim").alias("y")).agg(F.count("*").alias("n"), F.avg("obs").alias("obs"), F.avg("sim").alias("sim"))


def heat_cells(series: DataFrame, columns: int = 366, c: str = "obs") -> DataFrame:
    """(series_id, year, column, n, value): an annual heat map of ``columns`` columns a year: the mean of the last values of the days of
    each cell, missing ones left out; a cell without a value has NULL."""
    x = frame.year_by_doy(frame.cleaned(series), c)
    column = F.floor((F.col("doy") - 1) * columns / 366).cast("int")
    return x.groupBy("series_id", "year", column.alias("column")).agg(F.count("value").alias("n"), F.avg("value").alias("value"))


def trace_cells(series: DataFrame, columns: int = 1000, c: str = "obs") -> DataFrame:
    """(series_id, column, n, first, last, low, high): a trace over time as ``columns`` equal spans from the first to the last date: the
    first, last, least and largest value of each, so that a line through them covers the pixels of the whole trace. Of rows with one
    date the least value counts as first, the largest as last; missing values are left out."""
    x = series.select("series_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), finite(F.col(c)).alias("v")).where("t is not null and v is not null")
    axis = x.groupBy("series_id").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    x = ranges.meet(x, axis, ["series_id"])
    column = _cell(F.col("t").cast("double"), F.col("lo").cast("double"), F.col("hi").cast("double"), columns)
    ends = F.struct("t", "v")
    g = x.groupBy("series_id", column.alias("column")).agg(F.count("*").alias("n"), F.min(ends).alias("a"), F.max(ends).alias("b"), F.min("v").alias("low"), F.max("v").alias("high"))
    return g.select("series_id", "column", "n", F.col("a.v").alias("first"), F.col("b.v").alias("last"), "low", "high")
