"""Series derived from the driver's tables: daily flows by return flag or brand, hourly event values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lines that a task takes where series are many and short.
LINES = 262_144


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _daily(lines: DataFrame, key: Column) -> DataFrame:
    """obs: quantity, sim: discounted price / 1500 to four digits, a row a day; every 37th day has no obs and every 53rd no sim. Prices
    are added as decimals and rounded as whole numbers of 0.0001, so that no sum's order and no double near a half shows."""
    ten_thousandths = (F.sum(F.col("l_extendedprice").cast("decimal(12,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))) * 10000).cast("long")
    g = lines.groupBy(key.alias("series_id"), F.date_trunc("day", F.col("l_shipdate").cast("timestamp")).alias("ts")).agg(
        F.round(F.sum("l_quantity"), 4).alias("obs"), (F.floor((ten_thousandths + 750) / 1500) / 10000).alias("sim")
    )
    day = F.datediff("ts", F.lit("1995-01-01"))
    return g.withColumns({"obs": F.when(day % 37 != 0, F.col("obs")), "sim": F.when(day % 53 != 0, F.col("sim"))})


def by_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _daily(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount"), F.col("l_returnflag"))


def by_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return _daily(lines.join(parts, "l_partkey"), F.col("p_brand"))


def by_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A series a supplier: their number grows with the table. Few lines share a day, so sums by task before the exchange would hold
    nearly as many groups as a file's part has lines; lines are dealt by supplier first, to tasks of about LINES each."""
    lines = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("supplier "), "l_suppkey").alias("series_id"), "l_shipdate", "l_quantity", "l_extendedprice", "l_discount")
    tasks = -(-lines.count() // LINES)
    return _daily(lines.repartition(tasks, "series_id") if tasks > 1 else lines, F.col("series_id"))


def one_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of one observed record and runs A, N and R on the same days, as files have it: ts, Observed, A, N, R."""
    x = by_flag(spark, sf_dir)
    wide = x.groupBy("ts").pivot("series_id", ["A", "N", "R"]).agg(F.first("sim"))
    return wide.join(x.where("series_id = 'R'").select("ts", F.col("obs").alias("Observed")), "ts", "left").select("ts", "Observed", "A", "N", "R")


def messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by part with what records have: dates that can't be read, repeated dates, gaps, negative values, one side missing."""
    x, part = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_shipdate", "l_quantity"), F.col("l_partkey")
    ts = F.when((part % 5 != 0) | (F.col("l_linenumber") != 7), F.date_trunc("day", F.col("l_shipdate").cast("timestamp")))
    obs = F.when((part % 11 != 0) | (F.col("l_orderkey") % 3 == 0), F.when(part % 13 == 0, -F.col("l_quantity")).otherwise(F.col("l_quantity")))
    sim = F.when(part % 17 != 0, F.col("l_quantity") + F.col("l_linenumber"))
    return x.select(F.concat(F.lit("part "), part).alias("series_id"), ts.alias("ts"), obs.alias("obs"), sim.alias("sim"))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values by hour and type: obs the sum, sim ten times the number of events."""
    e = table(spark, sf_dir, "events").select("event_type", "ts", "value")
    return e.groupBy(F.col("event_type").alias("series_id"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("ts")).agg(F.round(F.sum("value"), 4).alias("obs"), (F.count("*") * 10.0).alias("sim"))
