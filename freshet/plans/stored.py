"""Metrics that are kept under what they were made from, so that only stale ones are made anew.

A result's key is the content of its series and the settings. Content is a count and two sums of row hashes: it merges before any
shuffle and does not depend on order. What a store lacks is found by an anti join, made by one evaluation of those series, and
added; results of other contents and settings stay, so going back to earlier settings costs nothing.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import deleted, written
from .config import EvalConfig
from .panel import evaluate
from .registry import user_sums, user_values

SCHEMA = "content string, metric_id string, value double, settings string"


def contents(series: DataFrame) -> DataFrame:
    """(series_id, content): a key of each series' name and rows (ts, obs, sim), repeated rows counted. A null name is one, too."""
    cell = [F.col("ts").cast("timestamp"), F.col("obs").cast("double"), F.col("sim").cast("double")]
    # A hash skips nulls, so each cell's absence is hashed beside it; -0.0 and 0.0 are told apart by no metric.
    seen = [F.struct(c.isNull(), c + F.lit(0.0) if i else c) for i, c in enumerate(cell)]
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), *seen).cast("decimal(38,0)")).cast("string")
    g = series.groupBy("series_id").agg(F.count("*").cast("string").alias("n"), total(0).alias("a"), total(1).alias("b"))
    name = F.coalesce(F.concat(F.lit("="), "series_id"), F.lit("null"))
    return g.select("series_id", F.sha2(F.concat_ws("\x1f", "n", "a", "b", name), 256).alias("content"))


def settings_key(cfg: EvalConfig, heavy: bool) -> str:
    """A key of all settings that a metric depends on, registered metrics with their expressions among them."""
    own = sorted((f"user_{m}", str(c)) for m, c in user_values().items()) + sorted((k, str(c)) for k, c in user_sums().items())
    return hashlib.sha256(repr((cfg, heavy, own)).encode()).hexdigest()[:16]


def _kept(series: DataFrame, path: str, settings: str) -> DataFrame:
    spark = series.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where):
        return spark.createDataFrame([], SCHEMA).drop("settings")
    return spark.read.schema(SCHEMA).parquet(path).where(F.col("settings") == settings).drop("settings")


def stale(series: DataFrame, path: str, cfg: EvalConfig = EvalConfig(), heavy: bool = False) -> DataFrame:
    """(series_id, content) of the series for which the store at ``path`` has no results under these settings."""
    return _lacking(contents(series), path, settings_key(cfg, heavy))


def _lacking(content: DataFrame, path: str, settings: str) -> DataFrame:
    return content.join(_kept(content, path, settings).select("content").distinct(), "content", "left_anti").select("series_id", "content")


def evaluate_stored(series: DataFrame, path: str, cfg: EvalConfig = EvalConfig(), heavy: bool = False) -> DataFrame:
    """(series_id, metric_id, value) as ``panel.evaluate`` gives, from the store at ``path``, a folder that all machines share. Series
    that are new, changed, or not yet evaluated under these settings are evaluated first. Series without pairs get no metrics, but
    a mark (a null metric_id), so they are not evaluated again. Writers at the same time may add a result twice; one is read.
    ``series`` is made twice: for its contents, and for what is evaluated, both written as several jobs read them."""
    settings = settings_key(cfg, heavy)
    content = written(contents(series), "contents")
    todo = written(_lacking(content, path, settings), "stale")
    if not todo.isEmpty():
        fresh = written(series.select("series_id", "ts", "obs", "sim").join(todo, "series_id", "left_semi"), "stale-series")
        made = evaluate(fresh, cfg, heavy)
        rows = todo.join(made, "series_id", "left").select("content", "metric_id", "value", F.lit(settings).alias("settings"))
        rows.write.mode("append").partitionBy("settings").parquet(path)
        deleted(fresh)
    deleted(todo)
    kept = _kept(series, path, settings).where("metric_id is not null").dropDuplicates(["content", "metric_id"])
    return content.join(kept, "content").select("series_id", "metric_id", "value")
