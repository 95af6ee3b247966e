"""Composite ranking of runs, the best run of each metric, and what to recommend."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import finite
from ..plans.registry import C2M, PRIORITIES
from .classical import c2m


def scored(metrics: DataFrame, registry: DataFrame) -> DataFrame:
    """metrics (dataset_id, run, metric_id, value) with a score from 0 to 1 within dataset and metric."""
    x = metrics.join(F.broadcast(registry.select("metric_id", "direction", "optimum")), "metric_id")
    v = finite(F.col("value"))
    bounded = F.when(F.col("metric_id").isin(list(C2M)), (c2m(v) + 1) / 2).otherwise(v)
    x = x.withColumn("raw", F.when(F.col("direction") == "max", bounded).otherwise(F.abs(v - F.col("optimum"))))
    w = Window.partitionBy("dataset_id", "metric_id")
    lo, hi = F.min("raw").over(w), F.max("raw").over(w)
    share = F.when(hi - lo < 1e-15, F.when(F.col("direction") == "max", 1.0).otherwise(0.0)).otherwise(F.try_divide(F.col("raw") - lo, hi - lo))
    score = F.when(F.col("raw").isNotNull(), F.when(F.col("direction") == "max", share).otherwise(1 - share))
    return x.withColumn("score", score).select("dataset_id", "run", "metric_id", "value", "score")


def ranked(scores: DataFrame, priorities: dict[str, float] | None = None) -> DataFrame:
    """(dataset_id, run, composite, rank, per_metric): weighted means of the scores there are; ties go by name."""
    weights = {k: v for k, v in (priorities or PRIORITIES).items() if v > 0}
    w = F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("metric_id"))
    x = scores.where(F.col("metric_id").isin(list(weights))).withColumn("w", F.when(F.col("score").isNotNull(), w))
    g = x.groupBy("dataset_id", "run").agg(F.try_divide(F.sum(F.col("w") * F.col("score")), F.sum("w")).alias("composite"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric_id", "score")))).alias("per_metric"))
    order = Window.partitionBy("dataset_id").orderBy(F.desc_nulls_last("composite"), "run")
    return g.withColumn("rank", F.row_number().over(order))


def recommended(scores: DataFrame, ranks: DataFrame, priorities: dict[str, float] | None = None, top: int = 2) -> DataFrame:
    """The first run of each dataset with its best-scoring priority metrics."""
    used = [k for k, v in (priorities or PRIORITIES).items() if v > 0]
    x = scores.where(F.col("metric_id").isin(used)).join(ranks.where("rank = 1").select("dataset_id", "run"), ["dataset_id", "run"], "left_semi")
    place = F.row_number().over(Window.partitionBy("dataset_id").orderBy(F.desc_nulls_last("score"), "metric_id"))
    return x.withColumn("place", place).where(F.col("place") <= top).select("dataset_id", "run", "place", "metric_id", "score")


def best_runs(metrics: DataFrame, registry: DataFrame) -> DataFrame:
    """The first best run of each metric, by its direction: largest, smallest, nearest 0 or nearest 1."""
    x = metrics.join(F.broadcast(registry.select("metric_id", "direction")), "metric_id").where(finite(F.col("value")).isNotNull())
    v, d = F.col("value"), F.col("direction")
    cost = F.when(d == "max", -v).when(d == "min", v).when(d == "zero", F.abs(v)).otherwise(F.abs(v - 1))
    w = Window.partitionBy("dataset_id", "metric_id").orderBy(cost, "run")
    return x.withColumn("place", F.row_number().over(w)).where("place = 1").select("dataset_id", "metric_id", "run", "value")
