"""Connected components of a table of links, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, durable


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that links reach, for every node in ``links`` (two long columns).

    Each round takes the least label among a node's neighbours, then jumps to that label's own label, so a chain
    of length n needs about log n rounds. Rounds are written to the shared folder; nothing gathers a group. A link with
    a null end links nothing."""
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    edges = durable(edges.union(edges.select(F.col("v"), F.col("u"))).distinct(), "edges")
    labels = durable(edges.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("u")).alias("component")), "labels")
    written = labels
    while True:
        near = edges.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "node", "left").select("node", F.col("component").alias("was"), F.least("component", "near").alias("now"))
        up = labels.select(F.col("node").alias("now"), F.col("component").alias("up"))
        new = durable(lower.join(up, "now", "left").select("node", F.least("now", "up").alias("component"), (F.least("now", "up") < F.col("was")).alias("changed")), "labels")
        discard(written)
        written, labels = new, new.select("node", "component")
        if new.where("changed").limit(1).count() == 0:
            discard(edges)
            return labels
