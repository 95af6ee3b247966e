"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations.

The ring has CELLS cells. Each shard holds some cells as virtual nodes; a key belongs to the first virtual node at or
after its own cell. A shard takes no more keys than its bound; keys beyond it continue clockwise to the next virtual
node of a shard with room. Without slack the bounds add up to the number of rows, so counts differ by one at most (law
``rows``).

Only the counts of the CELLS cells go to the driver; they decide how many keys of each cell go where. Rows then find
their place by their rank in their cell.

Defined results: a null text has size 1 and checksum 0; a very long text is read once, for its size and checksum; a row without doc_id is placed by its text; equal rows get slots of
their own; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

#: Cells of the ring: also the bound on what goes to the driver, and on the broadcast plan (a row a cell, and one more a shard).
CELLS = 4096


def virtual_nodes(shards: int, each: int = 64) -> dict[int, int]:
    """Cell -> shard; a shard's nodes do not depend on how many other shards there are, unless they meet in a cell."""
    nodes: dict[int, int] = {}
    for k in range(each):
        for s in range(shards):
            cell = int.from_bytes(hashlib.md5(f"{s}:{k}".encode()).digest()[:4], "big") % CELLS
            while cell in nodes:
                cell = (cell + 1) % CELLS
            nodes[cell] = s
    return nodes


def ring_plan(counts: dict[int, int], shards: int, slack: float = 0.0, each: int = 64) -> list[tuple[int, int, int, int, int, int]]:
    """(cell, first rank, end rank, shard, slot of the first, home shard) from the number of keys in each cell."""
    nodes = virtual_nodes(shards, each)
    at = sorted(nodes)
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) + int(slack * total / shards) for s in range(shards)]
    used = [0] * shards
    plan, over, following = [], [], {}
    j = 0
    for cell in range(CELLS):
        while j < len(at) and at[j] < cell:
            j += 1
        following[cell] = j % len(at)

    def place(cell: int, lo: int, n: int, shard: int) -> None:
        plan.append((cell, lo, lo + n, shard, used[shard], nodes[at[following[cell]]]))
        used[shard] += n

    for cell in sorted(counts):
        home = nodes[at[following[cell]]]
        n = min(counts[cell], room[home] - used[home])
        if n:
            place(cell, 0, n, home)
        if n < counts[cell]:
            over.append((cell, n, counts[cell] - n))
    for cell, lo, n in over:
        step = following[cell]
        while n:
            step = (step + 1) % len(at)
            shard = nodes[at[step]]
            take = min(n, room[shard] - used[shard])
            if take:
                place(cell, lo, take, shard)
                lo, n = lo + take, n - take
    return plan


def bounded_ring(rows: DataFrame, key: str, tie: list[str], shards: int, slack: float = 0.0, each: int = 64) -> DataFrame:
    """``rows`` with shard, slot (gapless from 0 in each shard), home_shard (the ring's choice without bounds) and moved.
    ``tie``: columns that order the rows of a cell."""
    placed = durable(rows.withColumn("ring_cell", F.pmod(F.xxhash64(key), F.lit(CELLS)).cast("int")), "ring")
    counts = {r[0]: r[1] for r in placed.groupBy("ring_cell").count().collect()}
    plan = json.dumps(ring_plan(counts, shards, slack, each))
    kind = "array<array<bigint>>"
    steps = rows.sparkSession.range(1).select(F.explode(F.from_json(F.lit(plan), kind)).alias("p")).select(
        F.col("p")[0].cast("int").alias("ring_cell"), F.col("p")[1].alias("lo"), F.col("p")[2].alias("hi"), F.col("p")[3].cast("int").alias("shard"), F.col("p")[4].alias("base"), F.col("p")[5].cast("int").alias("home_shard")
    )
    ranked = placed.withColumn("ring_rank", F.row_number().over(Window.partitionBy("ring_cell").orderBy(F.xxhash64(key), *tie)).cast("long") - 1)
    found = ranked.join(F.broadcast(steps), (ranked["ring_cell"] == steps["ring_cell"]) & (ranked["ring_rank"] >= steps["lo"]) & (ranked["ring_rank"] < steps["hi"]))
    return found.select(*[ranked[c] for c in rows.columns], "shard", (F.col("base") + F.col("ring_rank") - F.col("lo")).alias("slot"), "home_shard", (F.col("shard") != F.col("home_shard")).alias("moved"))


def shard_documents(docs: DataFrame, shards: int = 8, slack: float = 0.0) -> DataFrame:
    """Per row: doc_id, size (UTF-8 bytes + 1), text_crc32, law, shard, slot, grown_shard, home_shard, moved."""
    raw = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    rows = rows.withColumn("ring_key", F.coalesce("doc_id", "text_crc32"))
    out = bounded_ring(rows, "ring_key", ["doc_id", "text_crc32", "size"], shards, slack)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home_shard", "moved")
