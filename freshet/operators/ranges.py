"""Orders, ranks and running sums of series that are too long for one task.

A series is cut into pieces that tasks take one by one: blocks of consecutive places where rows have a place ``k``, or ranges of a
value, between splitters that a mergeable sketch gives. Whatever runs over a whole series is made in two levels: within the
pieces, and over one row a piece, whose results are joined to the pieces. Equal values are counted before they are dealt, so a value that
many rows have is one row of its range. A short series is a single piece.

Keys may be null: pieces meet their rows null-safe. A join by a series' key alone would send all its rows to one task; beyond DEAL rows
none is made here.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import deleted, written

#: Rows a piece, and pieces a series at most, by value: beyond, pieces grow.
BLOCK, RANGE, MOST_RANGES = 65_536, 65_536, 4096
#: Rows of a key that one task meets its splitters for.
DEAL = 1_048_576


def block_of(k: str = "k", rows: int = BLOCK) -> Column:
    """The block of consecutive places that place ``k`` lies in."""
    return F.floor(F.col(k) / rows)


def meet(x: DataFrame, small: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``x`` joined with the other columns of ``small`` by equal keys, null ones too."""
    y = small.select(*[F.col(k).alias(f"{k}__") for k in keys], *[c for c in small.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [x[k].eqNullSafe(y[f"{k}__"]) for k in keys])
    return x.join(y, same, how).drop(*[f"{k}__" for k in keys])


def with_ranges(df: DataFrame, keys: list[str], by: Column, rows: int = RANGE) -> DataFrame:
    """``df`` with range_, the number of the range of ``by`` that a row lies in: about ``rows`` rows of its keys. Ranges are in the order
    of ``by``, equal values share one, null is in the first. A job counts the rows of the largest key; splitters are quantiles of a
    sample by a hash of the value, about 100 for each range, so they are the same however often they are made. Beyond DEAL rows a key's
    rows are dealt by a hash, and each share meets the splitters on its own."""
    x = df.withColumn("by_", by.cast("double"))
    largest = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    m = int(min(MOST_RANGES, -(-largest // rows)))
    if m <= 1:
        return df.withColumn("range_", F.lit(0))
    every = max(1, largest // (100 * m))
    cuts = F.array_distinct(F.percentile_approx("by_", [i / m for i in range(1, m)], 20 * m))
    sample = x.where(F.pmod(F.xxhash64("by_"), F.lit(every)) == 0).groupBy(*keys).agg(cuts.alias("cuts_"))
    shares = -(-largest // DEAL)
    if shares > 1:
        x = x.withColumn("deal_", F.pmod(F.xxhash64(*[c for c, t in df.dtypes if "map<" not in t]), F.lit(shares)))
        sample = sample.withColumn("deal_", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)).cast("array<long>")))
    x = meet(x, sample, [*keys, "deal_"] if shares > 1 else keys, "left")

    def step(at: Column, size: Column) -> Column:
        return F.when(F.get("cuts_", at + size - 1) < F.col("by_"), at + size).otherwise(at)

    powers = F.array(*[F.lit(1 << b) for b in reversed(range(m.bit_length()))])
    return x.withColumn("range_", F.aggregate(powers, F.lit(0), step)).drop("by_", "cuts_", "deal_")


def running(df: DataFrame, keys: list[str], piece: str, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` with, for each name, the sum of its expression over all rows of the keys up to this one, by ``piece`` and then ``order``."""
    within = Window.partitionBy(*keys, piece).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, piece).agg(*[F.sum(c).alias(f"{n}_before") for n, c in sums.items()])
    offsets = totals.select(*keys, piece, *[F.coalesce(F.sum(f"{n}_before").over(before), F.lit(0)).alias(f"{n}_before") for n in sums])
    x = meet(df.withColumns({n: F.sum(c).over(within) for n, c in sums.items()}), offsets, [*keys, piece])
    return x.withColumns({n: F.coalesce(n, F.lit(0)) + F.col(f"{n}_before") for n in sums}).drop(*[f"{n}_before" for n in sums])


def numbered(df: DataFrame, keys: list[str], order: Column, rows: int = RANGE, name: str = "k") -> DataFrame:
    """``df`` with the place (from 0) of each row among those of its keys, by ``order``."""
    x = with_ranges(df, keys, order, rows)
    return running(x, keys, "range_", [order], {name: F.lit(1)}).withColumn(name, (F.col(name) - 1).cast("long")).drop("range_")


def ranked_values(values: DataFrame, keys: list[str], rows: int = RANGE, write: bool = False) -> DataFrame:
    """(keys, value, c, before): each distinct value, how many rows have it, and how many of the keys have a lesser one. With ``write``
    counts and result are tables, which pays where several branches read them; the result is the caller's to delete."""
    counts = values.groupBy(*keys, "value").agg(F.count("*").alias("c"))
    counts = written(counts, "counts") if write else counts
    x = running(with_ranges(counts, keys, F.col("value"), rows), keys, "range_", [F.col("value")], {"upto": F.col("c")})
    x = x.select(*keys, "value", "c", (F.col("upto") - F.col("c")).alias("before"))
    out = written(x, "ranked") if write else x
    if write:
        deleted(counts)
    return out


def sum_of_places(value: Column, first: Column, last: Column) -> Column:
    """``value`` as often as a distinct value's places, before to before + c - 1, lie from ``first`` to before ``last``."""
    n = F.least(F.col("before") + F.col("c"), last) - F.greatest(F.col("before"), first)
    return F.when(n > 0, value * n)


def at_place(at: Column, value: Column) -> Column:
    """``value`` if one of the distinct value's places is ``at``, which is a whole number."""
    return F.when((F.col("before") <= at) & (at < F.col("before") + F.col("c")), value)


def neighbours(df: DataFrame, keys: list[str], before: int, after: int, rows: int = BLOCK) -> DataFrame:
    """``df`` (with k) with block_ and own_: each row in its block, and once more, not as its own, in each block whose places it is at most
    ``before`` behind or ``after`` ahead of."""
    own = block_of(rows=rows)
    first, last = (F.floor((F.col("k") + d) / rows) for d in (-after, before))
    at = F.sequence(F.greatest(F.lit(0).cast("long"), first), last)
    return df.withColumn("own_block", own).withColumn("block_", F.explode(at)).withColumn("own_", F.col("block_") == F.col("own_block")).drop("own_block")


def joined(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    return reduce(lambda a, b: a.join(b, keys), frames)
