"""Column expressions for statistics with the reference's guards. NULL stands for "not available"."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """``x``, or NULL if it is NaN or infinite."""
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), x)


def over(a: Column, b: Column) -> Column:
    """a / b, NULL if b is 0 or the result is not finite."""
    return finite(F.try_divide(a, b))


def js_round(x: Column) -> Column:
    return F.floor(x + F.lit(0.5))


def pearson(cov: Column, vx: Column, vy: Column, mx: Column, my: Column, n: Column) -> Column:
    """Correlation from centred sums. NULL where a side has no variation to speak of; rounding beyond 1 snaps to 1."""
    den = F.sqrt(vx) * F.sqrt(vy)
    flat = (den <= 0) | (F.sqrt(vx / n) <= F.abs(mx) * 1e-12) | (F.sqrt(vy / n) <= F.abs(my) * 1e-12)
    return F.when(flat, None).when(F.abs(cov) >= den, F.signum(cov)).otherwise(F.try_divide(cov, den))


def simpson_weight(i: Column, n: Column) -> Column:
    """Weight of sample i of n (from 0) in composite Simpson's rule with unit spacing; an even number of samples ends in the
    cubic end correction 5/12, 2/3, -1/12."""
    m = F.when(n % 2 == 1, n).otherwise(n - 1)  # the part with an odd number of samples
    base = F.when(i >= m, 0.0).when((i == 0) | (i == m - 1), 1 / 3).when(i % 2 == 1, 4 / 3).otherwise(2 / 3)
    extra = F.when(n % 2 == 1, 0.0).when(i == n - 1, 5 / 12).when(i == n - 2, 2 / 3).when(i == n - 3, -1 / 12).otherwise(0.0)
    return F.when(n < 2, 0.0).when(n == 2, 0.5).otherwise(base + extra)


def _mul32(a: Column, b: Column) -> Column:
    """Product of two 32-bit numbers mod 2**32, in halves so that nothing overflows 63 bits."""
    mask = F.lit(0xFFFFFFFF)
    return (a * b.bitwiseAND(F.lit(0xFFFF)) + F.shiftleft((a * F.shiftright(b, 16)).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(mask)


def uniform_draw(k: Column, seed: int) -> Column:
    """Draw number k (from 0) of the 32-bit generator with this seed, in [0, 1); any draw can be had on its own."""
    mask = F.lit(0xFFFFFFFF)
    a = _mul32((k + 1).bitwiseAND(mask), F.lit(0x6D2B79F5).cast("long"))
    a = (a + F.lit(seed & 0xFFFFFFFF)).bitwiseAND(mask)
    t = _mul32(a.bitwiseXOR(F.shiftright(a, 15)), a.bitwiseOR(F.lit(1).cast("long")))
    t = (t + _mul32(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(F.lit(61).cast("long")))).bitwiseAND(mask).bitwiseXOR(t)
    return t.bitwiseXOR(F.shiftright(t, 14)) / F.lit(4294967296.0)


def normal_draws(spark: SparkSession, seed: int, n: int, chunk: int = 4096) -> DataFrame:
    """(j, z): the first n normal draws by Marsaglia's polar method on the generator. Each pair of draws is accepted or not on its
    own; a pair's number among the accepted is its number in its chunk and the counts of the chunks before."""
    m = F.col("id")
    x, y = 2 * uniform_draw(2 * m, seed) - 1, 2 * uniform_draw(2 * m + 1, seed) - 1
    # Within arrays, as a filter over columns would repeat the generator's whole expression.
    point = F.transform(F.array(F.struct(x.alias("x"), y.alias("y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), (p["x"] * p["x"] + p["y"] * p["y"]).alias("r")))
    good = spark.range(2 * n + 32).select("id", F.floor(m / chunk).alias("chunk"), F.inline(F.filter(point, lambda p: (p["r"] > 0) & (p["r"] < 1))))
    counts = good.groupBy("chunk").agg(F.count("*").alias("have"))
    before = counts.select("chunk", (F.sum("have").over(Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)) - F.col("have")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("chunk").orderBy("id")) - 1
    f = F.sqrt(-2 * F.ln("r") / F.col("r"))
    two = F.array(F.struct(F.lit(0).alias("side"), (F.col("x") * f).alias("z")), F.struct(F.lit(1).alias("side"), (F.col("y") * f).alias("z")))
    each = good.withColumn("inside", inside).join(before, "chunk").select((2 * (F.col("before") + F.col("inside"))).alias("at"), F.inline(two))
    return each.select((F.col("at") + F.col("side")).cast("long").alias("j"), "z").where(F.col("j") < n)
